"""DuckDB SQL for the registered queries: the fixture tables as common table expressions, and one query for each key."""

from __future__ import annotations

CATALOG = """
docs0 AS (
  SELECT doc_id, lang, source, replace(text, chr(10), ' ') AS one,
    concat('https://', source, '.example.org', CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END) AS portal
  FROM documents
), docs1 AS (
  SELECT doc_id, sha256(concat(portal, '|', doc_id)) AS id, CAST(doc_id AS VARCHAR) AS original_id, portal AS source_portal,
    concat('https://', source, '.example.org/dataset/', doc_id) AS url, substr(one, 1, 40) AS title,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '   ' ELSE substr(one, 41, 400) END AS description,
    ['dataset', 'series', 'service', 'map', 'other'][CAST(doc_id % 5 + 1 AS INTEGER)] AS record_kind,
    TIMESTAMP '2025-01-01' + to_minutes(doc_id) AS first_seen_at, TIMESTAMP '2026-01-01' + to_minutes(doc_id) AS last_updated_at,
    doc_id % 17 = 0 AS is_stale, lang AS language, source, lang
  FROM docs0
), catalog AS (
  SELECT d.*, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE sha256(concat(language, chr(10), title, chr(10), coalesce(description, ''))) END AS content_hash, e.embedding
  FROM docs1 d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
)"""
PREVIOUS = """
p0 AS (SELECT doc_id, source_portal, original_id, content_hash FROM catalog WHERE doc_id % 10 <> 3),
p1 AS (SELECT doc_id, source_portal, original_id, CASE WHEN doc_id % 7 = 0 THEN concat_ws('', 'old', content_hash) ELSE content_hash END AS content_hash FROM p0),
previous AS (
  SELECT source_portal, original_id, content_hash, 0 AS pos FROM p1
  UNION ALL SELECT source_portal, CAST(doc_id + 1000000 AS VARCHAR), content_hash, 0 FROM catalog WHERE doc_id % 19 = 0
  UNION ALL SELECT source_portal, original_id, 'second', 1 FROM p1 WHERE doc_id % 23 = 0
), identity AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_portal, original_id ORDER BY pos) AS rn FROM previous) WHERE rn = 1
)"""
PORTALS = """
portals AS (
  SELECT source AS name, concat('https://', source, '.example.org') AS url,
    ['ckan', 'dcat', 'sparql', 'data_json', 'socrata', 'opendatasoft', 'arcgis', 'stac'][n % 8 + 1] AS type,
    CASE WHEN n % 8 = 1 THEN 'udata' END AS profile, CASE WHEN n % 3 = 0 THEN 'fr' ELSE 'en' END AS language, n % 5 <> 4 AS enabled, n AS config_index
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents WHERE source IS NOT NULL AND source <> 'src1')
  UNION ALL SELECT 'empty', 'https://empty.example.org', 'ckan', NULL, 'en', true, 1000
)"""
CANONICAL = """
canonical AS (
  SELECT *, CASE WHEN rtrim(source_portal, '/') = 'https://src1.example.org' THEN 'https://src0.example.org' ELSE rtrim(source_portal, '/') END AS canonical_portal FROM catalog
), duplicates AS (
  SELECT lower(title) AS title_key FROM canonical GROUP BY 1 HAVING count(DISTINCT canonical_portal) > 1
), flagged AS (
  SELECT c.*, d.title_key IS NOT NULL AS is_duplicate,
    strlen(title) < 5 OR trim(coalesce(description, '')) = '' OR lower(title) LIKE '%test%' OR lower(title) LIKE '%prova%' OR lower(title) LIKE '%esempio%' AS noise
  FROM canonical c LEFT JOIN duplicates d ON lower(c.title) = d.title_key
), placed0 AS (
  SELECT last_updated_at, id, original_id, canonical_portal AS source_portal, p.name AS portal_name, f.url, title, coalesce(description, '') AS description, record_kind,
    CASE WHEN doc_id % 3 = 0 THEN concat(lang, ', ', source) ELSE '' END AS tags,
    CASE WHEN doc_id % 4 < 2 THEN source ELSE '' END AS organization,
    CASE doc_id % 5 WHEN 0 THEN 'CC BY' WHEN 1 THEN 'cc-by' ELSE '' END AS license,
    '' AS metadata_created, CASE WHEN doc_id % 7 < 4 THEN concat('2026-02-0', doc_id % 7 + 1) ELSE '' END AS metadata_modified,
    strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S+00:00') AS first_seen_at, p.language, is_duplicate, p.type AS portal_type, p.profile AS portal_profile, content_hash
  FROM flagged f LEFT JOIN portals p ON p.url = f.canonical_portal WHERE NOT noise
), snapshot AS (SELECT * EXCLUDE (last_updated_at, id) FROM placed0
), placed AS (SELECT *, row_number() OVER (ORDER BY last_updated_at DESC, id) - 1 AS pos FROM placed0
)"""
JOBS = """
jobs AS (
  SELECT event_id AS id, concat('https://src', user_id % 20, '.example.org') AS portal_url,
    ['pending', 'running', 'completed', 'failed', 'cancelled'][CAST(event_id % 5 + 1 AS INTEGER)] AS status, ts AS created_at,
    coalesce(CAST(floor(abs(value)) AS BIGINT), 0) % 100 AS created, coalesce(CAST(floor(abs(value)) AS BIGINT), 0) % 7 AS updated,
    coalesce(CAST(floor(abs(value)) AS BIGINT), 0) % 50 AS unchanged, CASE WHEN event_id % 3 = 0 THEN 'incremental' ELSE 'full' END AS sync_mode
  FROM events
), status AS (
  SELECT portal_url, max(created_at) AS last_successful_sync, max_by(sync_mode, (created_at, id)) AS last_sync_mode,
    'completed' AS sync_status, max_by(created + updated + unchanged, (created_at, id)) AS datasets_synced
  FROM jobs WHERE status = 'completed' GROUP BY portal_url
)"""
LINES = """
lines AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS original_id, concat('https://', lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')), '.example.org') AS source_portal,
    l_linenumber AS n, concat('line ', l_linenumber) AS name, CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END AS format,
    CASE WHEN l_linenumber % 2 = 0 THEN concat('text/', lower(l_linestatus)) END AS media_type, concat('https://data.example.org/', l_partkey) AS url,
    CAST(CASE WHEN l_linenumber IS NULL THEN NULL ELSE l_linenumber % 3 END AS BIGINT) AS field_count
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
)"""
SHORT = """
short AS (
  SELECT doc_id, source, trim(regexp_replace(regexp_replace(substr(text, 1, 40), '[<>&]', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t,
    trim(regexp_replace(regexp_replace(substr(text, 41, 200), '[<>&]', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS x
  FROM documents WHERE text IS NOT NULL
), d AS (SELECT *, nullif(x, '') AS y, doc_id // 50 AS page FROM short WHERE t <> '')"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


C, CP, CD, J, JD, R, L = _with(CATALOG), _with(CATALOG, PREVIOUS), _with(CATALOG, PORTALS, CANONICAL), _with(JOBS), _with(CATALOG, PORTALS, JOBS), _with(LINES), _with(SHORT)
ROW = "id, original_id, source_portal, title, last_updated_at, is_stale"
HASH = "sha256(concat('en', chr(10), {t}, chr(10), coalesce({d}, '')))"
OUTCOME = "CASE WHEN p.original_id IS NULL THEN 'created' WHEN c.content_hash = p.content_hash THEN 'unchanged' ELSE 'updated' END"
CHANGES = """changed AS (
  SELECT coalesce(c.source_portal, p.source_portal) AS source_portal, coalesce(c.original_id, p.original_id) AS original_id,
    CASE WHEN p.original_id IS NULL THEN 'added' WHEN c.original_id IS NULL THEN 'removed' WHEN c.content_hash IS NOT DISTINCT FROM p.content_hash THEN 'unchanged' ELSE 'changed' END AS change
  FROM catalog c FULL JOIN identity p ON c.source_portal = p.source_portal AND c.original_id = p.original_id)"""


def _family(url: str, title: str, description: str, key: str, kind: str = "'dataset'", where: str = "true", portal: str = "") -> str:
    h = HASH.format(t=title, d=description)
    return f"{L} SELECT {key} AS original_id, '{portal}' AS source_portal, {url} AS url, {title} AS title, {description} AS description, {kind} AS record_kind, {h} AS content_hash FROM d WHERE {where}"


FOUR = "concat(lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST(doc_id // 10000 AS VARCHAR), 4, '0'))"
ODS_TITLE = "CASE WHEN doc_id % 6 = 0 THEN concat('ods-', doc_id) ELSE t END"
ARC_TITLE = "CASE WHEN doc_id % 5 = 0 THEN concat('a', doc_id) ELSE t END"
STAC_TITLE = "CASE WHEN doc_id % 4 = 0 THEN concat('s', doc_id) ELSE t END"
N_CKAN = _family(
    "CASE WHEN page % 2 = 0 THEN concat('https://t.example.org/', doc_id, '/n', doc_id) ELSE concat('https://ckan.example.org/dataset/n', doc_id) END",
    "t", "CASE WHEN doc_id % 4 < 2 THEN y END", "CAST(doc_id AS VARCHAR)", portal="https://ckan.example.org/",
)
N_DATA_JSON = _family(
    "CASE WHEN doc_id % 3 = 0 THEN concat('https://page.example.org/', doc_id) WHEN doc_id % 5 = 0 THEN concat('https://id.example.org/', doc_id) ELSE 'https://data_json.example.org/' END",
    "t", "CASE WHEN doc_id % 2 = 0 THEN y END", "CASE WHEN doc_id % 5 = 0 THEN concat('https://id.example.org/', doc_id) ELSE CAST(doc_id AS VARCHAR) END", portal="https://data_json.example.org/",
)
N_SOCRATA = _family(
    f"CASE doc_id % 3 WHEN 0 THEN concat('https://link.example.org/', doc_id) WHEN 1 THEN concat('https://perma.example.org/', doc_id) ELSE concat('https://data.example.org/d/', {FOUR}) END",
    "t", "y", FOUR, portal="https://socrata.example.org/",
)
N_ODS = _family("concat('https://opendatasoft.example.org/explore/dataset/ods-', doc_id, '/')", ODS_TITLE, "y", "concat('ods-', doc_id)", portal="https://opendatasoft.example.org/")
N_ARCGIS = _family("concat('https://arcgis.example.org/datasets/a', doc_id)", ARC_TITLE, "y", "concat('a', doc_id)", portal="https://arcgis.example.org/")
N_STAC = _family(
    "CASE doc_id % 3 WHEN 0 THEN concat('https://about.example.org/', doc_id) WHEN 1 THEN concat('https://stac.example.org/abs/', doc_id) ELSE 'https://stac.example.org/' END",
    STAC_TITLE, "y", "concat('s', doc_id)", "'series'", portal="https://stac.example.org/",
)
N_DCAT = _family("concat('https://udata.example.org/datasets/d', doc_id, '/')", "t", "NULL::VARCHAR", "CASE WHEN doc_id % 4 = 0 THEN concat('i', doc_id) ELSE concat('d', doc_id) END", portal="https://dcat.example.org/")
N_SPARQL = f"""{L}, named AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN concat('i', doc_id // 2) ELSE CAST(doc_id AS VARCHAR) END AS key FROM d
), first AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page, doc_id) AS rn FROM named)
SELECT key AS original_id, 'https://sparql.example.org/' AS source_portal, concat('https://sparql.example.org/d/', doc_id) AS url, t AS title, y AS description, 'dataset' AS record_kind,
  {HASH.format(t="t", d="y")} AS content_hash FROM first WHERE rn = 1"""
N_SDMX = _family("concat('https://sdmx.example.org/dataflow/AG/F', doc_id, '/1.', doc_id % 3)", "t", "NULL::VARCHAR", "concat('AG:F', doc_id)", "'series'", "page % 11 <> 10", "https://sdmx.example.org/")
N_CSW = _family(
    "CASE WHEN page % 2 = 1 OR doc_id % 2 = 0 THEN concat('https://x/page/', doc_id) ELSE concat('https://x/', doc_id, '.zip') END", "t", "y", "concat('c', doc_id)",
    "CASE WHEN page % 2 = 1 THEN 'dataset' ELSE ['dataset', 'series', 'service', 'map', 'other'][CAST(doc_id % 5 + 1 AS INTEGER)] END", portal="https://csw.example.org/",
)
NORMALIZED = {"n1_ckan": N_CKAN, "n2_dcat": N_DCAT, "n3_sparql": N_SPARQL, "n4_data_json": N_DATA_JSON, "n5_socrata": N_SOCRATA, "n6_opendatasoft": N_ODS, "n7_arcgis": N_ARCGIS, "n8_stac": N_STAC, "n9_sdmx": N_SDMX, "n10_csw": N_CSW}

def _probe(family: str, key: str, modified: str, value: str, fields: str, where: str = "true") -> str:
    return f"SELECT '{family}' AS family, {key} AS original_id, CAST({modified} AS TIMESTAMP) AS modified, {value} AS value, CAST({fields} AS INTEGER) AS fields FROM d WHERE {where}"


_DAY = "lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')"
_SPARQL_KEY = "CASE WHEN doc_id % 3 = 0 THEN concat('i', doc_id // 2) ELSE CAST(doc_id AS VARCHAR) END"
N_METADATA = L + " " + " UNION ALL ".join([
    _probe("ckan", "CAST(doc_id AS VARCHAR)", f"concat('2026-01-', {_DAY}, ' 10:00:00')", f"concat('2026-01-', {_DAY}, 'T10:00:00Z')", "1 + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END"),
    _probe("data_json", "CASE WHEN doc_id % 5 = 0 THEN concat('https://id.example.org/', doc_id) ELSE CAST(doc_id AS VARCHAR) END", "CASE doc_id % 3 WHEN 0 THEN '2026-01-15' WHEN 1 THEN '2026-01-15 08:00:00' END",
           "CASE doc_id % 3 WHEN 0 THEN '2026-01-15' WHEN 1 THEN '2026-01-15T10:00:00+02:00' ELSE 'soon' END", "3 + CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END"),
    _probe("socrata", FOUR, "'2026-02-01'", "t", "4 + CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END"),
    _probe("opendatasoft", "concat('ods-', doc_id)", "'2026-03-01'", "CASE WHEN doc_id % 6 = 0 THEN '  ' ELSE t END", "3"),
    _probe("arcgis", "concat('a', doc_id)", "make_timestamp((1700000000 + doc_id) * 1000000)", "CASE WHEN doc_id % 5 = 0 THEN '   ' ELSE t END", "1 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END"),
    _probe("stac", "concat('s', doc_id)", "NULL", "'A'", "5 + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END"),
    _probe("dcat", "CASE WHEN doc_id % 4 = 0 THEN concat('i', doc_id) ELSE concat('d', doc_id) END", "NULL", "concat('https://x/', doc_id, '.csv')", "5 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END"),
    _probe("sparql", _SPARQL_KEY, "NULL", "t", "4 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END", f"true QUALIFY row_number() OVER (PARTITION BY {_SPARQL_KEY} ORDER BY page, doc_id) = 1"),
    _probe("sdmx", "concat('AG:F', doc_id)", "CASE WHEN doc_id % 2 = 0 THEN '2026-01-05 08:00:00' ELSE '2020-01-01' END", "t", "7", "page % 11 <> 10"),
    _probe("ogc_records", "concat('c', doc_id)", "concat('2026-01-0', doc_id % 9 + 1)", "CASE WHEN page % 2 = 1 THEN concat('https://x/page/', doc_id) ELSE concat('https://x/', doc_id, '.zip') END", "2"),
])

SQL: dict[str, str] = NORMALIZED | {
    "n_metadata": N_METADATA,
    "n9_sdmx_metadata": f"""{L} SELECT concat('AG:F', doc_id) AS original_id, concat('https://t.example.org/AG/F', doc_id, '?v=1.', doc_id % 3, '&f=AG,F', doc_id, ',1.', doc_id % 3) AS url, concat('1.', doc_id % 3) AS version,
      concat('S', doc_id) AS structure, concat('https://sdmx.example.org/data/AG,F', doc_id, ',1.', doc_id % 3) AS data_url, concat('https://sdmx.example.org/dataflow/AG/F', doc_id, '/1.', doc_id % 3) AS structure_url,
      'series' AS kind, 'CREATED' AS note, 'F' AS fr, CASE WHEN doc_id % 2 = 0 THEN '2026-01-05T08:00:00+00:00' ELSE '2020-01-01T00:00:00+00:00' END AS modified FROM d WHERE page % 11 <> 10""",
    "flagship_curated_portals": f"{CD} SELECT source_portal, portal_name, portal_type, portal_profile, count(*) AS n, count(*) FILTER (WHERE is_duplicate) AS duplicates FROM snapshot GROUP BY ALL",
    "s1_scan_newest": f"{C} SELECT {ROW} FROM catalog ORDER BY last_updated_at DESC, id LIMIT 50",
    "s2_bounded_list": f"{C} SELECT {ROW} FROM catalog WHERE source_portal = 'https://src3.example.org' ORDER BY last_updated_at DESC, id LIMIT 10000",
    "s3_get": f"{C} SELECT {ROW} FROM catalog WHERE id = (SELECT min(id) FROM catalog)",
    "s4_portal_hashes": f"{C} SELECT original_id, content_hash FROM catalog WHERE source_portal = 'https://src2.example.org/'",
    "s5_ckan_declared": f"{L} SELECT DISTINCT page::INTEGER AS page, 1000::BIGINT AS declared FROM d",
    "s15_identity": f"{CP} SELECT source_portal, original_id, content_hash FROM identity",
    "s15_collisions": f"{CP} SELECT count(*) AS rows, count(DISTINCT (source_portal, original_id)) AS keys, count(*) - count(DISTINCT (source_portal, original_id)) AS collisions FROM previous",
    "s17_portals": f"""{_with(PORTALS)}, p2 AS (SELECT * EXCLUDE (profile), CASE WHEN config_index % 7 = 0 THEN 'udata' ELSE profile END AS profile FROM portals)
      SELECT name, url, type, profile, language, CASE WHEN profile IS NOT NULL AND type <> 'dcat' THEN 'profile is only for dcat'
        WHEN config_index % 5 = 1 AND type <> 'sparql' THEN 'sparql_endpoint is only for sparql' WHEN config_index % 5 = 2 THEN 'ogc_endpoint is only for ogc_records' END AS reason
      FROM p2 WHERE enabled""",
    "s7_dataset_nodes": f"{L} SELECT page::INTEGER AS page, count(*) AS datasets FROM d GROUP BY page",
    "s14_count_mismatch": f"{L} SELECT DISTINCT 'https://csw.example.org/' AS portal_url, count(*) + 1 AS declared, count(*) AS parsed FROM d WHERE page % 7 = 6 GROUP BY page",
    "s14_mismatching_pages": f"{L} SELECT 'https://csw.example.org/' AS portal_url, page::INTEGER AS page, count(*) + 1 AS declared, count(*) AS parsed FROM d WHERE page % 7 = 6 GROUP BY page",
    "k1_jsonl": f"{C} SELECT id, original_id, title, description, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S+00:00') AS first_seen_at FROM catalog",
    "k2_json_array": f"{C} SELECT id, original_id, title, description, strftime(last_updated_at, '%Y-%m-%dT%H:%M:%S+00:00') AS last_updated_at, row_number() OVER (ORDER BY id DESC) > 1 AS comma FROM catalog",
    "s18_snapshot_files": f"""{CD}, files AS (SELECT 'canonical' AS kind, 'canonical' AS data, source_portal FROM snapshot UNION ALL SELECT 'identity', 'identity', source_portal FROM snapshot
        UNION ALL SELECT 'portal', regexp_replace(lower(portal_name), '[^a-z0-9-]', '-', 'g'), source_portal FROM snapshot)
      SELECT kind, data, count(*) AS rows, true AS files_agree, true AS id_agrees FROM files GROUP BY ALL""",
    "k4_snapshot_rows": f"{CD} SELECT * EXCLUDE (last_updated_at, id) FROM placed",
    "k5_portal_files": f"{CD} SELECT regexp_replace(lower(portal_name), '[^a-z0-9-]', '-', 'g') AS portal_file, count(*) AS rows, 0 AS strays FROM snapshot GROUP BY 1",
    "k6_identity": f"{CD} SELECT source_portal, original_id, content_hash, pos FROM placed",
    "k7_manifest": f"""{CD} SELECT 'all.parquet' AS canonical_file, (SELECT count(*) FROM catalog) AS raw, sum(count(*)) OVER ()::BIGINT AS exported, (SELECT count(*) FROM catalog) - sum(count(*)) OVER ()::BIGINT AS filtered,
        sum(count(*) FILTER (WHERE is_duplicate)) OVER ()::BIGINT AS duplicate_flagged, source_portal, portal_name, portal_type, portal_profile, count(*) AS n,
        'by_portal/portal_file=' || regexp_replace(lower(portal_name), '[^a-z0-9-]', '-', 'g') AS file
      FROM snapshot GROUP BY source_portal, portal_name, portal_type, portal_profile""",
    "k8_reports": f"""{CD}, buckets AS (SELECT 'type' AS dimension, portal_type AS bucket FROM snapshot UNION ALL SELECT 'profile', coalesce(portal_profile, 'none') FROM snapshot
        UNION ALL SELECT 'language', language FROM snapshot UNION ALL SELECT 'portal', portal_name FROM snapshot)
      SELECT (SELECT count(*) FROM snapshot) AS datasets, (SELECT count(DISTINCT source_portal) FROM snapshot) AS portals, 0 AS format, 0 AS media_type, dimension, bucket, count(*) AS n FROM buckets GROUP BY ALL""",
    "a9_portal_top_buckets": f"""{R}, buckets AS (
        SELECT source_portal, 'format' AS facet, format AS bucket, count(*) AS n FROM lines WHERE format IS NOT NULL GROUP BY ALL
        UNION ALL SELECT source_portal, 'media_type', media_type, count(*) FROM lines WHERE media_type IS NOT NULL GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY source_portal, facet ORDER BY n DESC, bucket) AS rank FROM buckets)
      SELECT source_portal, facet, least(rank, 2) AS rank, CASE WHEN rank = 1 THEN bucket END AS bucket, sum(n)::BIGINT AS n, sum(CASE WHEN rank = 1 THEN 0 ELSE 1 END)::BIGINT AS more
      FROM ranked GROUP BY source_portal, facet, least(rank, 2), CASE WHEN rank = 1 THEN bucket END""",
    "k9_snapshot_changelog": f"""{CD}, s1 AS (SELECT source_portal, original_id, content_hash AS was FROM snapshot), now0 AS (
        SELECT source_portal, original_id, CASE WHEN CAST(original_id AS BIGINT) % 8 = 2 THEN 'changed' || content_hash ELSE content_hash END AS now, last_updated_at, id, 1 AS way FROM placed WHERE CAST(original_id AS BIGINT) % 9 <> 4
        UNION ALL SELECT source_portal, original_id || 'n', content_hash, last_updated_at, id, 1 FROM placed WHERE CAST(original_id AS BIGINT) % 31 = 5
        UNION ALL SELECT source_portal, original_id, 'repeat', last_updated_at + to_hours(CAST(CAST(original_id AS BIGINT) % 3 - 1 AS INTEGER)), id, 2 FROM placed
          WHERE CAST(original_id AS BIGINT) % 9 <> 4 AND CAST(original_id AS BIGINT) % 2 = 0 AND url LIKE 'https://src0.example.org/%'),
      s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_portal, original_id ORDER BY last_updated_at DESC, id, CASE way WHEN 1 THEN 'https://src0' ELSE 'https://src1' END) AS rn FROM now0) WHERE rn = 1)
      SELECT true AS compared_with_first, source_portal, count(*) FILTER (WHERE s1.original_id IS NULL) AS added, count(*) FILTER (WHERE s1.original_id IS NOT NULL AND s2.original_id IS NOT NULL AND now IS DISTINCT FROM was) AS changed,
        count(*) FILTER (WHERE s2.original_id IS NULL) AS removed, count(*) FILTER (WHERE s1.original_id IS NOT NULL AND s2.original_id IS NOT NULL AND now IS NOT DISTINCT FROM was) AS unchanged
      FROM s1 FULL JOIN s2 USING (source_portal, original_id) GROUP BY source_portal""",
    "k3_csv": f"{C} SELECT id, original_id, source_portal, url, title, description, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at, strftime(last_updated_at, '%Y-%m-%dT%H:%M:%SZ') AS last_updated_at FROM catalog",
    "k5_file_collisions": f"{CD} SELECT regexp_replace(lower(portal_name), '[^a-z0-9-]', '-', 'g') AS file, count(DISTINCT source_portal) AS portals FROM snapshot GROUP BY 1 HAVING count(DISTINCT source_portal) > 1",
    "f1_noise": f"{CD} SELECT original_id, noise FROM flagged",
    "f2_searchable": f"{C} SELECT original_id FROM catalog WHERE embedding IS NOT NULL AND NOT is_stale AND record_kind IN ('dataset', 'series')",
    "f3_pending": f"{C} SELECT original_id, record_kind FROM catalog WHERE embedding IS NULL AND NOT is_stale AND record_kind IN ('dataset', 'series') AND trim(concat(title, ' ', coalesce(description, ''))) <> '' ORDER BY last_updated_at DESC, id LIMIT 100",
    "f4_pending_count": f"{C} SELECT count(*) AS pending FROM catalog WHERE embedding IS NULL AND NOT is_stale AND trim(concat(title, ' ', coalesce(description, ''))) <> ''",
    "f5_enabled": f"{_with(PORTALS)} SELECT name, config_index FROM portals WHERE enabled",
    "f6_modified_since": f"""{CD}, facts AS (
      SELECT f.original_id, p.type, CASE WHEN doc_id % 7 < 4 THEN DATE '2026-02-01' + CAST(doc_id % 7 AS INTEGER) END AS m FROM flagged f JOIN portals p ON p.url = f.canonical_portal)
      SELECT original_id, type FROM facts WHERE CASE type WHEN 'data_json' THEN m IS NULL OR m >= DATE '2026-02-03' WHEN 'sparql' THEN m IS NULL OR m > DATE '2026-02-03'
        WHEN 'dcat' THEN true WHEN 'stac' THEN true ELSE coalesce(m >= DATE '2026-02-03', false) END""",
    "f7_kinds": f"{C} SELECT original_id, CASE record_kind WHEN 'dataset' THEN 'dataset' WHEN 'series' THEN 'series' WHEN 'service' THEN 'service' WHEN 'map' THEN 'map' ELSE 'other' END AS by_scope, record_kind AS stored FROM catalog",
    "f8_redacted_json": r"""SELECT doc_id, [CAST('{"a":1.50, "b": {"c":[1e400,-0.0,{}]}}' AS VARCHAR), concat('{"n":', doc_id, ', "password2":"kept \ud800"}'),
        concat(repeat('[', 1500), '{"k":"password"}', repeat(']', 1500)), NULL][CAST(doc_id % 4 + 1 AS INTEGER)] AS metadata FROM documents""",
    "f8_redacted": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS had_secret, 0 AS has_secret, 1 AS keeps_doc FROM documents",
    "p1_snapshot": f"{CD} SELECT * EXCLUDE (portal_type, portal_profile, content_hash) FROM snapshot",
    "p3_details": f"""{C} SELECT id, original_id, title, record_kind, concat_ws(',', 'language', CASE WHEN doc_id % 7 < 4 THEN 'metadata_modified' END, CASE WHEN doc_id % 4 < 3 THEN 'organization' END, CASE WHEN doc_id % 3 < 2 THEN 'tags' END) AS keys,
      upper(lang) AS language, CASE doc_id % 4 WHEN 1 THEN source WHEN 2 THEN 'x' END AS organization FROM catalog""",
    "p4_schema": f"""{R} SELECT original_id, name, format, media_type, url, NULL::VARCHAR AS description,
      CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'f1:int' ELSE 'f1:int,f2:int' END AS fields FROM lines WHERE n IS NOT NULL""",
    "j1_aliases": f"{CD} SELECT original_id, canonical_portal FROM canonical",
    "j2_portal_facts": f"{CD} SELECT original_id, p.name AS portal_name, p.language AS portal_language, p.type AS portal_type, p.profile AS portal_profile FROM canonical c LEFT JOIN portals p ON p.url = c.canonical_portal",
    "j4_duplicate_flag": f"{CD} SELECT original_id, is_duplicate FROM flagged",
    "j8_distributions": f"""{L} SELECT concat('https://udata.example.org/datasets/d', doc_id, '/') AS iri, 2 AS n, concat('{{"@id":"_:r', doc_id, '","downloadURL":{{"@id":"https://x/', doc_id, '.csv"}},"format":"CSV"}}') AS first, '"_:missing"' AS second FROM d""",
    "j9_attached": f"{L} SELECT CASE WHEN doc_id % 3 = 0 THEN concat('i', doc_id // 2) ELSE CAST(doc_id AS VARCHAR) END AS original_id, 2 AS n FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN doc_id % 3 = 0 THEN concat('i', doc_id // 2) ELSE CAST(doc_id AS VARCHAR) END ORDER BY page, doc_id) AS rn FROM d) WHERE rn = 1",
    "j10_portal_list": f"""{JD} SELECT p.name, p.url, p.type, p.enabled, s.last_successful_sync, s.last_sync_mode, s.sync_status, coalesce(n.datasets, 0) AS datasets
      FROM portals p LEFT JOIN status s ON s.portal_url = p.url LEFT JOIN (SELECT rtrim(source_portal, '/') AS url, count(*) AS datasets FROM catalog WHERE NOT is_stale GROUP BY 1) n ON n.url = p.url""",
    "j11_excluded": f"{CD} SELECT name, url FROM portals WHERE enabled AND url NOT IN (SELECT source_portal FROM snapshot)",
    "j14_touch": f"{C} SELECT original_id, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2026-06-01' ELSE last_updated_at END AS last_updated_at, is_stale AND doc_id % 4 <> 0 AS is_stale FROM catalog",
    "a1_stats": f"{C} SELECT count(*) AS total, count(embedding) AS embedded, count(DISTINCT source_portal) AS portals, max(last_updated_at) AS last_update, count(*) FILTER (WHERE is_stale) AS stale FROM catalog",
    "a2_duplicate_titles": f"{CD} SELECT lower(title) AS title_key, count(DISTINCT canonical_portal) AS portals FROM canonical GROUP BY 1 HAVING count(DISTINCT canonical_portal) > 1",
    "a3_by_status": f"{J} SELECT status, count(*) AS n FROM jobs GROUP BY status",
    "a4_outcomes": f"""{CP} SELECT c.source_portal, count(*) FILTER (WHERE o = 'unchanged') AS unchanged, count(*) FILTER (WHERE o = 'updated') AS updated, count(*) FILTER (WHERE o = 'created') AS created,
      0::BIGINT AS failed, 0::BIGINT AS skipped, count(*) AS total, count(*) AS successful
      FROM (SELECT c.source_portal, {OUTCOME} AS o FROM catalog c LEFT JOIN identity p ON c.source_portal = p.source_portal AND c.original_id = p.original_id) c GROUP BY 1""",
    "u10_dry_run": f"""{CP} SELECT c.source_portal, count(*) FILTER (WHERE o = 'unchanged') AS unchanged, count(*) FILTER (WHERE o = 'updated') AS updated, count(*) FILTER (WHERE o = 'created') AS created,
      0::BIGINT AS failed, 0::BIGINT AS skipped, count(*) AS total, count(*) AS successful
      FROM (SELECT c.source_portal, {OUTCOME} AS o FROM catalog c LEFT JOIN identity p ON c.source_portal = p.source_portal AND c.original_id = p.original_id) c GROUP BY 1""",
    "a5_batch_summary": f"{J} SELECT status, count(DISTINCT portal_url) AS portals, count(*) AS runs, sum(created + updated + unchanged)::BIGINT AS datasets FROM jobs GROUP BY status",
    "a7_coverage": f"""{CD} SELECT 'type' AS dimension, portal_type AS bucket, count(*) AS n FROM snapshot GROUP BY 2 UNION ALL SELECT 'profile', coalesce(portal_profile, 'none'), count(*) FROM snapshot GROUP BY 2
      UNION ALL SELECT 'language', language, count(*) FROM snapshot GROUP BY 2 UNION ALL SELECT 'portal', portal_name, count(*) FROM snapshot GROUP BY 2""",
    "a8_resource_buckets": f"{R} SELECT 'format' AS facet, format AS bucket, count(*) AS n FROM lines WHERE format IS NOT NULL GROUP BY 2 UNION ALL SELECT 'media_type', media_type, count(*) FROM lines WHERE media_type IS NOT NULL GROUP BY 2",
    "a9_portal_buckets": f"""{R}, buckets AS (
        SELECT source_portal, 'format' AS facet, format AS bucket, count(*) AS n FROM lines WHERE format IS NOT NULL GROUP BY ALL
        UNION ALL SELECT source_portal, 'media_type', media_type, count(*) FROM lines WHERE media_type IS NOT NULL GROUP BY ALL)
      SELECT source_portal, facet, row_number() OVER (PARTITION BY source_portal, facet ORDER BY n DESC, bucket) - 1 AS pos, bucket, n FROM buckets""",
    "g4_config_checksum": f"""{_with(PORTALS)} SELECT sha256(string_agg(concat('{{"name":"', name, '","url":"', url, '","type":"', type, '"', CASE WHEN profile IS NOT NULL THEN concat(',"profile":"', profile, '"') ELSE '' END,
        ',"language":"', language, '","enabled":', enabled, ',"aliases":[', CASE WHEN name = 'src0' THEN '"https://src1.example.org"' ELSE '' END, ']}}'), chr(10) ORDER BY config_index)) AS checksum FROM portals""",
    "a9_resource_quality": f"""{R} SELECT source_portal, count(*) AS datasets, count(*) FILTER (WHERE r > 0) AS with_resources, count(*) FILTER (WHERE f > 0) AS with_fields, sum(r)::BIGINT AS resources
      FROM (SELECT source_portal, original_id, count(n) AS r, count(*) FILTER (WHERE field_count > 0) AS f FROM lines GROUP BY 1, 2) GROUP BY 1""",
    "a10_completeness": f"""{CD}, n AS (SELECT count(*) AS total FROM snapshot), c AS (
      SELECT 'description' AS facet, count(*) FILTER (WHERE trim(description) <> '') AS present FROM snapshot UNION ALL SELECT 'license', count(*) FILTER (WHERE license <> '') FROM snapshot
      UNION ALL SELECT 'organization', count(*) FILTER (WHERE organization <> '') FROM snapshot UNION ALL SELECT 'tags', count(*) FILTER (WHERE tags <> '') FROM snapshot
      UNION ALL SELECT 'metadata_modified', count(*) FILTER (WHERE metadata_modified <> '') FROM snapshot UNION ALL SELECT 'resources', 0 UNION ALL SELECT 'resource_schema', 0)
      SELECT facet, present, total, round(present / total::DOUBLE, 4) AS rate FROM c, n""",
    "a11_curation": f"{CD} SELECT count(*) AS raw, count(*) FILTER (WHERE NOT noise) AS exported, count(*) FILTER (WHERE noise) AS filtered, count(*) FILTER (WHERE NOT noise AND is_duplicate) AS duplicates FROM flagged",
    "a12_changelog": f"{CP}, {CHANGES} SELECT source_portal, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM changed GROUP BY 1",
    "a14_distributions": f"""{L} SELECT concat('https://sparql.example.org/d/', doc_id) AS uri, concat('https://x/', doc_id, '/a') AS node_iri,
        concat('{{"@id":"https://x/', doc_id, '/a","dcat:downloadURL":{{"@id":"https://x/f"}},"dct:title":[{{"@value":"A","@language":"en"}},{{"@value":"B","@language":"de"}}]}}') AS json FROM d
      UNION ALL SELECT concat('https://sparql.example.org/d/', doc_id), concat('_:b', doc_id), '{{"dct:format":{{"@id":"https://f/CSV"}}}}' FROM d""",
    "a15_publishers": f"{L} SELECT DISTINCT concat('https://p.example.org/', source) AS publisher FROM d",
    "a15_dataset_count": f"{L} SELECT count(*) AS datasets FROM d",
    "a17_update_dates": f"{L} SELECT concat('AG:F', doc_id) AS original_id, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2026-01-05 08:00:00' ELSE TIMESTAMP '2020-01-01' END AS modified FROM d WHERE page % 11 <> 10",
    "a18_alias_groups": "SELECT CASE WHEN count(*) FILTER (WHERE source = 'src0') > 0 THEN 1 ELSE 0 END::BIGINT AS alias_groups FROM documents",
    "w1_keep_first": f"{CP} SELECT source_portal, count(*) AS total, count(DISTINCT original_id) AS kept, count(*) - count(DISTINCT original_id) AS skipped FROM previous GROUP BY 1",
    "t2_search": f"""{C}, s AS (SELECT id, title, record_kind, doc_id, embedding FROM catalog WHERE embedding IS NOT NULL AND NOT is_stale AND record_kind IN ('dataset', 'series')),
      q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
      scored AS (SELECT query_id, id, title, record_kind, list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[])::FLOAT AS score FROM s, q),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
      SELECT query_id, rank::INTEGER AS rank, id, title, record_kind, round(score::DOUBLE, 4) AS score FROM ranked WHERE rank <= 10""",
    "t6_top_buckets": f"{CD}, b AS (SELECT portal_name AS bucket, count(*) AS n FROM snapshot GROUP BY 1), t AS (SELECT * FROM b ORDER BY n DESC, bucket LIMIT 15) SELECT bucket, n FROM t UNION ALL SELECT NULL, count(*) - 15 FROM b HAVING count(*) > 15",
    "t7_recent_jobs": f"{J} SELECT id, portal_url, status, created_at FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 20",
    "t10_config_order": f"{JD} SELECT p.name, p.config_index, s.sync_status, s.datasets_synced FROM status s JOIN portals p ON p.url = s.portal_url",
    "x_urls": f"""{C} SELECT original_id, rtrim(source_portal, '/') AS trimmed, replace(concat(source, '.example.org'), '.', '-') AS portal_name,
      regexp_replace(lower(title), '[^a-z0-9-]', '-', 'g') AS file_name, original_id AS last_segment, 'https' AS scheme, true AS safe, true AS valid FROM catalog""",
    "x1_html_cases": "SELECT page_id, concat(page_id, ' a < b and c > d<b>&lt; word ', page_id, 'éé ¬it; A 1 ?> xy') AS text FROM pages",
    "x1_html_to_text": r"""SELECT page_id, trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(article|body|br|div|footer|h[1-6]|html|li|nav|p|ul)\b[^>]*>', ' ', 'g'),
        '<[/!]?[A-Za-z][^>]*>', '', 'g'), '</?[A-Za-z][^>]*$|<!.*$|</$', ''),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp([^A-Za-z0-9;]|$)', '&amp;\1', 'g'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""",
    "x2_non_blank": f"{C} SELECT original_id, nullif(trim(coalesce(description, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(12288), chr(8195))), '') AS description, nullif(trim(description, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(12288), chr(8195))), '') AS plain FROM catalog",
    "x6_formats": "SELECT p_partkey, p_name AS plain, p_brand AS short FROM part",
    "x7_protocols": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'WFS' WHEN 1 THEN 'WMTS' WHEN 4 THEN 'CSW' END AS format, CASE WHEN p_partkey % 6 = 2 THEN 'image/png' END AS media_type FROM part""",
    "x10_urns": "SELECT s_suppkey, concat('AG', s_nationkey) AS agency, concat('F', s_suppkey) AS id, '1.0' AS version FROM supplier",
    "d_dates": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS parsed,
      strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS csv_time, date_trunc('second', ts) AS from_millis FROM events""",
    "g1_hashes": f"{C} SELECT original_id, sha256(concat(title, chr(10), coalesce(description, ''))) AS plain, sha256(concat(language, chr(10), title, chr(10), coalesce(description, ''))) AS with_language FROM catalog",
    "m_metadata": f"""{C} SELECT original_id, CASE WHEN doc_id % 3 = 0 THEN concat(lang, ', ', source) ELSE '' END AS tags, CASE WHEN doc_id % 4 < 2 THEN source ELSE '' END AS organization,
      CASE doc_id % 5 WHEN 0 THEN 'CC BY' WHEN 1 THEN 'cc-by' ELSE '' END AS license, CASE WHEN doc_id % 7 < 4 THEN concat('2026-02-0', doc_id % 7 + 1) ELSE '' END AS modified FROM catalog""",
    "m5_rates": "SELECT o_custkey, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 4) AS rate FROM orders GROUP BY 1",
    "y_socrata_facets": f"{L} SELECT {FOUR} AS original_id, CASE WHEN doc_id % 2 = 0 THEN 'cat' ELSE 'dom' END AS category, 'b,A' AS tags, NULL::VARCHAR AS license, CASE WHEN doc_id % 3 = 0 THEN 'Office' ELSE 'Owner' END AS publisher FROM d",
    "y_opendatasoft_facets": f"{L} SELECT concat('ods-', doc_id) AS original_id, 'T' AS themes, CASE WHEN doc_id % 2 = 0 THEN 'single' ELSE 'K1,K2' END AS keywords, CASE WHEN doc_id % 3 = 0 THEN 'Pub' ELSE 'Creator' END AS publisher FROM d",
    "y_arcgis_facets": f"{L} SELECT concat('a', doc_id) AS original_id, 'Env,/categories/env' AS categories, 'x' AS tags, NULL::VARCHAR AS license, 'me' AS publisher FROM d",
    "y4_socrata_columns": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'c1:text:L1,L2:null:null' ELSE 'c1:text:null' END AS columns FROM orders",
    "l1_localized": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('fr ', c_name) WHEN 2 THEN concat('en ', c_name) ELSE concat('de ', c_name) END AS name FROM customer",
    "l2_jsonld": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('value ', c_name) WHEN 2 THEN concat('fr ', c_name) ELSE concat('de ', c_name) END AS name FROM customer",
    "l3_dcat_us": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('fr ', c_name) WHEN 2 THEN concat('first ', c_name) ELSE concat('list ', c_name) END AS name FROM customer",
    "l4_language_map": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('fr ', c_name) WHEN 1 THEN concat('en ', c_name) ELSE concat('de ', c_name) END AS name FROM customer",
    "q1_first_text": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('v ', c_name) WHEN 2 THEN concat('a ', c_name) END AS text, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('i ', c_name) WHEN 2 THEN concat('a ', c_name) END AS reference FROM customer",
    "q6_bounding_box": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat_ws(',', c_custkey % 90, 1, 2, 3) WHEN 1 THEN concat_ws(',', c_custkey % 90, -4, 5, 6) END AS box FROM customer",
    "r0_resources": f"{R} SELECT original_id, count(n) AS resources, coalesce(sum(field_count), 0)::BIGINT AS fields FROM lines GROUP BY 1",
    "r_shapes": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('ods title|||;|||', o_orderkey) WHEN 1 THEN 'sheet|JSON|application/json|https://data.example.org/resource/abcd-1234.json'
      WHEN 2 THEN 'svc|Feature Service||https://svc.example.org' WHEN 3 THEN 'A|||https://x/a;b||text/csv|https://x/b' ELSE 'AG,F,1|SDMX-CSV|application/vnd.sdmx.data+csv|https://sdmx/data' END AS resources FROM orders""",
    "u1_upsert": f"""{C} SELECT original_id, CASE WHEN doc_id % 3 = 0 THEN concat('new ', title) ELSE title END AS title, embedding IS NOT NULL AS embedded, first_seen_at,
      CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2026-06-01' ELSE last_updated_at END AS last_updated_at, is_stale AND doc_id % 3 <> 0 AS is_stale FROM catalog
      UNION ALL SELECT concat('added-', original_id), title, false, TIMESTAMP '2026-06-01', TIMESTAMP '2026-06-01', false FROM catalog WHERE doc_id % 50 = 1""",
    "u4_stale_by_time": f"{C} SELECT original_id, is_stale OR (source_portal = 'https://src3.example.org' AND last_updated_at < TIMESTAMP '2026-01-01 08:00:00') AS is_stale FROM catalog",
    "u5_stale_by_exclusion": f"""{C} SELECT original_id, CASE WHEN source_portal = 'https://src4.example.org/' THEN doc_id % 4 <> 0 ELSE is_stale END AS is_stale,
      CASE WHEN source_portal <> 'https://src4.example.org/' THEN NULL WHEN doc_id % 4 = 0 AND is_stale THEN 'revived' WHEN doc_id % 4 <> 0 AND NOT is_stale THEN 'retired' END AS change FROM catalog""",
    "u6_sync_status": f"""{JD}, runs AS (SELECT portal_url, max(created_at) AS last_sync, max_by(status, (created_at, id)) AS sync_status, max_by(sync_mode, (created_at, id)) AS mode, max_by(created, (created_at, id)) AS datasets_synced FROM jobs WHERE status <> 'pending' GROUP BY 1)
      SELECT coalesce(s.portal_url, r.portal_url) AS portal_url, CASE WHEN r.sync_status = 'completed' THEN r.last_sync ELSE s.last_successful_sync END AS last_successful_sync, coalesce(r.mode, s.last_sync_mode) AS last_sync_mode,
        coalesce(r.sync_status, s.sync_status) AS sync_status, coalesce(r.datasets_synced, s.datasets_synced) AS datasets_synced FROM status s FULL JOIN runs r ON r.portal_url = s.portal_url""",
    "u7_delta": f"{CP} SELECT c.original_id, {OUTCOME} AS outcome FROM catalog c LEFT JOIN identity p ON c.source_portal = p.source_portal AND c.original_id = p.original_id",
    "u8_stale_gate": f"""{J} SELECT id, sync_mode = 'full' AND status <> 'cancelled' AND status <> 'failed' AND id % 4 <> 0 AS allowed, CASE status WHEN 'cancelled' THEN 'cancelled' WHEN 'failed' THEN 'partial' ELSE 'completed' END AS final FROM jobs""",
    "u9_sync_plan": f"""{JD} SELECT p.name, CASE WHEN s.portal_url IS NULL THEN 'first_full' WHEN p.type = 'stac' THEN 'full' ELSE 'incremental' END AS plan,
      CASE WHEN s.portal_url IS NOT NULL AND p.type <> 'stac' THEN s.last_successful_sync END AS since FROM portals p LEFT JOIN status s ON s.portal_url = p.url""",
    "u11_embedding": f"""{C}, e AS (SELECT *, strlen(trim(concat(title, ' ', coalesce(description, '')))) AS bytes, embedding IS NULL AND NOT is_stale AND record_kind IN ('dataset', 'series') AND trim(concat(title, ' ', coalesce(description, ''))) <> '' AS todo FROM catalog)
      SELECT original_id, record_kind, CASE WHEN todo THEN 8 WHEN embedding IS NULL THEN 0 ELSE len(embedding) END::INTEGER AS size, CASE WHEN todo THEN round(bytes / 1000.0::DOUBLE, 4) END AS first, CASE WHEN todo THEN coalesce(content_hash, sha256(concat(title, chr(10), coalesce(description, '')))) ELSE content_hash END AS content_hash FROM e""",
    "u12_dimension": f"{C} SELECT count(embedding) AS vectors, count(*) FILTER (WHERE embedding IS NOT NULL AND len(embedding) <> 64) AS wrong FROM catalog",
    "v1_harvest_status": f"{J} SELECT id, portal_url, status, created_at, (SELECT count(*) FROM jobs WHERE status = 'pending') AS pending, (SELECT count(*) FROM jobs WHERE status = 'running') AS running FROM jobs ORDER BY created_at DESC, id DESC LIMIT 20",
    "v3_portal_stats": f"""{JD} SELECT p.name, s.sync_status, (SELECT count(*) FROM catalog WHERE NOT is_stale AND rtrim(source_portal, '/') = p.url) AS datasets FROM portals p LEFT JOIN status s ON s.portal_url = p.url WHERE p.name = 'src5'""",
    "v4_outcome": f"{J} SELECT portal_url, count(*) FILTER (WHERE status IN ('failed', 'cancelled')) AS bad, count(*) FILTER (WHERE status IN ('failed', 'cancelled')) = 0 AS success FROM jobs GROUP BY 1",
    "v5_title_overlap": f"""{CD}, t AS (SELECT DISTINCT lower(title) AS title_key, canonical_portal FROM canonical) SELECT t.canonical_portal, count(*) AS titles, count(d.title_key) AS shared, round(count(d.title_key) / count(*)::DOUBLE, 4) AS share
      FROM t LEFT JOIN duplicates d ON d.title_key = t.title_key GROUP BY 1""",
    "w2_first_pages": " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in (N_SOCRATA, N_ODS, N_ARCGIS)),
    "st6_runs": f"{C} SELECT original_id, source = 'src3' OR (doc_id % 4 = 1 AND (source <> 'src2' OR doc_id % 10 = 3)) AS is_stale FROM catalog",
    "st5_partial_run": f"""{C} SELECT 'partial' AS status, count(*) FILTER (WHERE doc_id % 10 = 5) AS synced, count(*) FILTER (WHERE doc_id % 10 = 0) AS skipped, CAST(0 AS BIGINT) AS failed, false AS may_retire,
      count(*) AS rows, count(*) FILTER (WHERE is_stale AND doc_id % 10 <> 5) AS stale, count(*) FILTER (WHERE doc_id % 10 = 5) AS fresh FROM catalog""",
    "st4_stream_upsert": f"{C} SELECT original_id, concat('new ', title) AS title, false AS is_stale FROM catalog WHERE doc_id % 2 = 0 UNION ALL SELECT original_id, title, true FROM catalog WHERE doc_id % 2 = 1",
    "st3_stream_dedupe": "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_id FROM events) GROUP BY 1",
    "n11_union": "SELECT record_kind, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT record_kind FROM ({sql})" for sql in (N_CKAN, N_ODS, N_STAC)) + ") GROUP BY 1",
    "n11_union_all": "SELECT source_portal, record_kind, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT source_portal, record_kind FROM ({sql})" for sql in NORMALIZED.values()) + ") GROUP BY ALL",
}
