"""All registered queries of the catalog engine: each operator over tables derived from the given ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import variants as V
from lodestar.functions.html import html_to_text
from lodestar.operators import curate, dedupe, normalize, quality, redact, resources, runlog, search, store
from lodestar.plans import fixtures, payload_fixtures
from lodestar.plans.sql import SQL
from lodestar.sources import catalog as scans
from lodestar.sources import payloads, sinks, xml
from lodestar.streaming import ingest, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ROW = ["id", "original_id", "source_portal", "title", "last_updated_at", "is_stale"]
NOW = "timestamp'2026-06-01 00:00:00'"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder in the folder that all executors share; only a local session without one gets its own."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4()}"


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.with_canonical_portal(fixtures.catalog(spark, d), fixtures.portals(spark, d))


def _snapshot(spark: SparkSession, d: str, *, resource_lists: bool = False) -> DataFrame:
    return curate.snapshot_rows(fixtures.catalog(spark, d), fixtures.portals(spark, d), resource_lists=resource_lists)


def _resource_snapshot(spark: SparkSession, d: str) -> DataFrame:
    derived = resources.with_resources(fixtures.resource_payloads(spark, d))
    return derived.withColumn("resources", resources.summaries(F.col("resources")))


def _records(spark: SparkSession, d: str, family: str) -> DataFrame:
    return payloads.records(payload_fixtures.pages(spark, d, family), family)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_curated_portals(spark, sf_dir)


@query
def flagship_curated_portals(spark: SparkSession, d: str) -> DataFrame:
    """Curated rows and duplicate flags of each portal."""
    grouped = _snapshot(spark, d).groupBy("source_portal", "portal_name", "portal_type", "portal_profile")
    return grouped.agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("duplicates")).orderBy(F.col("n").desc(), "portal_name", "source_portal")


# sources


@query
def s1_scan_newest(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan(fixtures.catalog(spark, d), limit=50).select(ROW)


@query
def s2_bounded_list(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan(fixtures.catalog(spark, d), "https://src3.example.org", 10_000).select(ROW)


@query
def s3_get(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.catalog(spark, d)
    return scans.get(rows, F.lit(rows.agg(F.min("id")).first()[0])).select(ROW)


@query
def s4_portal_hashes(spark: SparkSession, d: str) -> DataFrame:
    return scans.hashes(fixtures.catalog(spark, d), F.lit("https://src2.example.org/"))


@query
def s5_ckan_declared(spark: SparkSession, d: str) -> DataFrame:
    return payloads.declared_count(payload_fixtures.pages(spark, d, "ckan"), "ckan").select("page", "declared")


@query
def s7_dataset_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "dcat").where(payloads.is_dataset_node(F.col("node"))).groupBy("page").agg(F.count("*").alias("datasets"))


@query
def s14_count_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """The distinct pairs of counts; s14_mismatching_pages has the pages."""
    return s14_mismatching_pages(spark, d).select("portal_url", "declared", "parsed").distinct()


@query
def s14_mismatching_pages(spark: SparkSession, d: str) -> DataFrame:
    return normalize.count_mismatches(xml.csw_counts(payload_fixtures.csw_pages(spark, d)))


@query
def s15_identity(spark: SparkSession, d: str) -> DataFrame:
    return scans.identity(fixtures.previous(spark, d)).select("source_portal", "original_id", "content_hash")


@query
def s15_collisions(spark: SparkSession, d: str) -> DataFrame:
    return scans.collisions(fixtures.previous(spark, d))


@query
def s17_portals(spark: SparkSession, d: str) -> DataFrame:
    """Enabled portals, and why an entry isn't valid: each seventh has a profile, each fifth an endpoint of either kind."""
    i = F.col("config_index")
    options = {"profile": F.when(i % 7 == 0, "udata").otherwise(F.col("profile")), "sparql_endpoint": F.when(i % 5 == 1, "https://s"), "ogc_endpoint": F.when(i % 5 == 2, "https://o")}
    portals = fixtures.portals(spark, d).withColumns(options)
    bad = runlog.invalid_portals(portals).select("url", "reason")
    return portals.where("enabled").join(bad, "url", "left").select("name", "url", "type", "profile", "language", "reason")


def _written_snapshot(spark: SparkSession, d: str) -> str:
    folder = _shared(spark, "snapshot")
    sinks.write_snapshot(fixtures.catalog(spark, d), fixtures.portals(spark, d), folder, "2026-06-01")
    return folder


FILE = "path string, kind string, row_count bigint, size_bytes bigint, sha256 string"


@query
def s18_snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Writes a snapshot folder; for each of its data sets the rows of its files, and whether sizes, checksums and the snapshot's id are those of the files as they lie there."""
    folder = _written_snapshot(spark, d)
    listed = spark.read.schema(f"files array<struct<{FILE.replace(' ', ':').replace(',:', ', ')}>>, snapshot_id string").json(f"{folder}/metadata.json")
    files = listed.select(F.inline("files"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    own = found.select(F.regexp_extract("path", r"/((all\.parquet|identity\.parquet|by_portal)/.*)$", 1).alias("path"), F.col("length"), F.sha2("content", 256).alias("sum"))
    both = files.join(own, "path", "full")
    name = F.coalesce(F.nullif(F.regexp_extract("path", "^by_portal/portal_file=([^/]+)/", 1), F.lit("")), F.col("kind"))
    same = (F.col("length") == F.col("size_bytes")) & (F.col("sum") == F.col("sha256"))
    parts = both.where("kind = 'canonical'").agg(F.array_join(F.sort_array(F.collect_list("sum")), "\n").alias("parts")).join(listed, F.lit(True))
    kept = parts.select((F.concat(F.lit("snapshot-2026-06-01-"), F.substring(F.sha2("parts", 256), 1, 12)) == F.col("snapshot_id")).alias("id_agrees"))
    return both.groupBy("kind", name.alias("data")).agg(F.sum("row_count").alias("rows"), F.coalesce(F.bool_and(same), F.lit(False)).alias("files_agree")).join(kept, F.lit(True))


@query
def k4_snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all.parquet as written, each with its position: newest first."""
    return scans.with_positions(spark, f"{_written_snapshot(spark, d)}/all.parquet").drop("resources")


@query
def k5_portal_files(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each portal's files as written, and those that lie in another portal's."""
    rows = spark.read.parquet(f"{_written_snapshot(spark, d)}/by_portal")
    return rows.groupBy("portal_file").agg(F.count("*").alias("rows"), F.count_if(X.file_name(F.col("portal_name")) != F.col("portal_file")).alias("strays"))


@query
def k6_identity(spark: SparkSession, d: str) -> DataFrame:
    """The identity file as written: keys, hashes and positions."""
    return spark.read.parquet(f"{_written_snapshot(spark, d)}/identity.parquet")


@query
def k7_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's counts of rows and of each portal, as written."""
    portal = "struct<source_portal:string,portal_name:string,portal_type:string,portal_profile:string,n:bigint,file:string>"
    schema = f"schema_version string, canonical_file string, row_counts struct<raw:bigint,exported:bigint,filtered:bigint,duplicate_flagged:bigint>, portals array<{portal}>"
    found = spark.read.schema(schema).json(f"{_written_snapshot(spark, d)}/metadata.json")
    return found.select("canonical_file", "row_counts.*", F.explode("portals").alias("p")).select("canonical_file", "raw", "exported", "filtered", "duplicate_flagged", "p.*")


@query
def k8_reports(spark: SparkSession, d: str) -> DataFrame:
    """The reports' buckets and totals, as written."""
    schema = "coverage array<struct<dimension:string,bucket:string,n:bigint>>, totals struct<datasets:bigint,portals:bigint>, distinct_buckets struct<format:bigint,media_type:bigint>"
    found = spark.read.schema(schema).json(f"{_written_snapshot(spark, d)}/reports.json")
    return found.select("totals.*", "distinct_buckets.*", F.explode("coverage").alias("c")).select("datasets", "portals", "format", "media_type", "c.*")


@query
def k9_snapshot_changelog(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot, then another compared with the first: rows gone, changed and new, and repeats under a folded alias, of other hashes and newer, older or as old as what they repeat."""
    rows, portals = fixtures.catalog(spark, d), fixtures.portals(spark, d)
    first, second = _shared(spark, "snapshot"), _shared(spark, "snapshot")
    name = sinks.write_snapshot(rows, portals, first, "2026-06-01")["snapshot_id"]
    changed = F.when(F.col("doc_id") % 8 == 2, F.concat(F.lit("changed"), "content_hash")).otherwise(F.col("content_hash"))
    now = rows.where("doc_id % 9 <> 4").withColumn("content_hash", changed)
    added = rows.where("doc_id % 31 = 5").withColumn("original_id", F.concat("original_id", F.lit("n")))
    moved = F.expr("last_updated_at + make_dt_interval(0, cast(doc_id % 3 as int) - 1)")
    repeats = now.where("doc_id % 2 = 0 and source_portal like 'https://src0.example.org%'").withColumns({"source_portal": F.lit("https://src1.example.org"), "last_updated_at": moved, "content_hash": F.lit("repeat")})
    sinks.write_snapshot(now.unionByName(added).unionByName(repeats).repartition(5, "title"), portals, second, "2026-06-02", first)
    log = spark.read.schema("previous_snapshot_id string, portals array<struct<source_portal:string,added:bigint,changed:bigint,removed:bigint,unchanged:bigint>>").json(f"{second}/changelog.json")
    return log.select((F.col("previous_snapshot_id") == name).alias("compared_with_first"), F.explode("portals").alias("p")).select("compared_with_first", "p.*")


# sinks


@query
def k1_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines and read again."""
    folder = _shared(spark, "jsonl")
    sinks.write_jsonl(fixtures.catalog(spark, d), folder)
    schema = "id string, original_id string, title string, description string, first_seen_at string"
    return spark.read.schema(schema).json(folder)


@query
def k2_json_array(spark: SparkSession, d: str) -> DataFrame:
    """Written, its lines put together in the files' order and read as one array again; every element comes back."""
    folder = _shared(spark, "array")
    sinks.write_json_array(fixtures.catalog(spark, d), folder)
    lines = spark.read.text(folder)
    inner = lines.where("value not in ('[', ']')").select(F.endswith("value", F.lit(",")).alias("comma"), F.from_json(F.regexp_replace("value", ",$", ""), "id string, original_id string, title string, description string, last_updated_at string").alias("r"))
    return inner.select("r.*", "comma")


@query
def k3_csv(spark: SparkSession, d: str) -> DataFrame:
    return sinks.csv_rows(fixtures.catalog(spark, d))


@query
def k5_file_collisions(spark: SparkSession, d: str) -> DataFrame:
    return sinks.file_collisions(_snapshot(spark, d))


# normalisation


def _normalized(name: str, rows: Callable[[SparkSession, str], DataFrame]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rows(spark, d).drop("metadata", "modified")

    run.__name__ = name
    query(run)


for _name, _family in (("n1_ckan", "ckan"), ("n2_dcat", "dcat"), ("n3_sparql", "sparql"), ("n4_data_json", "data_json"), ("n5_socrata", "socrata"), ("n6_opendatasoft", "opendatasoft"), ("n7_arcgis", "arcgis"), ("n8_stac", "stac")):
    _normalized(_name, lambda spark, d, family=_family: normalize.FAMILIES[family](_records(spark, d, family)))
_normalized("n9_sdmx", lambda spark, d: normalize.sdmx(xml.dataflows(payload_fixtures.sdmx_pages(spark, d))))
_normalized("n10_csw", lambda spark, d: normalize.csw(xml.csw_records(payload_fixtures.csw_pages(spark, d))))


#: For each family a value of the metadata that its records have.
PROBES = {
    "ckan": "$.metadata_modified", "data_json": "$.modified", "socrata": "$.resource.name", "opendatasoft": "$.metas.default.title", "arcgis": "$.properties.title", "stac": "$.assets.a.title",
    "dcat": "$.distributions[0].downloadURL['@id']", "sparql": "$.title.value", "sdmx": "$.names.en", "ogc_records": "$.online_resources[0].url",
}


@query
def n_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What n1-n10 leave out: time of change of every family's records, a value of their metadata, and its number of fields."""
    out = None
    for family, path in PROBES.items():
        rows = normalize.FAMILIES[family](_family_records(spark, d, family)).withColumn("m", V.parsed(F.col("metadata")))
        fields = F.size(F.try_variant_get("m", "$", V.Entry))
        each = rows.select(F.lit(family).alias("family"), "original_id", "modified", F.try_variant_get("m", path, "string").alias("value"), fields.alias("fields"))
        out = each if out is None else out.unionByName(each)
    return out


@query
def n9_sdmx_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Dataflows with a landing-page template; their references and annotations."""
    pages = payload_fixtures.sdmx_pages(spark, d).withColumn("url_template", F.lit("https://t.example.org/{agency}/{id}?v={version}&f={flow_ref}"))
    m = V.parsed(F.col("metadata"))
    paths = {"version": "$.sdmx.version", "structure": "$.sdmx.data_structure.id", "data_url": "$.sdmx.data_url", "structure_url": "$.sdmx.structure_url", "kind": "$.catalog_record_kind", "note": "$.annotations[0].type", "fr": "$.names.fr", "modified": "$.modified"}
    return normalize.sdmx(xml.dataflows(pages)).select("original_id", "url", *[F.try_variant_get(m, p, "string").alias(k) for k, p in paths.items()])


def _family_records(spark: SparkSession, d: str, family: str) -> DataFrame:
    if family == "sdmx":
        return xml.dataflows(payload_fixtures.sdmx_pages(spark, d))
    return xml.csw_records(payload_fixtures.csw_pages(spark, d)) if family == "ogc_records" else _records(spark, d, family)


@query
def n11_union(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize.union({f: _records(spark, d, f) for f in ("ckan", "opendatasoft", "stac")})
    return rows.groupBy("record_kind").agg(F.count("*").alias("n"))


@query
def n11_union_all(spark: SparkSession, d: str) -> DataFrame:
    """The union of all families, XML ones included."""
    rows = normalize.union({f: _family_records(spark, d, f) for f in normalize.FAMILIES})
    return rows.groupBy("source_portal", "record_kind").agg(F.count("*").alias("n"))


@query
def w2_first_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page comes once more at the end of the run, in another language: of each id the first page's record stays."""
    out = None
    for family in ("socrata", "opendatasoft", "arcgis"):
        pages = payload_fixtures.pages(spark, d, family)
        again = pages.withColumns({"page": F.col("page") + 1_000_000, "language": F.lit("fr")})
        rows = normalize.FAMILIES[family](payloads.records(pages.unionByName(again), family)).drop("metadata", "modified")
        out = rows if out is None else out.unionByName(rows)
    return out


# filters and projections


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.with_duplicate_flag(_canonical(spark, d))


@query
def f1_noise(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.catalog(spark, d).select("original_id", curate.is_noise(F.col("title"), F.col("description")).alias("noise"))


@query
def f2_searchable(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.catalog(spark, d).where(curate.is_searchable()).select("original_id")


@query
def f3_pending(spark: SparkSession, d: str) -> DataFrame:
    return search.pending(fixtures.catalog(spark, d), 100).select("original_id", "record_kind")


@query
def f4_pending_count(spark: SparkSession, d: str) -> DataFrame:
    return search.pending_count(fixtures.catalog(spark, d))


@query
def f5_enabled(spark: SparkSession, d: str) -> DataFrame:
    return runlog.enabled(fixtures.portals(spark, d)).select("name", "config_index")


@query
def f6_modified_since(spark: SparkSession, d: str) -> DataFrame:
    rows = curate.with_portal_facts(_canonical(spark, d), fixtures.portals(spark, d)).where("portal_type <> 'unknown'")
    modified = X.parsed_date(V.string_at(V.parsed(F.col("metadata")), "metadata_modified"))
    kept = rows.where(curate.modified_since(modified, F.expr("timestamp'2026-02-03 00:00:00'"), curate.policy_of(F.col("portal_type"))))
    return kept.select("original_id", F.col("portal_type").alias("type"))


@query
def f7_kinds(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("record_kind") == "map", "Model").when(F.col("record_kind") == "series", "collection").otherwise(F.col("record_kind"))
    return fixtures.catalog(spark, d).select("original_id", curate.kind_of_scope(code).alias("by_scope"), curate.stored_kind(F.col("record_kind")).alias("stored"))


@query
def f8_redacted(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    secret = F.when(doc % 2 == 0, F.lit(',"list":[{"API_key":"x","secret_1":{"a":1}}],"Password":null')).otherwise("")
    rows = fixtures.read(spark, d, "documents").select("doc_id", F.concat(F.lit('{"doc":'), doc.cast("string"), secret, F.lit("}")).alias("metadata"))
    pattern = "(?i)api_key|secret_|password"
    clean = rows.withColumn("clean", redact.deep(F.col("metadata"), ["api_key", "secret_*", "password"]))
    return clean.select("doc_id", F.col("metadata").rlike(pattern).cast("int").alias("had_secret"), F.col("clean").rlike(pattern).cast("int").alias("has_secret"), F.contains("clean", F.lit('"doc"')).cast("int").alias("keeps_doc"))


@query
def f8_redacted_json(spark: SparkSession, d: str) -> DataFrame:
    """The redacted JSON itself: keys with escapes, numbers as written, white space, nesting of a thousand lists, and broken texts."""
    doc = F.col("doc_id").cast("string")
    cases = [
        F.concat(F.lit('{"a":1.50, "API_KEY":[{"x":"}"}], "b": {"Secret_'), doc, F.lit('":"\\\\","c":[1e400,-0.0,{"password" : null}]}}')),
        F.concat(F.lit('{"passwor\\u0064":1,"n":'), doc, F.lit(', "password2":"kept \\ud800"}')),
        F.concat(F.repeat(F.lit("["), F.lit(1500)), F.lit('{"secret_":'), doc, F.lit(',"k":"password"}'), F.repeat(F.lit("]"), F.lit(1500))),
        F.concat(F.lit('{"api_key":1,}'), doc),
    ]
    case = F.element_at(F.array(*cases), (F.col("doc_id") % 4 + 1).cast("int"))
    return fixtures.read(spark, d, "documents").select("doc_id", redact.deep(case, ["api_key", "secret_*", "password"]).alias("metadata"))


@query
def p1_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d).drop("portal_type", "portal_profile", "content_hash")


@query
def p3_details(spark: SparkSession, d: str) -> DataFrame:
    shown = redact.details(fixtures.catalog(spark, d), ["doc", "license*"])
    m = V.parsed(F.col("metadata"))
    parts = [F.concat_ws(",", F.map_keys(F.try_variant_get(m, "$", "map<string,variant>"))).alias("keys"), V.string_at(m, "language").alias("language"), V.string_at(m, "organization.name").alias("organization")]
    return shown.select("id", "original_id", "title", "record_kind", *parts)


@query
def p4_schema(spark: SparkSession, d: str) -> DataFrame:
    full = resources.with_resources(fixtures.resource_payloads(spark, d))
    rows = full.select("original_id", F.explode_outer("resources").alias("r")).where("r is not null")
    fields = F.array_join(F.transform("r.fields", lambda f: F.concat_ws(":", f["name"], f["type"])), ",")
    return rows.select("original_id", "r.name", "r.format", "r.media_type", "r.url", "r.description", fields.alias("fields"))


# joins


@query
def j1_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("original_id", "canonical_portal")


@query
def j2_portal_facts(spark: SparkSession, d: str) -> DataFrame:
    return curate.with_portal_facts(_canonical(spark, d), fixtures.portals(spark, d)).select("original_id", "portal_name", "portal_language", "portal_type", "portal_profile")


@query
def j4_duplicate_flag(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("original_id", "is_duplicate")


@query
def j8_distributions(spark: SparkSession, d: str) -> DataFrame:
    found = normalize.with_distributions(_records(spark, d, "dcat"))
    iri = F.try_variant_get("node", "$['@id']", "string")
    return found.select(iri.alias("iri"), F.size("distributions").alias("n"), F.col("distributions")[0].alias("first"), F.col("distributions")[1].alias("second"))


def _distributions(spark: SparkSession, d: str) -> DataFrame:
    return normalize.distributions(payloads.records(payload_fixtures.distribution_pages(spark, d), "sparql"))


@query
def j9_attached(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize.attach_distributions(normalize.sparql(_records(spark, d, "sparql")), _distributions(spark, d))
    listed = V.list_of(F.try_variant_get(V.parsed(F.col("metadata")), "$['dcat:distribution']", "variant"))
    return rows.select("original_id", F.size(listed).alias("n"))


@query
def j10_portal_list(spark: SparkSession, d: str) -> DataFrame:
    return runlog.portal_list(fixtures.portals(spark, d), runlog.sync_status(fixtures.jobs(spark, d)), fixtures.catalog(spark, d))


@query
def j11_excluded(spark: SparkSession, d: str) -> DataFrame:
    return quality.excluded_portals(fixtures.portals(spark, d), _snapshot(spark, d))


@query
def j14_touch(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.catalog(spark, d)
    return store.touch(rows, rows.where("doc_id % 4 = 0"), F.expr(NOW)).select("original_id", "last_updated_at", "is_stale")


# aggregations


@query
def a1_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.stats(fixtures.catalog(spark, d))


@query
def a2_duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_titles(_canonical(spark, d))


@query
def a3_by_status(spark: SparkSession, d: str) -> DataFrame:
    return runlog.by_status(fixtures.jobs(spark, d))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return store.with_outcome(fixtures.catalog(spark, d), scans.identity(fixtures.previous(spark, d)))


@query
def a4_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return store.outcome_counts(_outcomes(spark, d))


@query
def u10_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return store.dry_run(fixtures.catalog(spark, d), scans.identity(fixtures.previous(spark, d)))


@query
def a5_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return runlog.batch_summary(fixtures.jobs(spark, d))


@query
def a7_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(_snapshot(spark, d))


@query
def a8_resource_buckets(spark: SparkSession, d: str) -> DataFrame:
    return quality.resource_buckets(_resource_snapshot(spark, d))


@query
def a9_resource_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.resource_quality(_resource_snapshot(spark, d))


@query
def a9_portal_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Formats and media types of each portal's resources, largest first."""
    place = F.row_number().over(Window.partitionBy("source_portal", "facet").orderBy(F.col("n").desc(), "bucket"))
    return quality.portal_buckets(_resource_snapshot(spark, d)).withColumn("pos", place.cast("bigint") - 1)


@query
def a9_portal_top_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The largest format and media type of each portal, and what the others make; the sizes are written, as in a snapshot, so that resources are derived once."""
    folder = _shared(spark, "buckets")
    quality.portal_buckets(_resource_snapshot(spark, d)).write.parquet(folder)
    return quality.portal_top_buckets(spark.read.parquet(folder), 1)


@query
def a10_completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.completeness(_snapshot(spark, d, resource_lists=True))


@query
def a11_curation(spark: SparkSession, d: str) -> DataFrame:
    return quality.curation(_flagged(spark, d), curate.is_noise(F.col("title"), F.col("description")))


@query
def a12_changelog(spark: SparkSession, d: str) -> DataFrame:
    return store.changelog(store.changes(fixtures.catalog(spark, d), scans.identity(fixtures.previous(spark, d))))


@query
def a14_distributions(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d).select("uri", "node_iri", "json")


@query
def a15_publishers(spark: SparkSession, d: str) -> DataFrame:
    return normalize.publishers(_records(spark, d, "sparql"))


@query
def a15_dataset_count(spark: SparkSession, d: str) -> DataFrame:
    return normalize.dataset_count(_records(spark, d, "sparql"))


@query
def a17_update_dates(spark: SparkSession, d: str) -> DataFrame:
    return normalize.sdmx(xml.dataflows(payload_fixtures.sdmx_pages(spark, d))).select("original_id", "modified")


@query
def a18_alias_groups(spark: SparkSession, d: str) -> DataFrame:
    return quality.alias_groups(fixtures.portals(spark, d))


@query
def w1_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.skipped(fixtures.previous(spark, d), store.KEY)


# search, sorts


@query
def t2_search(spark: SparkSession, d: str) -> DataFrame:
    asked = fixtures.read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = search.search(fixtures.catalog(spark, d), asked)
    return found.select("query_id", "rank", "id", "title", "record_kind", F.round(F.col("similarity_score").cast("double"), 4).alias("score"))


@query
def t6_top_buckets(spark: SparkSession, d: str) -> DataFrame:
    return quality.top_buckets(_snapshot(spark, d).groupBy(F.col("portal_name").alias("bucket")).agg(F.count("*").alias("n")))


@query
def t7_recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return runlog.recent(fixtures.jobs(spark, d), "failed").select("id", "portal_url", "status", "created_at")


@query
def t10_config_order(spark: SparkSession, d: str) -> DataFrame:
    return runlog.in_config_order(runlog.sync_status(fixtures.jobs(spark, d)), fixtures.portals(spark, d)).select("name", "config_index", "sync_status", "datasets_synced")


# functions


@query
def x_urls(spark: SparkSession, d: str) -> DataFrame:
    """X3, X4, X5, X8, X11, X12, X16."""
    return fixtures.catalog(spark, d).select(
        "original_id", X.without_trailing_slashes(F.col("source_portal")).alias("trimmed"), X.portal_name(F.col("source_portal")).alias("portal_name"), X.file_name(F.col("title")).alias("file_name"),
        X.last_segment(F.concat("url", F.lit("//"))).alias("last_segment"), X.url_scheme(F.col("url")).alias("scheme"), X.is_safe_iri(F.col("url")).alias("safe"), X.is_url(F.col("url")).alias("valid"),
    )


@query
def x1_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.read(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query
def x1_html_cases(spark: SparkSession, d: str) -> DataFrame:
    """Tags with quoted signs, comparisons, comments, scripts, cut tags and inline tags around each page's id."""
    i = F.col("page_id").cast("string")
    case = F.concat(
        F.lit("<head><title>no</title></head><body><p class=a title=\"x>y\">"), i, F.lit("</p>a < b and c > d<!-- > "), i, F.lit(" -->&lt;b&gt;&amp;lt; w<b>o</b>rd<br/>"),
        F.lit("<script>if (a</b/.test(x)) '<p>'</script ><a href='>'>"), i, F.lit("</a>&#233;&eacute &notit; &#x41;<?php echo > 1 ?>\u00a0\n x<i\ndata-x = \"</i>\">y</i> <img alt="), i,
    )
    return fixtures.read(spark, d, "pages").select("page_id", html_to_text(case).alias("text"))


@query
def x2_non_blank(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions, blank and null ones among them, between signs of white space."""
    around = F.concat(F.lit("\u3000 \t"), F.coalesce("description", F.lit("\u00a0")), F.lit(" \n\u2003"))
    return fixtures.catalog(spark, d).select("original_id", X.non_blank(around).alias("description"), X.non_blank(F.col("description")).alias("plain"))


@query
def x6_formats(spark: SparkSession, d: str) -> DataFrame:
    uri = F.concat(F.lit("http://types.example.org/"), "p_brand", F.lit("/"))
    return fixtures.read(spark, d, "part").select("p_partkey", X.short_format(F.col("p_name")).alias("plain"), X.short_format(uri).alias("short"))


@query
def x7_protocols(spark: SparkSession, d: str) -> DataFrame:
    forms = ["OGC:WFS-1.1.0", "OGC Web Map Tile Service", " image/png; mode=24bit", "WWW:LINK-1.0-http--link", "http://www.opengis.net/csw/2.0", "unknown"]
    protocol = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return fixtures.read(spark, d, "part").select("p_partkey", X.protocol_format(protocol).alias("format"), X.protocol_media_type(protocol).alias("media_type"))


@query
def x10_urns(spark: SparkSession, d: str) -> DataFrame:
    urn = F.concat(F.lit("urn:sdmx:org.sdmx.infomodel.datastructure.Dataflow=AG"), "s_nationkey", F.lit(":F"), "s_suppkey", F.lit("(1.0)"))
    return fixtures.read(spark, d, "supplier").select("s_suppkey", *[X.urn_part(urn, p).alias(p) for p in ("agency", "id", "version")])


@query
def d_dates(spark: SparkSession, d: str) -> DataFrame:
    ts, e = F.date_trunc("second", "ts"), F.col("event_id")
    form = F.when(e % 4 == 0, "yyyy-MM-dd'T'HH:mm:ss'Z'").when(e % 4 == 1, "yyyy-MM-dd").when(e % 4 == 2, "yyyy-MM-dd'T'HH:mm:ss'+0200'").otherwise("dd.MM.yyyy")
    return fixtures.read(spark, d, "events").select("event_id", X.parsed_date(F.call_function("date_format", ts, form), bare_offset=True).alias("parsed"), X.csv_time(ts).alias("csv_time"), X.from_millis(F.unix_millis(ts)).alias("from_millis"))


@query
def g1_hashes(spark: SparkSession, d: str) -> DataFrame:
    t, x = F.col("title"), F.col("description")
    return fixtures.catalog(spark, d).select("original_id", X.content_hash(t, x).alias("plain"), X.content_hash(t, x, F.col("language")).alias("with_language"))


@query
def g4_config_checksum(spark: SparkSession, d: str) -> DataFrame:
    return runlog.config_checksum(fixtures.portals(spark, d))


@query
def m_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = V.parsed(F.col("metadata"))
    return fixtures.catalog(spark, d).select("original_id", V.tags(m).alias("tags"), V.organization(m).alias("organization"), V.license_name(m).alias("license"), V.text_or_empty(m, "metadata_modified").alias("modified"))


@query
def m5_rates(spark: SparkSession, d: str) -> DataFrame:
    counted = fixtures.read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("part"), F.count("*").alias("whole"))
    return counted.select("o_custkey", X.rate(F.col("part"), F.col("whole")).alias("rate"))


def _joined(facets: DataFrame) -> DataFrame:
    return facets.select(*[F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in facets.dtypes])


@query
def y_socrata_facets(spark: SparkSession, d: str) -> DataFrame:
    return _joined(normalize.socrata_facets(_records(spark, d, "socrata")))


@query
def y_opendatasoft_facets(spark: SparkSession, d: str) -> DataFrame:
    return _joined(normalize.opendatasoft_facets(_records(spark, d, "opendatasoft")))


@query
def y_arcgis_facets(spark: SparkSession, d: str) -> DataFrame:
    return _joined(normalize.arcgis_facets(_records(spark, d, "arcgis")))


@query
def y4_socrata_columns(spark: SparkSession, d: str) -> DataFrame:
    json = F.when(F.col("o_orderkey") % 2 == 0, '{"columns_field_name":["c1"," ",""],"columns_name":["L1","L2"],"columns_datatype":["text"]}').otherwise('{"columns_field_name":["c1"],"columns_name":["c1"],"columns_datatype":["text",1]}')
    fields = F.transform(V.zipped_columns(V.parsed(json)), lambda f: F.concat_ws(":", f["name"], F.coalesce(f["type"], F.lit("null")), F.coalesce(f["description"], F.lit("null"))))
    return fixtures.read(spark, d, "orders").select("o_orderkey", F.array_join(fields, ",").alias("columns"))


def _named(spark: SparkSession, d: str, shapes: list[str]) -> tuple[DataFrame, Column]:
    """Customers, and a JSON shape for each in turn; %s stands for the customer's name."""
    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.col("c_custkey") % len(shapes) + 1).cast("int"))
    return fixtures.read(spark, d, "customer"), V.parsed(F.replace(shape, F.lit("%s"), F.col("c_name")))


@query
def l1_localized(spark: SparkSession, d: str) -> DataFrame:
    rows, v = _named(spark, d, ['"%s"', '{"en":"en %s","fr":"fr %s"}', '{"de":"de %s","en":"en %s","fr":""}', '{"it":"it %s","de":"de %s"}'])
    return rows.select("c_custkey", V.localized(v, F.lit("fr")).alias("name"))


@query
def l2_jsonld(spark: SparkSession, d: str) -> DataFrame:
    rows, v = _named(spark, d, ['"%s"', '{"@value":"value %s"}', '[{"@language":"en","@value":"en %s"},{"@language":"FR-be","@value":"fr %s"}]', '[{"@language":"de","@value":"de %s"},{"@language":"it","@value":"it %s"}]'])
    return rows.select("c_custkey", V.jsonld_text(v, F.lit("fr")).alias("name"))


@query
def l3_dcat_us(spark: SparkSession, d: str) -> DataFrame:
    rows, v = _named(spark, d, ['"%s"', '{"en":"en %s","fr":"fr %s"}', '{"aa":1,"de":"first %s"}', '[null,{"fr":"list %s"}]'])
    return rows.select("c_custkey", V.dcat_us_text(v, F.lit("fr")).alias("name"))


@query
def l4_language_map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    texts = F.when(k == 0, F.create_map(F.lit("en"), F.concat(F.lit("en "), "c_name"), F.lit("fr-BE"), F.concat(F.lit("fr "), "c_name")))
    texts = texts.when(k == 1, F.create_map(F.lit("de"), F.concat(F.lit("de "), "c_name"), F.lit("en"), F.concat(F.lit("en "), "c_name"))).otherwise(F.create_map(F.lit("it"), F.concat(F.lit("it "), "c_name"), F.lit("de"), F.concat(F.lit("de "), "c_name")))
    return fixtures.read(spark, d, "customer").select("c_custkey", V.language_text(texts, F.lit("fr")).alias("name"))


@query
def q1_first_text(spark: SparkSession, d: str) -> DataFrame:
    rows, v = _named(spark, d, ['{"a":" ","b":"%s"}', '{"a":{"@value":"v %s","@id":"i %s"}}', '{"a":[" ",{"@value":"a %s"}]}', '{"a":5}'])
    return rows.select("c_custkey", V.first_text(v, ["a", "b"]).alias("text"), V.first_reference(v, ["a", "b"]).alias("reference"))


@query
def q6_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    k, west = F.col("c_custkey") % 3, F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 90).cast("double"))
    lower, upper = F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(" -4")), F.when(k == 1, "5 6").otherwise("5 x")
    box = V.bounding_box(west, F.lit(1.0), F.lit(2.0), F.lit(3.0), lower, upper)
    return fixtures.read(spark, d, "customer").select("c_custkey", F.array_join(F.transform(box, lambda x: x.cast("int").cast("string")), ",").alias("box"))


# resources


@query
def r0_resources(spark: SparkSession, d: str) -> DataFrame:
    rows = resources.with_resources(fixtures.resource_payloads(spark, d))
    fields = F.aggregate("resources", F.lit(0).cast("bigint"), lambda s, r: s + F.size(r["fields"]))
    return rows.select("original_id", F.size("resources").cast("bigint").alias("resources"), fields.alias("fields"))


@query
def r_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shapes that describe a table, a service, assets or an endpoint instead of a list."""
    shapes = [
        '{"dataset_id":"d","metas":{"default":{"title":"ods title"}},"fields":[{"name":"a"},{"label":"no name"}],"resource":{"name":"x"},"attachments":[{"url":"%s"},{"description":"alone"},7]}',
        '{"resource":{"name":" sheet ","id":"abcd-1234"},"metadata":{"domain":"data.example.org"}}',
        '{"properties":{"orgId":null,"name":"svc","type":"Feature Service","url":"https://svc.example.org"}}',
        '{"stac_version":"1.0","assets":{"b":{"type":"text/csv","href":"https://x/b"},"a":{"title":"A","href":"https://x/a"}}}',
        '{"sdmx":{"agency_id":"AG","dataflow_id":"F","flow_ref":"AG,F,1","data_url":"https://sdmx/data"}}',
    ]
    json = F.element_at(F.array(*map(F.lit, shapes)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    orders = fixtures.read(spark, d, "orders").select("o_orderkey", F.replace(json, F.lit("%s"), F.col("o_orderkey").cast("string")).alias("metadata"))
    e = lambda c: F.coalesce(c, F.lit(""))
    one = lambda r: F.concat_ws("|", e(r["name"]), e(r["format"]), e(r["media_type"]), e(r["url"]))
    listed = F.array_join(F.transform("resources", one), ";")
    return resources.with_resources(orders).select("o_orderkey", listed.alias("resources"))


# mutations


@query
def u1_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.catalog(spark, d)
    none = F.lit(None).cast("array<float>")
    changed = rows.where("doc_id % 3 = 0").withColumn("title", F.concat(F.lit("new "), "title")).withColumn("embedding", none)
    added = rows.where("doc_id % 50 = 1").withColumn("original_id", F.concat(F.lit("added-"), "original_id")).withColumn("embedding", none)
    out = store.upsert(rows, changed.unionByName(added), F.expr(NOW))
    return out.select("original_id", "title", F.col("embedding").isNotNull().alias("embedded"), "first_seen_at", "last_updated_at", "is_stale")


@query
def u4_stale_by_time(spark: SparkSession, d: str) -> DataFrame:
    return store.stale_by_time(fixtures.catalog(spark, d), F.lit("https://src3.example.org"), F.expr("timestamp'2026-01-01 08:00:00'")).select("original_id", "is_stale")


@query
def u5_stale_by_exclusion(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.catalog(spark, d)
    portal = rows.where("source_portal = 'https://src4.example.org/'")
    return store.stale_by_exclusion(rows, portal.where("doc_id % 4 = 0"), portal).select("original_id", "is_stale", "change")


@query
def u6_sync_status(spark: SparkSession, d: str) -> DataFrame:
    jobs = fixtures.jobs(spark, d)
    last = F.max_by(F.struct("status", "sync_mode", "created"), F.struct("created_at", "id"))
    runs = jobs.where("status <> 'pending'").groupBy("portal_url").agg(F.max("created_at").alias("last_sync"), last.alias("r"))
    runs = runs.select("portal_url", "last_sync", F.col("r.status").alias("sync_status"), F.col("r.sync_mode").alias("mode"), F.col("r.created").alias("datasets_synced"))
    return store.upsert_sync_status(runlog.sync_status(jobs), runs)


@query
def u7_delta(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("original_id", "outcome")


@query
def u8_stale_gate(spark: SparkSession, d: str) -> DataFrame:
    cancelled, truncated = F.col("status") == "cancelled", F.col("status") == "failed"
    return fixtures.jobs(spark, d).select("id", store.stale_allowed(F.col("sync_mode"), cancelled, truncated, F.col("failed"), F.col("skipped")).alias("allowed"), store.final_status(cancelled, truncated).alias("final"))


@query
def u9_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    runs = fixtures.jobs(spark, d).select("portal_url", F.col("status").alias("sync_status"), F.col("created_at").alias("started_at"))
    plan = ingest.sync_plan(fixtures.portals(spark, d), runs, curate.policy_of(F.col("type")))
    return plan.select("name", "plan", "since")


@query
def u11_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.catalog(spark, d)
    todo = rows.where(curate.is_pending())
    out = search.write_back(rows, search.embed(todo, search.length_provider()), F.expr(NOW))
    first = F.when(F.size("embedding") == 8, F.round(F.col("embedding")[0].cast("double"), 4))
    return out.select("original_id", "record_kind", F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(0).alias("size"), first.alias("first"), "content_hash")


@query
def u12_dimension(spark: SparkSession, d: str) -> DataFrame:
    return search.dimension_errors(fixtures.catalog(spark, d), 64)


# run log


@query
def v1_harvest_status(spark: SparkSession, d: str) -> DataFrame:
    return runlog.harvest_status(fixtures.jobs(spark, d))


@query
def v3_portal_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = runlog.portal_stats(fixtures.portals(spark, d), runlog.sync_status(fixtures.jobs(spark, d)), fixtures.catalog(spark, d), "SRC5")
    return stats.select("name", "sync_status", "datasets")


@query
def v4_outcome(spark: SparkSession, d: str) -> DataFrame:
    return runlog.outcome(fixtures.jobs(spark, d))


@query
def v5_title_overlap(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.title_overlap(_canonical(spark, d))


# streaming


@query
def st3_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, repeats dropped within the watermark, counted after the run.

    events.parquet is a file or a folder of part files in any order, so the watermark's
    delay is the spread of the data's times: no event is late.
    """
    folder, out = _shared(spark, "stream"), _shared(spark, "deduplicated")
    events = fixtures.read(spark, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(seconds), F.max(seconds)).first()
    single = all(f.rpartition("/")[2] == "events.parquet" for f in events.inputFiles())
    landed = ingest.landed(spark, d, events.schema, pattern="events.parquet") if single else ingest.landed(spark, f"{d}/events.parquet", events.schema)
    stream = landed.withColumn("ts", F.col("ts").cast("timestamp"))
    unique = ingest.without_repeats(stream, ["event_id", "user_id"], "ts", f"{(high or 0) - (low or 0) + 3600} seconds").select("event_id", "user_id")
    unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"))


@query
def st4_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST4-ST6: landed changes as a stream of upserts, then a complete run retires what wasn't seen."""
    rows = fixtures.catalog(spark, d)
    base, land, seen = _shared(spark, "catalog"), _shared(spark, "landed"), _shared(spark, "seen")
    table = ingest.Catalog(spark, base, merge_every=2)
    table.write(rows.drop("doc_id", "id", "language"), 0)
    columns = [*store.KEY, "url", "title", "description", "record_kind", "metadata", "content_hash", "embedding"]
    changed = rows.where("doc_id % 2 = 0").withColumn("title", F.concat(F.lit("new "), "title")).select(*columns)
    changed.repartition(4).write.parquet(land)
    stream = ingest.landed(spark, land, changed.schema, files_per_batch=2)
    query_ = ingest.run(stream, ingest.upsert_batch(table, seen, order=["content_hash"], now=F.expr(NOW)), _shared(spark, "progress"))
    final = ingest.finish(table, query_.lastProgress["batchId"] + 1, seen, complete=True)
    return store.stale_by_exclusion(final, spark.read.parquet(seen), final.select("source_portal")).select("original_id", "title", "is_stale")


@query
def st5_partial_run(spark: SparkSession, d: str) -> DataFrame:
    """A truncated stream with bad records: its good rows are kept, bad ones skipped, its status is partial and nothing is retired."""
    rows = fixtures.catalog(spark, d)
    land, seen = _shared(spark, "landed"), _shared(spark, "seen")
    table = ingest.Catalog(spark, _shared(spark, "catalog"))
    table.write(rows.drop("doc_id", "id", "language"), 0)
    bad = F.when(F.col("doc_id") % 10 == 0, F.lit(None)).otherwise(F.col("original_id"))
    landed = rows.where("doc_id % 5 = 0").withColumn("original_id", bad).select(*store.KEY, *store.VALUES)
    landed.repartition(3).write.parquet(land)
    done = ingest.run(ingest.landed(spark, land, landed.schema), ingest.upsert_batch(table, seen, order=["content_hash"], now=F.expr(NOW)), _shared(spark, "progress"))
    status = ingest.run_status(spark, seen, truncated=True)
    final = ingest.finish(table, done.lastProgress["batchId"] + 1, seen, complete=status.first()["may_retire"])
    at_now = F.col("last_updated_at").eqNullSafe(F.expr(NOW))
    before = table.read(0).where(at_now).select(*store.KEY, F.lit(True).alias("before"))  # rows that had the run's time already aren't fresh
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"b.{k}")) for k in store.KEY]
    marked = final.alias("f").join(before.alias("b"), same, "left")
    return status.join(marked.agg(F.count("*").alias("rows"), F.count_if("is_stale").alias("stale"), F.count_if(at_now & F.col("before").isNull()).alias("fresh")), F.lit(True))


@query
def st6_runs(spark: SparkSession, d: str) -> DataFrame:
    """ST5, ST6, U5: three runs over one checkpoint. The first ends for all portals, the second misses a quarter of the rows and ends for all but src2, the third brings no row and ends for src3."""
    rows = fixtures.catalog(spark, d)
    land, progress = _shared(spark, "landed"), _shared(spark, "progress")
    table = ingest.Catalog(spark, _shared(spark, "catalog"))
    table.write(rows, 0)
    of = lambda source: F.coalesce(F.col("source_portal").rlike(f"^https://{source}[.]"), F.lit(False))
    ends = rows.select("source_portal").distinct().withColumn("original_id", F.lit(None).cast("string"))
    seen = rows.select(*store.KEY, "doc_id")
    landed = [seen.where("doc_id % 10 <> 3").select(*store.KEY).unionByName(ends), seen.where("doc_id % 4 <> 1").select(*store.KEY).unionByName(ends.where(~of("src2"))), ends.where(of("src3"))]
    version = 0
    for number, events in enumerate(landed, 1):
        events.withColumn("run", F.lit(number).cast("bigint")).coalesce(1).write.mode("append").parquet(land)
        stream = ingest.landed(spark, land, spark.read.parquet(land).schema)
        done = runs.start(runs.changes(stream, rows, shares=4), runs.marks_batch(table, 0), progress)
        version = done.lastProgress["batchId"] + 1
    return table.read(version).select("original_id", "is_stale")
