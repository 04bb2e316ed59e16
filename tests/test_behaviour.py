"""Behaviours that the registered queries don't show: edge cases, files, streams."""

from __future__ import annotations

import hashlib
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import variants as V
from lodestar.functions.html import html_to_text, plain_text
from lodestar.operators import curate, dedupe, normalize, redact, resources, search, store
from lodestar.sources import catalog as scans
from lodestar.sources import payloads, sinks, xml
from lodestar.streaming import ingest, runs

CATALOG = "id string, original_id string, source_portal string, url string, title string, description string, record_kind string, metadata string, content_hash string, embedding array<float>, first_seen_at timestamp, last_updated_at timestamp, is_stale boolean"
PORTAL = "name string, url string, type string, profile string, language string, enabled boolean, aliases array<string>, config_index int"


def _row(key, portal, title, description="a description", stale=False, metadata="{}", content_hash="h"):
    from datetime import datetime

    t = datetime(2026, 1, 1)
    return (f"{portal}|{key}", key, portal, f"{portal}/{key}", title, description, "dataset", metadata, content_hash, None, t, t, stale)


def _value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("  a b ", "a b"), (" ", None), ("", None), (None, None)],
)
def test_non_blank(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(X.non_blank(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-01-02T03:04:05Z", "2026-01-02 03:04:05"), ("2026-01-02T03:04:05+0200", None), ("2026-01-02", "2026-01-02 00:00:00"), ("2026-13-02", None), ("soon", None), (None, None)],
)
def test_dates(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(X.parsed_date(F.col("t")).cast("string")).first()[0] == want


def test_portal_and_iri_helpers(spark):
    assert _value(spark, X.portal_name(F.col("u")), u="http://data.a.org/x") == "data-a-org"
    assert _value(spark, X.last_segment(F.col("u")), u="http://a/b//") == "b"
    assert _value(spark, X.is_safe_iri(F.col("u")), u="http://a/b c") is False
    assert _value(spark, X.is_safe_iri(F.col("u")), u="urn:a") is False
    assert _value(spark, X.is_four_by_four(F.col("u")), u="abcd-12345") is False


def test_present_null_hides_the_fallback(spark):
    read = lambda s: spark.createDataFrame([(s,)], "m string").select(V.organization(V.parsed(F.col("m")))).first()[0]
    assert read('{"organization":{"title":null,"name":"n"}}') == ""
    assert read('{"organization":{"name":"n"}}') == "n"
    assert read("no json") == ""


def test_duplicates_need_two_independent_portals(spark):
    portals = spark.createDataFrame([("a", "https://a", "ckan", None, "en", True, ["https://b/"], 0)], PORTAL)
    rows = spark.createDataFrame([_row("1", "https://a/", "Same"), _row("2", "https://b", "same"), _row("3", "https://a", "same")], CATALOG)
    flagged = lambda p: {r.is_duplicate for r in dedupe.with_duplicate_flag(dedupe.with_canonical_portal(rows, p)).collect()}
    assert flagged(portals) == {False}
    assert flagged(portals.withColumn("aliases", F.array().cast("array<string>"))) == {True}


def test_noise(spark):
    noise = lambda t, d="text": spark.createDataFrame([(t, d)], "t string, d string").select(curate.is_noise(F.col("t"), F.col("d"))).first()[0]
    assert not noise("éél!")  # six bytes
    assert noise("abc!")
    assert noise("A TEST of it")
    assert noise("long enough", "  ")
    assert noise("long enough", None)


def test_changelog_counts_one_each(spark):
    schema = "source_portal string, original_id string, content_hash string"
    previous = spark.createDataFrame([("p", "a", "1"), ("p", "b", "1"), ("p", "d", None)], schema)
    current = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "1")], schema)
    row = store.changelog(store.changes(current, previous)).first()
    assert (row.added, row.changed, row.removed, row.unchanged) == (1, 1, 1, 1)
    same = store.changes(previous.where("original_id = 'd'"), previous.where("original_id = 'd'")).first()
    assert same.change == "unchanged"


def test_upsert_keeps_embedding_and_first_seen(spark):
    old = spark.createDataFrame([_row("1", "p", "old", stale=True)], CATALOG).withColumn("embedding", F.array(F.lit(1.0).cast("float"))).drop("id")
    new = spark.createDataFrame([_row("1", "p", "new")], CATALOG)
    row = store.upsert(old, new, F.expr("timestamp'2026-05-05 00:00:00'")).first()
    assert (row.title, row.embedding, row.is_stale, str(row.first_seen_at)[:10], str(row.last_updated_at)[:10]) == ("new", [1.0], False, "2026-01-01", "2026-05-05")


def test_empty_seen_list_retires_all(spark):
    rows = spark.createDataFrame([_row("1", "p", "x"), _row("2", "q", "x")], CATALOG)
    out = store.stale_by_exclusion(rows, rows.where("false"), rows.where("source_portal = 'p'"))
    assert {r.source_portal: (r.is_stale, r.change) for r in out.collect()} == {"p": (True, "retired"), "q": (False, None)}


def test_resources_keep_only_informative_nodes(spark):
    metadata = {"resources": [{"description": "alone"}, {"name": "  ", "url": " "}, "text", {"format": {"@id": "http://x/file-type/CSV"}, "protocol": "OGC:WMS"}, {"protocol": "image/png; a=b"}]}
    rows = spark.createDataFrame([(json.dumps(metadata),), ("no json",), (None,)], "metadata string")
    found = [r.resources for r in resources.with_resources(rows).collect()]
    assert [(x.format, x.media_type) for x in found[0]] == [("CSV", None), (None, "image/png")]
    assert found[1:] == [[], []]


def test_bad_pages_are_set_aside(spark):
    pages = spark.createDataFrame([("p", "en", None, i, b) for i, b in enumerate(['{"collections":[{"id":"a"}]}', '{"collections":[{"id":"a"},{}]}', "<html>", '{"x":1}'])], "portal_url string, language string, url_template string, page int, body string")
    assert [r.page for r in payloads.bad_pages(pages, "stac").orderBy("page").collect()] == [1, 2, 3]


def test_records_without_required_fields_are_left_out(spark):
    body = {"dataset": [{"identifier": "a"}, {"identifier": "b", "title": " "}, {"identifier": "c", "title": "t", "landingPage": "nope"}]}
    pages = spark.createDataFrame([("https://p/", "en", None, 0, json.dumps(body))], "portal_url string, language string, url_template string, page int, body string")
    rows = normalize.data_json(payloads.records(pages, "data_json")).collect()
    assert [(r.original_id, r.url) for r in rows] == [("c", "https://p/")]


def test_best_language_does_not_depend_on_order(spark):
    one = lambda lang, t: {"dataset": {"type": "uri", "value": "https://d/1"}, "title": {"type": "literal", "xml:lang": lang, "value": t}}
    for order in (["de", "en", "nn"], ["nn", "en", "de"]):
        body = {"results": {"bindings": [one(x, f"title {x}") for x in order]}}
        pages = spark.createDataFrame([("https://p/", "nb", None, 0, json.dumps(body))], "portal_url string, language string, url_template string, page int, body string")
        assert normalize.sparql(payloads.records(pages, "sparql")).first().title == "title nn"


def test_xml_pages_that_do_not_parse(spark):
    pages = spark.createDataFrame([("p", "en", "<a"), ("p", "en", "<Other/>"), ("p", "en", None)], "portal_url string, language string, body string")
    assert {r.error is not None for r in xml.dataflows(pages).collect()} == {True}
    assert {r.error is not None for r in xml.csw_records(pages).collect()} == {True}


def test_each_page_of_a_wrong_count_is_reported(spark):
    page = lambda declared, n: f'<GetRecordsResponse><SearchResults numberOfRecordsReturned="{declared}">{"<Record/>" * n}</SearchResults></GetRecordsResponse>'
    bodies = [page(2, 1), page(2, 1), page(2, 2), page(50, 0), page(0, 0), "<a", page(2, 3)]
    pages = spark.createDataFrame([("p", "en", i, b) for i, b in enumerate(bodies)], "portal_url string, language string, page int, body string")
    counts = xml.csw_counts(pages)
    assert counts.count() == len(bodies)
    assert [r.page for r in counts.where("error is not null").collect()] == [5]
    assert {(r.page, r.declared, r.parsed) for r in normalize.count_mismatches(counts).collect()} == {(0, 2, 1), (1, 2, 1), (3, 50, 0), (6, 2, 3)}


def test_redaction_at_any_depth(spark):
    text = '{"a":[{"Secret_x":1,"keep":{"TOKEN":2,"b":3}}]}'
    got = spark.createDataFrame([(text,), ("no json",), (None,)], "m string").select(redact.deep(F.col("m"), ["secret_*", "token"]).alias("m")).collect()
    assert [r.m for r in got] == ['{"a":[{"keep":{"b":3}}]}', None, None]


def test_redaction_of_any_nesting(spark):
    deep = "[" * 100_000 + '{"token":1,"k":2}' + "]" * 100_000
    bad = ['{"a":1,}', "[1,]", "[,1]", '{"a" 1}', "{a:1}", "[1 2]", "[1]]", "]", "", '{"a":}', "01", "[1", '{"a":1', '"\x01"', '["\\x"]', "nul", '{"token":[}', '{"token":1 "b":2}', "{]", "[}"]
    good = {
        deep: deep.replace('"token":1,', ""), ' { "token" : {"x":[1]} , "b" : 1.0 } ': ' { "b" : 1.0 }', '{"b":1,"token":2}': '{"b":1}', '{"token":2}': "{}", '["token",{"TOKEN":1},{"t":"token"}]': '["token",{},{"t":"token"}]',
        "12345678901234567890.10": "12345678901234567890.10", '{"to\\u006ben":1,"x":"\\ud800"}': '{"x":"\\ud800"}', "[]": "[]", '{"a":{"token":{"token":1}},"secret_":[{"q":1}],"z":[]}': '{"a":{},"z":[]}',
    }
    texts = [*good, *bad]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, m string").select("i", redact.deep(F.col("m"), ["token", "secret_*"]).alias("m")).orderBy("i").collect()
    want = [w.rstrip(" ") for w in good.values()] + [None] * len(bad)
    assert [r.m for r in got] == want


def test_checksums_of_files_of_any_size(spark, tmp_path):
    sizes = {"some": 1000, "large": 100_000, "more than two gigabytes": (2 << 30) + 5}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as f:
            f.write(b"x" * min(size, 1000))
            f.truncate(size)
    got = {r.file: (r.bytes, r.sha256) for r in scans.files(spark, str(tmp_path), whole=1000).collect()}
    assert {k: v[0] for k, v in got.items()} == sizes
    for name in sizes:
        with open(tmp_path / name, "rb") as f:
            assert got[name][1] == hashlib.file_digest(f, "sha256").hexdigest()


def test_outcomes_of_every_batch(spark, tmp_path):
    rows = spark.createDataFrame([_row("1", "p", "x"), _row("2", "p", "y"), _row("1", "q", "z", content_hash=None)], CATALOG)
    table = ingest.Catalog(spark, str(tmp_path / "table"))
    table.write(rows, 0)
    told = []
    apply = ingest.upsert_batch(table, str(tmp_path / "seen"), order=["title"], now=F.current_timestamp(), report=told.append)
    batches = [
        [_row("1", "p", "x"), _row("2", "p", "new", content_hash="n"), _row("3", "p", "w"), _row("3", "p", "w"), _row("1", "q", "z")],
        [_row("3", "p", "w"), _row(None, "p", "bad"), _row("2", "p", "new", content_hash="n")],
    ]
    for number, batch in enumerate(batches):
        apply(spark.createDataFrame(batch, CATALOG), number)
    one = ingest.Outcome
    assert told == [[one(0, "p", 1, 1, 1, 1), one(0, "q", 0, 1, 0, 0)], [one(1, "p", 0, 0, 2, 1)]]


def test_texts_that_look_like_other_values(spark):
    """Strings count whatever they look like, other values don't, alone and beside plain nodes, in names, fields and all lists."""
    texts = ["2024 data", "5", "-1.5e3", "true", "{x}", "[y]", "a\n5", " plain "]
    docs, want = [], []
    for i, text in enumerate(texts):
        node = {"name": text, "format": "CSV", "schema": {"fields": [{"id": text, "type": text}]}}
        docs.append(json.dumps({"resources": [{"title": "t", "url": "https://x"}, node], "distribution": [{"title": text}]}))
        own = text.strip()
        want.append([("t", []), (own, [(own, own)]), (own, [])])
    for odd in (5, -0.5, True, None, {"a": 1}, {"@value": "v"}, [None, "w"], ["", {"@value": "v2"}]):
        docs.append(json.dumps({"resources": [{"title": "t", "url": "https://x"}, {"name": odd, "format": "CSV", "fields": [{"name": odd}, {"name": "f"}]}]}))
        own = {"{'@value': 'v'}": "v", "[None, 'w']": "w", "['', {'@value': 'v2'}]": "v2"}.get(str(odd))
        want.append([("t", []), (own, [(own, None)] * bool(own) + [("f", None)])])
    docs += ["[1]", "5", "{}", '{"resources":{}}', '{"resources":[1,"x",null]}', "no json"]
    want += [[]] * 6
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, metadata string")
    got = {r.i: [(x.name, [(f.name, f.type) for f in x.fields]) for x in r.resources] for r in resources.with_resources(rows).collect()}
    assert [got[i] for i in range(len(docs))] == want


def test_dimensions_are_sent_only_if_small(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    dimension = spark.range(10).select("id", F.repeat(F.lit("x"), F.lit(100)).alias("t"))
    join = lambda: plan(spark.range(5).join(dedupe.small(dimension), "id"))
    assert "strategy=broadcast" in join()
    monkeypatch.setattr(dedupe, "SMALL_BYTES", 1000)
    assert "strategy=broadcast" not in join()
    monkeypatch.setattr(dedupe, "SMALL_BYTES", 10_000)
    monkeypatch.setattr(dedupe, "SMALL_ROWS", 9)
    assert "strategy=broadcast" not in join()


def test_always_reprocess_policy(spark):
    known = spark.createDataFrame([_row("1", "p", "x"), _row("2", "p", "y", content_hash=None)], CATALOG)
    came = spark.createDataFrame([_row("1", "p", "x"), _row("2", "p", "y"), _row("3", "p", "z")], CATALOG)
    of = lambda **k: {r.original_id: r.outcome for r in store.with_outcome(came, known, **k).collect()}
    assert of() == {"1": "unchanged", "2": "updated", "3": "created"}
    assert of(always=True) == {"1": "updated", "2": "updated", "3": "created"}


def test_search_leaves_out_rows_without_vector(spark):
    rows = spark.createDataFrame([_row("1", "p", "x"), _row("2", "p", "y"), _row("3", "p", "z", stale=True)], CATALOG)
    vector = F.when(F.col("original_id") != "2", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    queries = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "query_id int, query array<float>")
    found = search.search(rows.withColumn("embedding", vector), queries).collect()
    assert {(r.query_id, r.id) for r in found} == {(0, "p|1"), (1, "p|1")}
    assert {r.query_id: r.similarity_score for r in found}[0] == pytest.approx(1)


def test_many_queries_give_the_same_result(spark, monkeypatch):
    vector = F.array(*[F.lit(float(i)) * F.length("title") + F.ascii("original_id") for i in range(3)]).cast("array<float>")
    rows = spark.createDataFrame([_row(str(i), "p", "x" * (i + 1)) for i in range(9)], CATALOG).withColumn("embedding", vector)
    asked = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(5)], "query_id int, query array<float>")
    want = sorted(map(tuple, search.search(rows, asked, 4).collect()))
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    assert sorted(map(tuple, search.search(rows, asked, 4).collect())) == want


def test_search_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (700, 4)).astype(float)
    rows = spark.createDataFrame([(*_row(str(i), "p", "x")[:9], v.tolist(), *_row("", "p", "x")[10:]) for i, v in enumerate(vectors)], CATALOG)
    rows = rows.unionByName(rows.limit(1).withColumns({"id": F.lit("p|none"), "embedding": F.array(F.lit(1.0).cast("float"), F.lit(None), F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))}))
    asked = [(q, rng.integers(-2, 3, 4).astype(float).tolist()) for q in range(5)] + [(5, [0.0] * 4), (6, [1.0, 2.0])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = search.search(rows, spark.createDataFrame(asked, "query_id int, query array<float>"), 40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, vector in asked[:6]:
        own = [(r.rank, r.id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q]
        norm = lambda v: float(np.sqrt((np.array(v) ** 2).sum()))
        score = [np.float32(v @ np.array(vector) / (norm(v) * norm(vector))) if norm(v) * norm(vector) else -np.inf for v in vectors]
        want = sorted([(-s, f"p|{i}") for i, s in enumerate(score)] + [(np.inf, "p|none")])[:40]
        assert own == [(k, i) for k, (_, i) in enumerate(want, 1)]
    assert not [r for r in found if r.query_id == 6]


def test_provider_must_answer_every_text(spark):
    rows = spark.createDataFrame([_row("1", "p", "x")], CATALOG)
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        search.embed(rows, search.Provider("none", 2, 10, lambda texts: np.zeros((0, 2)))).collect()
    with pytest.raises(Exception, match="instead of 3 components"):
        search.embed(rows, search.Provider("short", 3, 10, lambda texts: np.zeros((len(texts), 2)))).collect()
    calls = []
    many = search.Provider("counting", 1, 4, lambda texts: calls.append(len(texts)) or np.zeros((len(texts), 1)))
    assert many([str(i) for i in range(10)]).shape == (10, 1)
    assert calls == [4, 4, 2]


def test_snapshot_folder(spark, tmp_path):
    portals = spark.createDataFrame([("a", "https://a", "ckan", None, "en", True, [], 0), ("none", "https://none", "ckan", None, "en", True, [], 1)], PORTAL)
    rows = spark.createDataFrame([_row(str(i), "https://a", f"title {i}") for i in range(20)] + [_row("x", "https://a", "abc")], CATALOG)
    manifest = sinks.write_snapshot(rows, portals, str(tmp_path), "2026-01-01")
    assert manifest["row_counts"] == {"raw": 21, "exported": 20, "filtered": 1, "duplicate_flagged": 0}
    listed = {f["path"]: f for f in manifest["files"]}
    data = {str(f.relative_to(tmp_path)): f for f in tmp_path.rglob("*.parquet") if f.is_file()}
    assert set(listed) == set(data)
    assert all(listed[k]["sha256"] == hashlib.sha256(f.read_bytes()).hexdigest() and listed[k]["size_bytes"] == f.stat().st_size for k, f in data.items())
    rows_of = lambda kind: sum(f["row_count"] for f in manifest["files"] if f["kind"] == kind)
    assert (rows_of("canonical"), rows_of("portal"), rows_of("identity")) == (20, 20, 20)
    canonical = sinks.canonical_checksum([f["sha256"] for f in manifest["files"] if f["kind"] == "canonical"])
    assert manifest["snapshot_id"] == f"snapshot-2026-01-01-{canonical[:12]}"
    assert scans.previous_snapshot_id(spark, str(tmp_path)) == manifest["snapshot_id"]
    assert scans.previous_snapshot_id(spark, str(tmp_path / "missing")) is None
    document = lambda name: json.loads(spark.read.text(str(tmp_path / name), wholetext=True).first()[0])
    assert document("changelog.json")["compared"] is False
    assert document("reports.json")["curation"]["excluded_portals"] == ["none"]
    assert "| raw | 21 |" in spark.read.text(str(tmp_path / "report.md"), wholetext=True).first()[0]
    mirror = portals.where("name = 'a'").withColumn("aliases", F.array(F.lit("https://mirror")))
    both = rows.unionByName(rows.limit(3).withColumn("source_portal", F.lit("https://mirror"))).unionByName(spark.createDataFrame([_row("new", "https://a", "title new"), _row("new", "https://mirror", "title new")], CATALOG))
    again = sinks.write_snapshot(both, mirror, str(tmp_path / "second"), "2026-01-01", spark.read.parquet(f"{tmp_path}/identity.parquet"))
    assert again["row_counts"]["exported"] == 25
    assert again["warnings"] == ["4 rows repeat a key, of which the first counts"]
    assert document("second/changelog.json")["total"] == {"added": 1, "changed": 0, "removed": 0, "unchanged": 20}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_positions_are_those_of_the_files_order(spark, tmp_path, parts):
    rows = spark.createDataFrame([_row(str(i), "https://a", f"title {i}") for i in range(60)], CATALOG).repartition(parts, "title")
    rows = rows.withColumn("last_updated_at", F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, cast(original_id as int) % 20)"))
    curate.newest_first(rows).write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # tasks read parts of parts
    try:
        got = scans.with_positions(spark, str(tmp_path / "rows")).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.pos for r in got] == list(range(60))
    assert [(r.last_updated_at, r.id) for r in got] == sorted(((r.last_updated_at, r.id) for r in got), key=lambda x: (-x[0].timestamp(), x[1]))


@pytest.mark.parametrize("parts", [1, 4])
def test_changelog_compares_the_newest_of_repeats(spark, tmp_path, parts):
    portals = spark.createDataFrame([("a", "https://a", "ckan", None, "en", True, ["https://mirror"], 0)], PORTAL)
    times = {"https://a": ("2026-01-02", "2026-01-01"), "https://mirror": ("2026-01-01", "2026-01-02")}

    def snapshot(name, hashes, previous=None):
        data = spark.createDataFrame([_row(str(i), portal, f"title {i}") for i in range(2) for portal in times], CATALOG)
        stamp = F.element_at(F.create_map(*[F.lit(x) for (p, t) in times.items() for i in range(2) for x in (f"{p} {i}", t[i])]), F.concat_ws(" ", "source_portal", "original_id"))
        value = F.element_at(F.create_map(*[F.lit(x) for p, h in hashes.items() for x in (p, h)]), F.col("source_portal"))
        data = data.withColumns({"last_updated_at": F.to_timestamp(stamp), "content_hash": value}).repartition(parts, "title", "source_portal")
        sinks.write_snapshot(data, portals, str(tmp_path / name), "2026-01-01", previous)
        return json.loads(spark.read.text(str(tmp_path / name / "changelog.json"), wholetext=True).first()[0])

    first = snapshot("first", {"https://a": "x", "https://mirror": "y"}, str(tmp_path / "none"))
    assert (first["compared"], first["previous_snapshot_id"], first["total"]["added"]) == (False, None, 0)
    # row 0 is newest on a, row 1 on the mirror: only row 1 changes with the mirror's hash
    second = snapshot("second", {"https://a": "x", "https://mirror": "z"}, str(tmp_path / "first"))
    assert second["total"] == {"added": 0, "changed": 1, "removed": 0, "unchanged": 1}
    assert second["previous_snapshot_id"] == first["snapshot_id"]
    assert "content_hash" in second["changed_definition"]


def test_reports_count_all_formats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_BUCKETS", 20)
    portals = spark.createDataFrame([("a", "https://a", "ckan", None, "en", True, [], 0)], PORTAL)
    nodes = [{"name": f"r{i}", "format": f"f{i}"} for i in range(5000)] + [{"name": "again", "format": "f7"}]
    rows = spark.createDataFrame([_row("1", "https://a", "title 1")], CATALOG).withColumn("metadata", F.lit(json.dumps({"resources": nodes})))
    sinks.write_snapshot(rows, portals, str(tmp_path), "2026-01-01")
    report = spark.read.text(str(tmp_path / "report.md"), wholetext=True).first()[0]
    assert "| 4985 more | |" in report and "| f7 | 2 |" in report
    top = spark.read.json(str(tmp_path / "portal_top_buckets.json")).where("facet = 'format'").orderBy("rank").collect()
    assert [(r.rank, r.n, r.more) for r in top] == [(1, 2, 0), *((i, 1, 0) for i in range(2, 16)), (16, 4985, 4985)]


def test_file_name_collision_fails(spark, tmp_path):
    portals = spark.createDataFrame([("A b", "https://a", "ckan", None, "en", True, [], 0), ("a-b", "https://b", "ckan", None, "en", True, [], 1)], PORTAL)
    rows = spark.createDataFrame([_row("1", "https://a", "title 1"), _row("2", "https://b", "title 2")], CATALOG)
    with pytest.raises(ValueError, match="share the file name"):
        sinks.write_snapshot(rows, portals, str(tmp_path), "2026-01-01")


def test_csv_quotes_only_where_needed(spark, tmp_path):
    rows = spark.createDataFrame([_row("1", "p", 'a "b", c'), _row("2", "p", "plain")], CATALOG)
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert '"a ""b"", c"' in text
    assert ",plain," in text


def test_incomplete_run_saves_rows_but_retires_none(spark, tmp_path):
    rows = spark.createDataFrame([_row("1", "p", "x"), _row("2", "p", "y")], CATALOG).drop("id")
    table = ingest.Catalog(spark, str(tmp_path / "table"))
    table.write(rows, 0)
    new = rows.where("original_id = '1'").withColumn("title", F.lit("new"))
    bad = new.withColumn("original_id", F.lit(None).cast("string"))
    new.unionByName(bad).write.parquet(str(tmp_path / "landed"))
    stream = ingest.landed(spark, str(tmp_path / "landed"), rows.schema, files_per_batch=100)
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    ingest.run(stream, ingest.upsert_batch(table, str(tmp_path / "seen"), order=["title"], now=F.current_timestamp()), str(tmp_path / "check"))
    for _ in range(100):  # events come a little later
        if progress.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert [number for number, n in progress.batches if n] == [0]
    status = ingest.run_status(spark, str(tmp_path / "seen"), truncated=True).first().asDict()
    assert status == {"status": "partial", "synced": 1, "skipped": 1, "failed": 0, "may_retire": False}
    state = lambda complete: {r.original_id: (r.title, r.is_stale) for r in ingest.finish(table, 1, str(tmp_path / "seen"), complete=complete).collect()}
    assert state(False) == {"1": ("new", False), "2": ("y", False)}
    assert state(True) == {"1": ("new", False), "2": ("y", True)}
    assert spark.read.parquet(str(tmp_path / "seen-quarantine")).count() == 1


def test_a_run_without_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([_row("1", "p", "x"), _row("2", "q", "y")], CATALOG)
    table = ingest.Catalog(spark, str(tmp_path / "table"))
    table.write(rows, 0)
    status = ingest.run_status(spark, str(tmp_path / "seen")).first().asDict()
    assert status == {"status": "completed", "synced": 0, "skipped": 0, "failed": 0, "may_retire": True}
    stale = lambda **k: {r.original_id: r.is_stale for r in ingest.finish(table, 0, str(tmp_path / "seen"), complete=True, **k).collect()}
    assert stale() == {"1": False, "2": False}
    assert stale(portals=spark.createDataFrame([("p",)], "source_portal string")) == {"1": True, "2": False}


def test_bytes_written_grow_with_the_batch(spark, tmp_path):
    """64 batches of one size: each row is written once for each size of runs, and old files are listed for removal."""
    import math
    import random

    start = spark.createDataFrame([_row(str(i), "p", f"title {i}") for i in range(200)], CATALOG)
    table = ingest.Catalog(spark, str(tmp_path / "t"), merge_every=3, buckets=1, least_bytes=16_000)
    table.write(start, 0)
    rng, want, written = random.Random(3), {str(i): f"title {i}" for i in range(200)}, 0
    own = []
    for n in range(64):
        batch = {str(rng.randrange(20_000)): "".join(rng.choice("abcdefghijklmnop") for _ in range(200)) for _ in range(60)}
        want |= batch
        table.apply(spark.createDataFrame([_row(k, "p", t) for k, t in batch.items()], CATALOG).coalesce(1), n, F.current_timestamp())
        here = {p: size for run in table.log(n + 1)["runs"] for files in run["files"].values() for p, size in files}
        before = {p for run in table.log(n)["runs"] for files in run["files"].values() for p, _ in files}
        own.append(sum(f.stat().st_size for f in (tmp_path / "t" / f"run={n + 1}").rglob("*.parquet")))
        written += own[-1] + sum(size for p, size in here.items() if p not in before and f"run={n + 1}/" not in p)
        assert len(table.log(n + 1)["runs"]) <= 3 * (2 + math.log(max(1, sum(own) / 16_000), 4))
    assert written <= sum(own) * (2 + math.log(64, 4))
    assert {r.original_id: r.title for r in table.read(64).collect()} == want
    gone = table.removable(64, 64)
    assert gone and not {p for run in table.log(64)["runs"] for files in run["files"].values() for p, _ in files} & set(gone)


def test_merges_leave_other_buckets_alone(spark, tmp_path):
    start = spark.createDataFrame([_row(str(i), "p", "old") for i in range(400)], CATALOG)
    table = ingest.Catalog(spark, str(tmp_path / "t"), merge_every=1, buckets=8, least_bytes=1 << 30)
    table.write(start, 0)
    table.apply(start.where("original_id = '7'").withColumn("title", F.lit("new")), 0, F.current_timestamp())
    files = [{p for run in table.log(v)["runs"] for own in run["files"].values() for p, _ in own} for v in (0, 1)]
    assert len(files[0] - files[1]) == 1 and len(files[0] & files[1]) == 7
    assert {r.original_id for r in table.read(1).where("title = 'new'").collect()} == {"7"}
    table.mark(spark.createDataFrame([("p", "7", True), ("p", "none", True)], "source_portal string, original_id string, is_stale boolean"), 1)
    assert [(r.original_id, r.title) for r in table.read(2).where("is_stale").collect()] == [("7", "new")]
    assert table.read(2).count() == 400


def test_runs_over_one_checkpoint(spark, tmp_path):
    """Ends retire what no run since has seen, also where a run brought nothing; late rows revive; other portals and the session's settings are left alone."""
    schema = "source_portal string, original_id string, run bigint"
    known = spark.createDataFrame([("p", "a", False), ("p", "b", True), ("p", "z", False), ("q", "x", False)], "source_portal string, original_id string, is_stale boolean")
    steps = [
        ([("p", "a", 1), ("p", "b", 1), ("p", "n", 1), ("p", "a", 1), ("p", None, 1)], {("b", "revived"), ("z", "retired"), ("n", "first")}),
        ([("p", "a", 2), ("p", "z", 1), ("p", None, 1)], {("z", "revived")}),
        ([("p", None, 2)], {("b", "retired"), ("z", "retired"), ("n", "retired")}),
        ([("q", None, 3)], {("x", "retired")}),
    ]
    before = spark.conf.get(runs.PROVIDER, None)
    for landed, want in steps:
        spark.createDataFrame(landed, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
        got = []
        stream = ingest.landed(spark, str(tmp_path / "land"), spark.createDataFrame([], schema).schema)
        runs.start(runs.changes(stream, known, shares=3), lambda batch, n, got=got: got.extend(batch.collect()), str(tmp_path / "check"))
        assert {(r.original_id, r.change) for r in got} == want and len(got) == len(want)
    assert spark.conf.get(runs.PROVIDER, None) == before


def test_observed_counts(spark):
    outcomes = spark.createDataFrame([("created",), ("updated",), ("created",)], "outcome string")
    rows, watch = ingest.observed(outcomes, "counts")
    rows.collect()
    assert (watch.get["rows"], watch.get["created"]) == (3, 2)


def test_stream_of_a_folder_of_late_files(spark, tmp_path):
    from lodestar.plans import registry

    for day in (9, 1, 5):  # the newest lands first, and event 0 comes again in each
        rows = spark.range(3).selectExpr(f"if(id = 0, 0, id + {10 * day}) AS event_id", f"timestamp'2026-01-01 00:00:00' + make_dt_interval({day}) AS ts", "1L AS user_id")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in registry.st3_stream_dedupe(spark, str(tmp_path)).collect()] == [(1, 7)]


def test_changes_fold_into_bases(spark, tmp_path):
    """Versions read from a base and changes equal plain upserts, whenever they are merged; a batch run again changes nothing."""
    from datetime import datetime, timedelta

    start = spark.createDataFrame([_row(str(i), "p", "old", stale=i == 1) for i in range(4)], CATALOG).drop("id")
    batches = [[("1", "a"), ("9", "b")], [("9", "c"), ("2", "d")], [], [("9", "e"), ("1", "f")], [("7", "g")]]
    tables = [ingest.Catalog(spark, str(tmp_path / str(n)), merge_every=n) for n in (1, 2, 16)]
    want = start
    for t in tables:
        t.write(start, 0)
    for n, batch in enumerate(batches):
        now = F.lit(datetime(2026, 2, 1) + timedelta(days=n))
        rows = spark.createDataFrame([_row(k, "p", title) for k, title in batch], CATALOG).withColumn("embedding", F.when(F.col("title").isin("b", "d"), F.array(F.lit(1.0).cast("float"))))
        want = store.upsert(want, rows, now)
        for t in tables:
            t.apply(rows, n, now)
            t.apply(rows, n, now)
            key = lambda df: sorted(str(r.asDict()) for r in df.select(sorted(df.columns)).collect())
            assert key(t.read(n + 1)) == key(want)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_times_do_not_depend_on_the_sessions_zone(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = F.timestamp_micros(F.col("m"))
        rows = spark.createDataFrame([(1_700_000_000_000_000,), (1_700_000_000_120_000,), (1_700_000_000_000_001,)], "m bigint").select(X.rfc3339(at), X.csv_time(at))
        assert [tuple(r) for r in rows.collect()] == [(f"2023-11-14T22:13:20{f}+00:00", "2023-11-14T22:13:20Z") for f in ("", ".120", ".000001")]
        assert _value(spark, X.rfc3339(X.parsed_date(F.col("t"))), t="2026-03-08") == "2026-03-08T00:00:00+00:00"
        assert _value(spark, X.rfc3339(X.parsed_date(F.col("t"))), t="2026-03-08T02:30:00-05:00") == "2026-03-08T07:30:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a title="x>y">z</a>', "z"), ("a < b and c > d", "a < b and c > d"), ("1<2", "1<2"), ("a<b>c</b>d", "acd"), ("<p>a</p>b<br>c", "a b c"), ("<li>one<li>two", "one two"),
        ("x<!-- > -- -->y<!-->z<!--a--!>b", "xyzb"), ("<script>a<b && '</p>'</script>t", "t"), ("<style>p>a{}</style >u", "u"), ("<SCRIPT>x</sCript\n>v", "v"), ("<script>never ended", ""),
        ("<p don't='a>b' x=y>q</p>", "q"), ("<p don't>q's</p>", "q's"), ('cut <a href="x>y', "cut"), ("cut <p", "cut"), ("cut <!-- x", "cut"), ("</ b>c", "c"), ("<>a</>", "<>a"), ("<!DOCTYPE html>d", "d"), ("<![CDATA[x]]>y", "y"),
        ("<title>a <b> c</title>", "a <b> c"), ("<head><title>t</title><body>b", "b"), ("&lt;p&gt;&amp;amp;", "<p>&amp;"), ("&am<i></i>p;", "&amp;"), ("\u3000 a\u00a0\n b ", "a b"), ("<a href=/x/>l</a>", "l"), ("<br/>a", "a"), ("", ""), ("<", "<"), ("<p a = 'x>'>w", "w"),
    ],
)
def test_html_tokens(html, want):
    assert plain_text(html) == want


def test_html_of_many_open_tags_is_linear(spark):
    began = time.perf_counter()
    assert plain_text("<a =\"" * 200_000) == plain_text("<!--" * 200_000) == plain_text("<p " * 200_000) == ""
    assert len(plain_text("<" * 200_000)) == 200_000 and len(plain_text("<b a='" + "x" * 10**6 + "'>y" * 1)) == 1
    assert time.perf_counter() - began < 5
    assert [r[0] for r in spark.createDataFrame([(None,), (" no  tag ",), ("<p>x",)], "h string").select(html_to_text(F.col("h"))).collect()] == [None, "no tag", "x"]


def test_entities(spark):
    import html

    texts = ["Caf&eacute; &#8217;s &#233; &#x41;&#X42;", "a &amp;lt; b && c &bogus; &", "&nbsp;x&nbsp;&nbsp;y", "&#146;&#0;&#55296;&#1114112;", "&copy 2020", "&equals;&semi;&NotEqualTilde;", "&", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, h string").orderBy("i").select(html_to_text(F.col("h"))).collect()]
    assert got == [" ".join(html.unescape(t).split()) for t in texts]


def test_options_change_the_config_checksum(spark):
    from lodestar.operators import runlog

    base = spark.createDataFrame([("a", "https://a", "ckan", None, "en", True, ["https://m"], 0)], PORTAL)
    other = [base.withColumn(c, v) for c, v in (("profile", F.lit("p")), ("language", F.lit("fr")), ("enabled", F.lit(False)), ("aliases", F.array().cast("array<string>")), ("sparql_endpoint", F.lit("https://s")))]
    sums = [runlog.config_checksum(x).first()[0] for x in (base, *other)]
    assert len(set(sums)) == 6
    assert runlog.config_checksum(base.withColumn("sparql_endpoint", F.lit(None).cast("string"))).first()[0] == sums[0]


def test_equal_language_ranks_go_to_the_last_binding(spark):
    one = lambda title, lang: '{"dataset":{"type":"uri","value":"https://x/d/1"},"title":{"type":"literal","value":"%s"%s}}' % (title, f',"xml:lang":"{lang}"' if lang else "")  # noqa: E731, UP031
    body = '{"results":{"bindings":[' + ",".join([one("zz", "en"), one("aa", "en"), one("", "en"), one("de", "de"), one("british", "en-GB")]) + "]}}"
    page = spark.createDataFrame([("https://x", "en", None, 0, body)], "portal_url string, language string, url_template string, page int, body string")
    row = normalize.sparql(payloads.records(page, "sparql")).first()
    assert row.title == "aa"
    assert json.loads(row.metadata) == {"dataset": {"type": "uri", "value": "https://x/d/1"}, "title": {"type": "literal", "value": "aa", "xml:lang": "en"}}


def test_an_id_on_two_pages_stays_once(spark):
    record = lambda title: '{"resource":{"id":"abcd-1234","name":"%s"}}' % title  # noqa: E731, UP031
    pages = spark.createDataFrame([("https://s", "en", None, p, '{"results":[%s]}' % record(t)) for p, t in ((1, "later"), (0, "first"))], "portal_url string, language string, url_template string, page int, body string")  # noqa: UP031
    assert [r.title for r in normalize.socrata(payloads.records(pages, "socrata")).collect()] == ["first"]
