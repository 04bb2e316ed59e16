"""Faults that show on larger or other tables than the given ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.functions import variants as V
from lodestar.operators import normalize, search
from lodestar.plans import fixtures, registry
from lodestar.sources import xml
from tests.conftest import SF
from tests.oracle import connect, rows


def _tables(spark, folder, **changed) -> str:
    """A folder of the given tables, of which some are changed."""
    for name in ("documents", "embeddings", "orders", "lineitem"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        changed.get(name, lambda t: t)(table).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _agrees(spark, folder: str, name: str) -> None:
    con = connect(SF)
    for table in ("documents", "embeddings", "orders", "lineitem"):
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_a_row_that_has_the_runs_time_before_it_is_not_fresh(spark, tmp_path):
    """Document 217440 was last updated at the time of the run that doesn't touch it."""
    later = lambda t: t.unionByName(t.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 217_430))
    _agrees(spark, _tables(spark, tmp_path, documents=later), "st5_partial_run")


def test_many_queries_meet_rows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    given = [(f"i{i}", "t", "d", "u", "p", "dataset", False, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (60, 3)))]
    rows = spark.createDataFrame(given, "id string, title string, description string, url string, source_portal string, record_kind string, is_stale boolean, embedding array<float>")
    asked = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in enumerate(rng.integers(-3, 4, (30, 3)))], "query_id int, query array<float>")
    want = sorted(map(tuple, search.search(rows, asked, 4).collect()), key=str)
    for name, n in (("BROADCAST_QUERIES", 0), ("BLOCK_QUERIES", 7), ("BLOCK_ROWS", 11), ("STEP_ROWS", 3)):
        monkeypatch.setattr(search, name, n)
    assert sorted(map(tuple, search.search(rows, asked, 4).collect()), key=str) == want


def test_xml_rows_go_out_in_pieces(spark):
    taken = []
    given = ({"identifier": str(taken.append(i) or i)} for i in range(2 * xml.PIECE + 3))
    pieces = xml._in_pieces(given, xml._RECORD)
    assert next(pieces).num_rows == xml.PIECE and len(taken) == xml.PIECE
    assert [p.num_rows for p in pieces] == [xml.PIECE, 3]
    pages = xml._pages(iter([pa.RecordBatch.from_pylist([{"body": "a"}, {"body": None}]), pa.RecordBatch.from_pylist([{"body": "b"}])]))
    assert [p["body"] for p in pages] == ["a", None, "b"]


def test_largest_buckets_derive_resources_once(spark):
    plan = registry.queries()["a9_portal_top_buckets"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan.lower() and "metadata" not in plan


def test_titles_and_descriptions_are_cut_before_lines_are_joined(spark):
    """Joining the lines of whole texts, once for each use of a title, was most of a snapshot's time."""
    plan = fixtures.catalog(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(text" not in plan and "replace(text" not in plan


def test_pages_are_read_once_for_each_grouping(spark):
    """Metadata of SPARQL bindings came from a second reading of the pages, distributions of JSON-LD from a third."""
    for family, most in (("sparql", 1), ("dcat", 2)):
        rows = normalize.FAMILIES[family](registry._records(spark, SF, family)).select("original_id", "metadata")
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most


def test_shapes_of_values(spark):
    given = ['"a"', '"5"', '"true"', '"{x"', '"[1]"', '""', "5", "-1.5e300", "true", "null", "[]", '["a"]', "{}", '{"a":1}', '"Infinity"', '"NaN"', "1e400"]
    v = F.col("v")
    rows = spark.createDataFrame([(x, f'{{"k":{x}}}') for x in given], "json string, inside string").select("json", V.parsed(F.col("json")).alias("v"), V.parsed(F.col("inside")).alias("in"))
    shown = V.sign(v)
    same = [V.string_of(v).eqNullSafe(V.string_at(F.col("in"), "k")), V.string_of(v).isNotNull() == (shown == '"'), V.is_list(v) == (shown == "["), V.is_object(v) == (shown == "{")]
    assert rows.where(~F.coalesce(same[0] & same[1] & same[2] & same[3], shown.isNull())).select("json").collect() == []
