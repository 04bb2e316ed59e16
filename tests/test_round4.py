"""Faults that show at sizes between those of the given tables."""

from __future__ import annotations

import corpus_pipeline
from lodestar.llm import simhash, topk


def test_signatures_are_not_broadcast(spark, monkeypatch):
    """64 signatures of each fingerprint count as one row of it in Spark's sizes."""
    plans = []
    shown = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(simhash, "cut", shown)
    fps = spark.range(300).selectExpr("xxhash64(id) AS fp")
    simhash.links(fps.unionByName(fps.selectExpr("fp ^ 5 AS fp"))).collect()
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_queries_sent_to_all_slots_are_not_broadcast(spark):
    """Blocks of queries were sent once for each slot by way of the driver, and the search ran three times."""
    vec = spark.range(0, 1200, 10).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS embedding")
    plan = topk.top_k(vec)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("search(") == plan.count("SortMergeJoin") == 1


def test_near_copies_are_dropped_without_a_broadcast_of_signatures(spark, monkeypatch):
    """The pipeline's stage: every table that is cut is made without broadcasting what explode makes."""
    plans = []
    before = simhash.cut
    shown = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df)
    monkeypatch.setattr(simhash, "cut", shown)
    docs = spark.createDataFrame([(i, f"word {i % 20} of a text {i % 20}") for i in range(60)], "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == list(range(20))
    exploded = [p for p in plans if "explode(" in p]
    assert exploded and not any("Broadcast" in p for p in exploded)
