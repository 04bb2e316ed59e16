"""Streaming ingestion of landed records into versioned catalog tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from lodestar.operators import store
from lodestar.operators.dedupe import keep_first
from lodestar.streaming.table import Table as Catalog


def landed(spark: SparkSession, folder: str, schema: StructType, *, files_per_batch: int = 1, pattern: str = "*") -> DataFrame:
    """ST1: landed Parquet files as a stream, some files at a time; finished files aren't read again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """ST3: the first record of each key; state is kept only as long as the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


@dataclass(frozen=True)
class Outcome:
    """ST7: what a batch did with a portal's rows; skipped are bad rows and repeats of a key."""

    batch: int
    portal: str | None
    created: int
    updated: int
    unchanged: int
    skipped: int


def outcomes(catalog: Catalog, batch: DataFrame, kept: DataFrame, number: int) -> list[Outcome]:
    """ST7, A4: the outcomes of a batch for each portal, against the version before it: kept are its rows that go in."""
    known = store.with_outcome(kept, catalog.read(number)).groupBy("source_portal").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("created", "updated", "unchanged")])
    came = batch.groupBy("source_portal").agg(F.count("*").alias("came")).withColumnRenamed("source_portal", "portal")
    rows = came.join(known, F.col("portal").eqNullSafe(F.col("source_portal")), "left").drop("source_portal").na.fill(0, ["created", "updated", "unchanged"])
    return [Outcome(number, r["portal"], r["created"], r["updated"], r["unchanged"], r["came"] - r["created"] - r["updated"] - r["unchanged"]) for r in rows.orderBy("portal").collect()]


def upsert_batch(catalog: Catalog, seen: str, *, order: list[str], now: Column, report: Callable[[list[Outcome]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """ST4, ST6: a foreachBatch function: keep the first of each key, upsert, and record the seen keys.

    Version 0 must exist; batch n makes version n + 1 and writes its keys to seen/batch=n.
    Rows with a null key go to quarantine/batch=n (ST5). now is the run's time, the same
    for all its batches, so that a batch run again gives the same rows. report (E4) is told the
    outcomes of each batch, a row for each of its portals, once the batch is in the table; of a batch run again
    it is told again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        bad = F.col(store.KEY[0]).isNull() | F.col(store.KEY[1]).isNull()
        good = keep_first(batch.where(~bad), store.KEY, [F.col(c) for c in order])
        catalog.apply(good, number, now)
        good.select(*store.KEY).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        batch.where(bad).write.mode("overwrite").parquet(f"{seen}-quarantine/batch={number}")
        if report is not None:
            report(outcomes(catalog, batch, good, number))

    return apply


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """ST1, ST4: process all landed files in micro-batches and stop."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _brought(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that a run's batches wrote; none if it had no batch."""
    try:
        return spark.read.parquet(folder).select(*store.KEY)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "source_portal string, original_id string")


def run_status(spark: SparkSession, seen: str, *, mode: str = "full", cancelled: bool = False, truncated: bool = False, failed: int = 0) -> DataFrame:
    """ST5, U13: one row for a run: status, synced and skipped rows, and whether it may retire rows (U8).

    A truncated run keeps its good rows and is partial; rows in quarantine count as skipped,
    and either forbids retiring. A run that brought no batch has none of either.
    """
    synced = _brought(spark, seen).agg(F.count("*").alias("synced"))
    counts = synced.join(F.broadcast(_brought(spark, f"{seen}-quarantine").agg(F.count("*").alias("skipped"))), F.lit(True))
    ended = (F.lit(cancelled), F.lit(truncated))
    allowed = store.stale_allowed(F.lit(mode), *ended, F.lit(failed), F.col("skipped"))
    return counts.select(store.final_status(*ended).alias("status"), "synced", "skipped", F.lit(failed).cast("bigint").alias("failed"), allowed.alias("may_retire"))


def finish(catalog: Catalog, version: int, seen: str, *, complete: bool, portals: DataFrame | None = None) -> DataFrame:
    """ST5, U8: the catalog at the end of a run; rows not seen are retired only if the run was complete (run_status: may_retire).

    portals (source_portal) are those that the run covered, by default those of which it saw rows;
    a portal of which a complete run saw nothing loses all.
    """
    rows = catalog.read(version)
    if not complete:
        return rows
    keys = _brought(catalog.spark, seen)
    return store.stale_by_exclusion(rows, keys, keys.select("source_portal") if portals is None else portals).drop("change")


def high_water_mark(runs: DataFrame) -> DataFrame:
    """ST2: for each portal the start of its last completed run (portal_url, sync_status, started_at)."""
    return runs.where("sync_status = 'completed'").groupBy("portal_url").agg(F.max("started_at").alias("since"))


def sync_plan(portals: DataFrame, runs: DataFrame, policy: Column, *, force_full: bool = False) -> DataFrame:
    """ST2, U9: the plan of each portal's next sync from its runs: incremental ones begin at the high-water mark."""
    marks = high_water_mark(runs).withColumnRenamed("since", "last_successful_sync")
    return store.sync_plan(portals, marks, policy, force_full=force_full)


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """ST7: outcome rows, and an observation that holds their counts once an action has run."""
    watch = Observation(name)
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("created", "updated", "unchanged", "failed", "skipped")]
    return rows.observe(watch, F.count(F.lit(1)).alias("rows"), *counts), watch


class Progress(StreamingQueryListener):
    """ST7, E4: collects the number of input rows of each micro-batch."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int]] = []
        self.ended = False

    def onQueryStarted(self, event) -> None:
        self.ended = False

    def onQueryProgress(self, event) -> None:
        self.batches.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True
