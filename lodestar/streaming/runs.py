"""Runs of a portal as state: which run last saw a record, and what the end of a run retires."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators import store
from lodestar.streaming.table import Table

#: Shares of a portal's records, each of which a task can hold on its own.
SHARES = 64
CHANGES = "source_portal string, original_id string, change string, run bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Seen(StatefulProcessor):
    """For each record of a share of a portal the run that last saw it, and whether it is stale.

    Records come with their run's number; a row without an original_id is the end of a complete run.
    An end retires the records that no run since has seen; a record that comes again is revived. Only
    changes come out. Numbers of runs ascend; rows of a run that come after its end count as seen.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "original_id string", "run bigint, stale boolean")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N803
        self.records.updateValue((initialState.original_id,), (-1, initialState.is_stale))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        ended = None
        for row in rows:
            if row.original_id is None:
                ended = row.run if ended is None else max(ended, row.run)
                continue
            known = self.records.getValue((row.original_id,)) if self.records.containsKey((row.original_id,)) else None
            if known is None or known[1]:
                yield Row(source_portal=key[0], original_id=row.original_id, change="first" if known is None else "revived", run=row.run)
            if known is None or known[1] or known[0] < row.run:
                self.records.updateValue((row.original_id,), (row.run if known is None else max(known[0], row.run), False))
        if ended is None:
            return
        gone = [(name, run) for (name,), (run, stale) in self.records.iterator() if run < ended and not stale]
        for name, run in gone:
            self.records.updateValue((name,), (run, True))
            yield Row(source_portal=key[0], original_id=name, change="retired", run=ended)

    def close(self) -> None:
        pass


def _shared_out(rows: DataFrame, shares: int) -> DataFrame:
    """The rows with their share; the end of a run goes to all shares."""
    own = F.array(F.pmod(F.xxhash64("original_id"), F.lit(shares)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))
    return rows.withColumn("share", F.explode(F.when(F.col("original_id").isNull(), every).otherwise(own)))


def changes(records: DataFrame, known: DataFrame | None = None, shares: int = SHARES) -> DataFrame:
    """ST5, ST6, U5: a stream of changes (first, revived, retired) from a stream of records (source_portal, original_id, run).

    A record without original_id ends the portal's run; land it only for runs that may retire (U8).
    known (source_portal, original_id, is_stale) is what the table holds before the first run. The
    state is keyed by portal and share, so that a portal of any size is spread over tasks.
    """
    stream = _shared_out(records.select(*store.KEY, F.col("run").cast("bigint").alias("run")), shares)
    before = None if known is None else _shared_out(known.select(*store.KEY, "is_stale").where("original_id is not null"), shares).groupBy("source_portal", "share")
    return stream.groupBy("source_portal", "share").transformWithState(statefulProcessor=Seen(), outputStructType=CHANGES, outputMode="Update", timeMode="None", initialState=before)


def marks_batch(table: Table, first_version: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes changes to a table: batch n makes version first_version + n + 1. A key of several changes keeps the last: retired."""

    def apply(batch: DataFrame, number: int) -> None:
        marks = batch.where("change <> 'first'").groupBy(*store.KEY).agg(F.bool_or(F.col("change") == "retired").alias("is_stale"))
        table.mark(marks, first_version + number)

    return apply


def start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Process all that has landed with the state in RocksDB, and stop; the session's own state provider is left as it was."""
    conf = stream.sparkSession.conf
    was = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if was is None else conf.set(PROVIDER, was)
    query.awaitTermination()
    return query
