"""Contiguous shards of near equal bytes, cut out of global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut

SHARDS = 40
#: Bytes of a document besides its text's.
HEAD = 16


def targets(total: int, shards: int) -> np.ndarray:
    """Where shards 1, 2, ... begin: twice the bytes before a document, and its own, reach these."""
    return np.array([-(-2 * total * k // shards) for k in range(1, shards)], np.int64)


def _placed(docs: DataFrame, keep: list[Column], shards: int) -> DataFrame:
    """row (a struct of `keep`), size, text_crc32, shard and slot of every row of docs.

    Rows are dealt by ranges of doc_id (equal ones by size, checksum and the row's number, so that
    no doc_id, however often it is there, is one task's alone) and written to the shared folder,
    as they must lie the same way for totals and sums. Each partition's bytes and rows, a
    few numbers, make the prefix sums with which the next pass begins in each partition.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), (F.octet_length(text).cast("bigint") + HEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("nth"),
    )
    order = ["id", "size", "text_crc32", "nth"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("row", "size", "text_crc32", F.spark_partition_id().alias("part")))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    n_bytes, n_rows, before = 0, 0, {}
    for t in totals:
        before[t["part"]] = n_bytes, n_rows
        n_bytes, n_rows = n_bytes + t["bytes"], n_rows + t["rows"]
    cuts = targets(n_bytes, shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(1).to_numpy()
            sums, first = at or before[batch.column(3)[0].as_py()]
            ends = sums + np.cumsum(size)
            shard = np.searchsorted(cuts, 2 * ends - size, side="right")
            nth = first + np.arange(len(size))
            at = int(ends[-1]), first + len(size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard, pa.int32()), pa.array(nth)], ["row", "size", "text_crc32", "shard", "nth"])

    kind = dealt.schema["row"].dataType.simpleString()
    placed = dealt.mapInArrow(place, f"row {kind}, size bigint, text_crc32 bigint, shard int, nth bigint")
    # a row for each shard, so as many as were asked for
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("row", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text, ...).

    Documents by ascending doc_id, one after the other, are cut into `shards` shards at
    equal steps of all bytes; each goes to the step in which its middle lies. So shards are contiguous,
    and a shard's bytes differ from the mean by at most a document. A document larger
    than that leaves shards empty.

    A document's size is its text's UTF-8 bytes and 16 more; a null text is empty, its
    checksum 0. Null ids come first. Repeated rows are documents of their own. The
    law is `bytes`, so grown_shard is null. Other columns are left out; an empty table gives
    an empty result.
    """
    placed = _placed(docs, [F.col("doc_id")], shards)
    return placed.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, shard_column: str = "shard", slot_column: str = "slot") -> None:
    """Write docs, all their columns, to a Parquet folder for each shard, with the shard and the slot.

    Shards and slots are those of assign(). As the rows are dealt by doc_id already, a
    shard's files come from the few partitions that it covers, in order.
    """
    if taken := {shard_column, slot_column} & set(docs.columns):
        raise ValueError(f"the documents have columns {sorted(taken)}; name others")
    placed = _placed(docs, [F.col(f"`{c}`") for c in docs.columns], shards)
    placed.select("row.*", F.col("shard").alias(shard_column), F.col("slot").alias(slot_column)).write.partitionBy(shard_column).parquet(path)
