"""Scans of the catalog, of earlier snapshots and of their files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.dedupe import keep_first


#: Bytes of a file that is read as one value at most, and of a block of a larger one.
WHOLE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20


def scan(catalog: DataFrame, portal: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows (stale ones too), newest first; of one portal, up to a limit."""
    rows = catalog if portal is None else catalog.where(F.col("source_portal") == portal)
    rows = rows.orderBy(F.col("last_updated_at").desc(), "id")
    return rows if limit is None else rows.limit(limit)


def get(catalog: DataFrame, key: Column) -> DataFrame:
    """S3."""
    return catalog.where(F.col("id") == key)


def hashes(catalog: DataFrame, portal: Column) -> DataFrame:
    """Id and hash of one portal's rows; only these columns are read."""
    return catalog.where(F.col("source_portal") == portal).select("original_id", "content_hash")


def with_positions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet folder with pos: how many rows stand before each in the order of the parts' numbers.

    A row's place in its part comes from the reader, however the parts are split
    into tasks; the parts' row counts, added up, give the places at which parts begin. So positions
    depend on what was written alone. Only the counts, a row for each part, meet in one task.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__part"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    number = F.regexp_extract("__part", r"part-([0-9]+)[^/]*$", 1).cast("int")
    before = F.sum("n").over(Window.orderBy(number, "__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    begins = counts.select("__part", before.alias("__before"))
    return rows.join(begins, "__part").withColumn("pos", F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def identity(snapshot: DataFrame) -> DataFrame:
    """The first row of each key of an identity file, by its position (pos); without positions by hash."""
    order = [F.col(c) for c in ("pos", "content_hash") if c in snapshot.columns]
    return keep_first(snapshot, ["source_portal", "original_id"], order)


def collisions(snapshot: DataFrame) -> DataFrame:
    """Rows of an identity file, distinct keys, and rows that repeat a key."""
    keys = snapshot.groupBy("source_portal", "original_id").agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), (F.sum("n") - F.count("*")).alias("collisions"))


def previous_snapshot_id(spark: SparkSession, folder: str) -> str | None:
    """The id in an earlier snapshot's manifest; None if there is no manifest."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.json(f"{folder}/metadata.json", multiLine=True).select("snapshot_id").first()
    except AnalysisException:
        return None
    return row[0] if row else None


def files(spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE_BYTES) -> DataFrame:
    """Path, name, size and SHA-256 of each file below a folder, whatever its size.

    Files up to `whole` bytes are read as one value; the content of larger ones isn't: a task for each streams
    it through the digest in blocks, from any store that Arrow's file systems open. Spark lists no empty files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    small = found.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > whole).select("path", F.col("length").alias("bytes")).repartition("path")
    every = small.unionByName(large.mapInArrow(_streamed, "path string, bytes bigint, sha256 string"))
    return every.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, bytes and SHA-256 of listed files, read block by block."""
    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            local = re.sub("^file:/+", "/", path)
            system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name, buffer_size=0) as content:
                while block := content.read(BLOCK_BYTES):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "bytes", "sha256"])
