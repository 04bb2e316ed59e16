"""A corpus pipeline of five stages, each on all documents that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, mixing, packing, simhash, toxicity
from lodestar.llm.common import cut, table

#: SQL can't express the classifier, the fingerprints, the mix or the packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on their labels, doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least three of them hold; the largest doc_id keeps its lines."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or up to three times."""
    own = {c: f"__own_{c}" if c in mixing.ADDED else c for c in docs.columns}
    mixed = mixing.mix(docs.withColumnsRenamed(own)).where("copies > 0")
    repeated = mixed.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(new).alias(old) for old, new in own.items()])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    cut(spark.range(0))  # sets a checkpoint folder where the session has none
    shared = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
