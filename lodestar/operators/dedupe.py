"""Aliases, duplicate titles and keep-first rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import without_trailing_slashes

#: Rows and bytes of text up to which a dimension is sent to every task; a larger one is joined by shuffle.
SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20


def small(dimension: DataFrame) -> DataFrame:
    """The dimension, marked for broadcast only if it has been measured to be small, in rows and in bytes."""
    text = F.octet_length(F.to_json(F.struct("*")))
    size = dimension.limit(SMALL_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    return F.broadcast(dimension) if size["n"] <= SMALL_ROWS and size["bytes"] <= SMALL_BYTES else dimension


def aliases(portals: DataFrame) -> DataFrame:
    """alias and canonical url (both without trailing slashes) of each declared alias."""
    declared = portals.select("url", F.explode("aliases").alias("alias"))
    return declared.select(without_trailing_slashes(F.col("alias")).alias("alias"), without_trailing_slashes(F.col("url")).alias("canonical"))


def with_canonical_portal(rows: DataFrame, portals: DataFrame) -> DataFrame:
    """The rows with canonical_portal: the portal without trailing slashes, aliases folded."""
    trimmed = rows.withColumn("__portal", without_trailing_slashes(F.col("source_portal")))
    joined = trimmed.join(small(aliases(portals)), F.col("__portal") == F.col("alias"), "left")
    return joined.withColumn("canonical_portal", F.coalesce("canonical", "__portal")).drop("alias", "canonical", "__portal")


def duplicate_titles(canonical: DataFrame) -> DataFrame:
    """A2: lower-cased titles that stand on more than one canonical portal, over all rows.

    Distinct (title, portal) pairs are made first, so a title that one portal repeats often
    costs one row for each task.
    """
    pairs = canonical.select(F.lower("title").alias("title_key"), "canonical_portal").where("title_key is not null").distinct()
    return pairs.groupBy("title_key").agg(F.count("*").alias("portals")).where("portals > 1")


def with_duplicate_flag(canonical: DataFrame) -> DataFrame:
    """The rows with is_duplicate: whether the title is one of duplicate_titles."""
    marks = duplicate_titles(canonical).select("title_key", F.lit(True).alias("__marked"))
    joined = canonical.withColumn("title_key", F.lower("title")).join(marks, "title_key", "left")
    return joined.withColumn("is_duplicate", F.coalesce("__marked", F.lit(False))).drop("title_key", "__marked")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes first in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def skipped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Total, kept and skipped rows of an upsert batch, for each portal."""
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.groupBy("source_portal").agg(F.sum("n").alias("total"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("skipped"))


def title_overlap(canonical: DataFrame) -> DataFrame:
    """V5: for each canonical portal the titles that another portal has too, and their share."""
    pairs = canonical.select(F.lower("title").alias("title_key"), "canonical_portal").where("title_key is not null").distinct()
    shared = duplicate_titles(canonical).select("title_key", F.lit(1).alias("__shared"))
    out = pairs.join(shared, "title_key", "left").groupBy("canonical_portal")
    return out.agg(F.count("*").alias("titles"), F.count("__shared").alias("shared"), F.round(F.count("__shared") / F.count("*"), 4).alias("share"))
