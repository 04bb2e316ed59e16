"""Counts and rates of a snapshot: coverage, curation, completeness, resource quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import non_blank, rate

COMPLETE = ["description", "license", "organization", "tags", "metadata_modified"]


def stats(catalog: DataFrame) -> DataFrame:
    """A1: rows, embedded rows, portals, last update and stale rows."""
    return catalog.agg(
        F.count("*").alias("total"),
        F.count("embedding").alias("embedded"),
        F.countDistinct("source_portal").alias("portals"),
        F.max("last_updated_at").alias("last_update"),
        F.count_if("is_stale").alias("stale"),
    )


def per_portal(snapshot: DataFrame) -> DataFrame:
    """Rows of each portal with its type and profile; largest first, then by name and url."""
    counted = snapshot.groupBy("source_portal", "portal_name", "portal_type", "portal_profile").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "portal_name", "source_portal")


def coverage(snapshot: DataFrame) -> DataFrame:
    """Rows by type, profile, language and portal in one pass; dimension, bucket, n.

    Buckets are ordered by dimension, count (falling) and key.
    """
    rows = snapshot.select("portal_type", F.coalesce("portal_profile", F.lit("none")).alias("profile"), "language", "portal_name")
    sets = rows.groupingSets([["portal_type"], ["profile"], ["language"], ["portal_name"]], "portal_type", "profile", "language", "portal_name")
    counted = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = F.when(F.col("g") == 7, "type").when(F.col("g") == 11, "profile").when(F.col("g") == 13, "language").otherwise("portal")
    out = counted.select(named.alias("dimension"), F.coalesce("portal_type", "profile", "language", "portal_name").alias("bucket"), "n")
    return out.orderBy("dimension", F.col("n").desc(), "bucket")


def resource_buckets(snapshot: DataFrame) -> DataFrame:
    """Number of resources of each format and media type as published; nulls aren't counted."""
    each = snapshot.select(F.explode_outer("resources").alias("r"))  # the inner form would derive the resources once more for a filter
    pairs = each.select(F.explode(F.array(F.struct(F.lit("format").alias("facet"), F.col("r.format").alias("bucket")), F.struct(F.lit("media_type").alias("facet"), F.col("r.media_type").alias("bucket")))).alias("p"))
    return pairs.select("p.facet", "p.bucket").where("bucket is not null").groupBy("facet", "bucket").agg(F.count("*").alias("n")).orderBy("facet", F.col("n").desc(), "bucket")


def resource_quality(snapshot: DataFrame) -> DataFrame:
    """For each portal its datasets, those with resources and with a field schema, and its resources."""
    some = F.exists("resources", lambda r: r["field_count"] > 0)
    return snapshot.groupBy("source_portal").agg(
        F.count("*").alias("datasets"), F.count_if(F.size("resources") > 0).alias("with_resources"), F.count_if(some).alias("with_fields"), F.sum(F.size("resources")).alias("resources")
    )


def portal_buckets(snapshot: DataFrame) -> DataFrame:
    """Resources of each portal, facet (format or media_type) and bucket as published; nulls aren't counted."""
    each = snapshot.select("source_portal", F.explode_outer("resources").alias("r"))
    pair = lambda facet: F.struct(F.lit(facet).alias("facet"), F.col(f"r.{facet}").alias("bucket"))
    pairs = each.select("source_portal", F.explode(F.array(pair("format"), pair("media_type"))).alias("p")).select("source_portal", "p.facet", "p.bucket")
    return pairs.where("bucket is not null").groupBy("source_portal", "facet", "bucket").agg(F.count("*").alias("n"))


def portal_top_buckets(sizes: DataFrame, limit: int = 15) -> DataFrame:
    """Of portal_buckets the largest of each portal and facet, and what the others make.

    One row each: rank (from 1, larger first, then by key), bucket and n; and where there are more than
    `limit` buckets a row of rank limit + 1 with a null bucket, the others' resources (n) and their
    number (more). Tasks keep `limit` rows of a portal and facet before they are ranked.
    """
    keys = ["source_portal", "facet"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "bucket"))
    first = sizes.withColumn("rank", rank).where(F.col("rank") <= limit)
    total = sizes.groupBy(*keys).agg(F.count("*").alias("buckets"), F.sum("n").alias("total"))
    shown = first.groupBy(*keys).agg(F.count("*").alias("shown"), F.sum("n").alias("sum"))
    others = total.join(shown, keys).where("buckets > shown")
    rest = others.select(*keys, F.lit(limit + 1).alias("rank"), F.lit(None).cast("string").alias("bucket"), (F.col("total") - F.col("sum")).alias("n"), (F.col("buckets") - F.col("shown")).alias("more"))
    return first.select(*keys, "rank", "bucket", "n", F.lit(0).cast("bigint").alias("more")).unionByName(rest)


def completeness(snapshot: DataFrame) -> DataFrame:
    """A10: for each facet the rows that have it, and their rate."""
    present: dict[str, Column] = {c: non_blank(F.col(c)).isNotNull() for c in COMPLETE}
    present["resources"] = F.size("resources") > 0
    present["resource_schema"] = F.exists("resources", lambda r: r["field_count"] > 0)
    counted = snapshot.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in present.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("present")) for k in present])).alias("f")
    return counted.select("total", rows).select("f.facet", "f.present", "total", rate(F.col("f.present"), F.col("total")).alias("rate"))


def curation(flagged: DataFrame, noise: Column) -> DataFrame:
    """Raw rows, exported ones, those filtered as noise, and exported ones flagged as duplicates."""
    return flagged.agg(
        F.count("*").alias("raw"), F.count_if(~noise).alias("exported"), F.count_if(noise).alias("filtered"), F.count_if(~noise & F.col("is_duplicate")).alias("duplicates")
    )


def top_buckets(buckets: DataFrame, limit: int = 15) -> DataFrame:
    """The largest buckets, and a row for how many more there are (null bucket, n their number)."""
    first = buckets.orderBy(F.col("n").desc(), "bucket").limit(limit)
    rest = buckets.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("n")).where("n > 0").select(F.lit(None).cast("string").alias("bucket"), "n")
    return first.select("bucket", "n").unionByName(rest)


def excluded_portals(portals: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Enabled portals that have no exported row, by name."""
    have = snapshot.select(F.col("source_portal").alias("url")).distinct()
    return portals.where("enabled").join(have, "url", "left_anti").select("name", "url").orderBy("name")


def alias_groups(portals: DataFrame) -> DataFrame:
    """Number of portals that have aliases."""
    return portals.where(F.size("aliases") > 0).agg(F.countDistinct("url").alias("alias_groups"))
