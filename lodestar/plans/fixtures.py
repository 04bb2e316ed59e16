"""Catalog tables derived from the given tables; sql.py derives the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import content_hash

KINDS = ["dataset", "series", "service", "map", "other"]
TYPES = ["ckan", "dcat", "sparql", "data_json", "socrata", "opendatasoft", "arcgis", "stac"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: one catalog row for each document, with its vector where there is one."""
    d = F.col("doc_id")
    line = lambda a, n: F.replace(F.substring("text", a, n), F.lit("\n"), F.lit(" "))  # noqa: E731  # cut first: texts are long, and this is computed again wherever a filter moves to
    description = F.when(d % 11 == 0, F.lit(None)).when(d % 13 == 0, F.lit("   ")).otherwise(line(41, 400))
    portal = F.concat(F.lit("https://"), "source", F.lit(".example.org"), F.when(d % 2 == 0, "/").otherwise(""))
    stamp = F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, doc_id)")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(F.concat(portal, F.lit("|"), d.cast("string")), 256).alias("id"),
        d.cast("string").alias("original_id"),
        portal.alias("source_portal"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/dataset/"), d.cast("string")).alias("url"),
        line(1, 40).alias("title"),
        description.alias("description"),
        F.element_at(F.array(*map(F.lit, KINDS)), (d % 5 + 1).cast("int")).alias("record_kind"),
        metadata_json().alias("metadata"),
        F.expr("timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, doc_id)").alias("first_seen_at"),
        stamp.alias("last_updated_at"),
        (d % 17 == 0).alias("is_stale"),
        F.col("lang").alias("language"),
    )
    hashed = F.when(d % 29 == 0, F.lit(None)).otherwise(content_hash(F.col("title"), F.col("description"), F.col("language")))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.withColumn("content_hash", hashed).join(vectors, "doc_id", "left")


def metadata_json() -> F.Column:
    """Payload metadata that takes every branch of the metadata readers, by doc_id."""
    return F.expr("""
        concat('{"doc":', doc_id,
          CASE doc_id % 3 WHEN 0 THEN concat(',"tags":[{"name":"', lang, '"},{"display_name":"', source, '"}]')
            WHEN 1 THEN ',"tags":["plain"]' ELSE '' END,
          CASE doc_id % 4 WHEN 0 THEN concat(',"organization":{"title":"', source, '"}')
            WHEN 1 THEN concat(',"organization":{"name":"', source, '"}')
            WHEN 2 THEN ',"organization":{"title":null,"name":"x"}' ELSE '' END,
          CASE doc_id % 5 WHEN 0 THEN ',"license_title":"CC BY"' WHEN 1 THEN ',"license_id":"cc-by"'
            WHEN 2 THEN ',"license_title":null,"license_id":"x"' ELSE '' END,
          CASE WHEN doc_id % 7 < 4 THEN concat(',"metadata_modified":"2026-02-0', doc_id % 7 + 1, '"') ELSE '' END,
          ',"language":"', upper(lang), '"}')
    """)


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: the identity of an earlier snapshot: some rows missing, changed, removed since, or twice."""
    rows = catalog(spark, sf_dir).select("doc_id", "source_portal", "original_id", "content_hash")
    kept = rows.where("doc_id % 10 <> 3")
    kept = kept.withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.concat_ws("", F.lit("old"), "content_hash")).otherwise(F.col("content_hash")))
    gone = rows.where("doc_id % 19 = 0").withColumn("original_id", (F.col("doc_id") + 1_000_000).cast("string"))
    twice = kept.where("doc_id % 23 = 0").withColumn("content_hash", F.lit("second"))
    return (
        kept.withColumn("pos", F.lit(0)).unionByName(gone.withColumn("pos", F.lit(0))).unionByName(twice.withColumn("pos", F.lit(1))).drop("doc_id")
    )


def portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: the configured portals: one for each source, src1 an alias of src0, and one without rows."""
    sources = read(spark, sf_dir, "documents").select("source").distinct().where("source is not null and source <> 'src1'")
    number = F.regexp_extract("source", r"([0-9]+)$", 1).cast("int")
    own = sources.select(
        F.col("source").alias("name"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org")).alias("url"),
        F.element_at(F.array(*map(F.lit, TYPES)), number % 8 + 1).alias("type"),
        F.when(number % 8 == 1, "udata").alias("profile"),
        F.when(number % 3 == 0, "fr").otherwise("en").alias("language"),
        (number % 5 != 4).alias("enabled"),
        F.when(F.col("source") == "src0", F.array(F.lit("https://src1.example.org"))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        number.alias("config_index"),
    )
    empty = spark.range(1).select(
        F.lit("empty").alias("name"), F.lit("https://empty.example.org").alias("url"), F.lit("ckan").alias("type"), F.lit(None).cast("string").alias("profile"),
        F.lit("en").alias("language"), F.lit(True).alias("enabled"), F.array().cast("array<string>").alias("aliases"), F.lit(1000).alias("config_index"),
    )
    return own.unionByName(empty)


def resource_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: one dataset for each order, whose lines are resource nodes of its metadata JSON."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.col("l_linenumber").alias("n"),
            F.concat(F.lit("line "), "l_linenumber").alias("name"),
            F.when(F.col("l_linenumber") % 4 != 0, F.col("l_returnflag")).alias("format"),
            F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("text/"), F.lower("l_linestatus"))).alias("mimetype"),
            F.concat(F.lit("https://data.example.org/"), "l_partkey").alias("url"),
            F.transform(F.sequence(F.lit(1), F.col("l_linenumber") % 3), lambda i: F.struct(F.concat(F.lit("f"), i).alias("name"), F.lit("int").alias("type"))).alias("fields"),
        ).alias("resource"),
    )
    fields = F.when(F.col("resource.n") % 3 == 0, F.array().cast("array<struct<name:string,type:string>>")).otherwise(F.col("resource.fields"))
    lines = lines.withColumn("resource", F.col("resource").withField("fields", fields))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("resource")).alias("resources"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", "")), F.lit(".example.org")).alias("source_portal"))
    joined = orders.join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("original_id"),
        "source_portal",
        F.to_json(F.struct(F.coalesce("resources", F.array().cast(grouped.schema["resources"].dataType)).alias("resources"))).alias("metadata"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J: a log of harvest runs, one for each event."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.coalesce(F.floor(F.abs("value")), F.lit(0)).cast("bigint")
    status = F.element_at(F.array(*map(F.lit, ["pending", "running", "completed", "failed", "cancelled"])), (e % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        e.alias("id"),
        F.concat(F.lit("https://src"), (u % 20).cast("string"), F.lit(".example.org")).alias("portal_url"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        (v % 100).alias("created"),
        (v % 7).alias("updated"),
        (v % 50).alias("unchanged"),
        (e % 4 == 0).cast("bigint").alias("failed"),
        F.lit(0).cast("bigint").alias("skipped"),
        F.when(e % 3 == 0, "incremental").otherwise("full").alias("sync_mode"),
    )
