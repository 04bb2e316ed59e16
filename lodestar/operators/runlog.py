"""Views of the run log and of portals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import without_trailing_slashes


def by_status(jobs: DataFrame) -> DataFrame:
    """A3."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def recent(jobs: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    """The newest jobs, of one status if given."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def harvest_status(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """V1: the newest jobs, each with the numbers of pending and running ones."""
    counts = jobs.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "running").alias("running"))
    return recent(jobs, limit=limit).select("id", "portal_url", "status", "created_at").join(F.broadcast(counts), F.lit(True))


def batch_summary(jobs: DataFrame) -> DataFrame:
    """A5: portals and synced datasets of the runs of each status."""
    synced = F.col("created") + F.col("updated") + F.col("unchanged")
    return jobs.groupBy("status").agg(F.countDistinct("portal_url").alias("portals"), F.count("*").alias("runs"), F.sum(synced).alias("datasets"))


def outcome(jobs: DataFrame) -> DataFrame:
    """V4: for each portal whether all its runs ended well."""
    bad = F.col("status").isin("failed", "cancelled", "partial")
    return jobs.groupBy("portal_url").agg(F.count_if(bad).alias("bad"), F.bool_and(~bad).alias("success"))


def sync_status(jobs: DataFrame) -> DataFrame:
    """Sync status of each portal from its completed runs: the start of the last, its mode, rows and status."""
    done = jobs.where("status = 'completed'").withColumn("synced", F.col("created") + F.col("updated") + F.col("unchanged"))
    last = F.max_by(F.struct("sync_mode", "synced"), F.struct("created_at", "id"))
    out = done.groupBy("portal_url").agg(F.max("created_at").alias("last_successful_sync"), last.alias("run"))
    return out.select("portal_url", "last_successful_sync", F.col("run.sync_mode").alias("last_sync_mode"), F.lit("completed").alias("sync_status"), F.col("run.synced").alias("datasets_synced"))


def portal_list(portals: DataFrame, status: DataFrame, catalog: DataFrame) -> DataFrame:
    """Configured portals with their last sync and the number of their active rows."""
    rows = catalog.where("not is_stale").groupBy(without_trailing_slashes(F.col("source_portal")).alias("url")).agg(F.count("*").alias("datasets"))
    known = status.select(F.col("portal_url").alias("url"), "last_successful_sync", "last_sync_mode", "sync_status")
    joined = portals.select("name", "url", "type", "enabled").join(known, "url", "left").join(rows, "url", "left")
    return joined.withColumn("datasets", F.coalesce("datasets", F.lit(0)))


def portal_stats(portals: DataFrame, status: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """The portal_list row of one portal; its name is matched ignoring ASCII case."""
    return portal_list(portals.where(F.lower("name") == name.lower()), status, catalog)


def enabled(portals: DataFrame) -> DataFrame:
    """enabled portals in the order of the configuration."""
    return portals.where("enabled").orderBy("config_index")


def in_config_order(results: DataFrame, portals: DataFrame) -> DataFrame:
    """Results of portals (portal_url, ...) back in the order of the configuration."""
    order = portals.select(F.col("url").alias("portal_url"), "config_index", "name")
    return results.join(order, "portal_url").orderBy("config_index")


def invalid_portals(portals: DataFrame) -> DataFrame:
    """Entries whose options don't fit their type, with the reason."""
    has = lambda c: F.col(c).isNotNull() if c in portals.columns else F.lit(False)
    reason = (
        F.when(has("profile") & (F.col("type") != "dcat"), "profile is only for dcat")
        .when(has("sparql_endpoint") & (F.col("type") != "sparql"), "sparql_endpoint is only for sparql")
        .when(has("ogc_endpoint") & (F.col("type") != "ogc_records"), "ogc_endpoint is only for ogc_records")
    )
    return portals.withColumn("reason", reason).where("reason is not null")


#: The options of a portal's entry (fixed values).
OPTIONS = ["name", "url", "type", "profile", "language", "enabled", "aliases", "sparql_endpoint", "ogc_endpoint", "url_template"]


def config_checksum(portals: DataFrame) -> DataFrame:
    """SHA-256 of the configured portals with all their options, in their order, one JSON object a line.

    Options that the table hasn't got or that are null are left out.
    """
    options = [c for c in OPTIONS if c in portals.columns]
    entry = F.to_json(F.struct(*options))
    lines = portals.agg(F.array_sort(F.collect_list(F.struct("config_index", entry.alias("json")))).alias("all"))
    return lines.select(F.sha2(F.array_join(F.transform("all", lambda p: p["json"]), "\n"), 256).alias("checksum"))
