"""Changes of the catalog as functions from old tables to new ones, and the state of syncs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.dedupe import keep_first

KEY = ["source_portal", "original_id"]


def with_outcome(incoming: DataFrame, existing: DataFrame, *, always: bool = False) -> DataFrame:
    """The incoming rows with outcome created, updated or unchanged.

    A stored null hash counts as changed. always: every known row counts as updated. The
    join is on portal and id, so that one large portal is spread over all tasks.
    """
    known = existing.select(*KEY, F.col("content_hash").alias("__hash"), F.lit(True).alias("__known"))
    joined = incoming.join(known, KEY, "left")
    same = F.lit(False) if always else F.coalesce(F.col("__hash") == F.col("content_hash"), F.lit(False))
    outcome = F.when(F.col("__known").isNull(), "created").when(same, "unchanged").otherwise("updated")
    return joined.withColumn("outcome", outcome).drop("__hash", "__known")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """A4: counts of each outcome for each portal, their total and the successful ones."""
    counted = outcomes.groupBy("source_portal").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("unchanged", "updated", "created", "failed", "skipped")])
    good = F.col("unchanged") + F.col("updated") + F.col("created")
    return counted.withColumn("total", good + F.col("failed") + F.col("skipped")).withColumn("successful", good)


def dry_run(incoming: DataFrame, existing: DataFrame, *, always: bool = False) -> DataFrame:
    """What a run would do, as outcome_counts: of a key that comes more than once the first by hash counts, nothing is written."""
    first = keep_first(incoming, KEY, [F.col("content_hash")])
    return outcome_counts(with_outcome(first, existing, always=always))


#: What an incoming row brings besides its key.
VALUES = ["url", "title", "description", "record_kind", "metadata", "content_hash", "embedding"]


def upsert(catalog: DataFrame, incoming: DataFrame, now: Column, first: Column | None = None) -> DataFrame:
    """The catalog after the incoming rows; a key must come once (see dedupe.keep_first).

    Incoming values replace stored ones, but a stored embedding outlives an incoming null
    and first_seen_at stays; replaced rows are fresh again. now and first (when a new row was
    first seen, default now) may be columns of the incoming rows.
    """
    new = incoming.select(*KEY, F.struct(*VALUES, now.alias("now"), (now if first is None else first).alias("first")).alias("__new"))
    old = catalog.select(*KEY, F.struct(*[c for c in catalog.columns if c not in KEY]).alias("__old"))
    both = old.join(new, KEY, "full")
    come = F.col("__new").isNotNull()
    pick = lambda c: F.when(come, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)
    return both.select(
        *KEY,
        *[pick(c) for c in ("url", "title", "description", "record_kind", "metadata", "content_hash")],
        F.coalesce("__new.embedding", "__old.embedding").alias("embedding"),
        F.coalesce("__old.first_seen_at", "__new.first").alias("first_seen_at"),
        F.when(come, F.col("__new.now")).otherwise(F.col("__old.last_updated_at")).alias("last_updated_at"),
        F.when(come, F.lit(False)).otherwise(F.col("__old.is_stale")).alias("is_stale"),
    )


def touch(catalog: DataFrame, keys: DataFrame, now: Column, *, revive: bool = True) -> DataFrame:
    """last_updated_at = now for the listed keys; the list form also clears is_stale."""
    listed = keys.select(*KEY).distinct().withColumn("__listed", F.lit(True))
    joined = catalog.join(listed, KEY, "left")
    hit = F.col("__listed").isNotNull()
    out = joined.withColumn("last_updated_at", F.when(hit, now).otherwise(F.col("last_updated_at")))
    return (out.withColumn("is_stale", F.col("is_stale") & ~hit) if revive else out).drop("__listed")


def stale_by_time(catalog: DataFrame, portal: Column, started: Column) -> DataFrame:
    """U4: active rows of a portal not updated since the sync's start become stale."""
    old = (F.col("source_portal") == portal) & (F.col("last_updated_at") < started)
    return catalog.withColumn("is_stale", F.col("is_stale") | old)


def stale_by_exclusion(catalog: DataFrame, seen: DataFrame, portals: DataFrame) -> DataFrame:
    """In the listed portals, seen rows are fresh and all others stale; change says what happened.

    change is `retired`, `revived` or null; last_updated_at doesn't change. A portal with no
    seen row loses all.
    """
    marks = seen.select(*KEY).distinct().withColumn("__seen", F.lit(True))
    scope = portals.select("source_portal").distinct().withColumn("__scope", F.lit(True))
    joined = catalog.join(marks, KEY, "left").join(scope, "source_portal", "left")
    hit, inside = F.col("__seen").isNotNull(), F.col("__scope").isNotNull()
    change = F.when(inside & hit & F.col("is_stale"), "revived").when(inside & ~hit & ~F.col("is_stale"), "retired")
    return joined.withColumn("change", change).withColumn("is_stale", F.when(inside, ~hit).otherwise(F.col("is_stale"))).drop("__seen", "__scope")


def stale_allowed(mode: Column, cancelled: Column, truncated: Column, failed: Column, skipped: Column) -> Column:
    """U8: whether a run may retire rows: full, complete and without a failed or skipped row."""
    return (mode == "full") & ~cancelled & ~truncated & (failed == 0) & (skipped == 0)


def final_status(cancelled: Column, truncated: Column) -> Column:
    """U13."""
    return F.when(cancelled, "cancelled").when(truncated, "partial").otherwise("completed")


def upsert_sync_status(status: DataFrame, runs: DataFrame) -> DataFrame:
    """Sync status after the runs (portal_url, last_sync, mode, sync_status, datasets_synced).

    The last successful sync only moves on when a run completed.
    """
    old = status.select("portal_url", F.col("last_successful_sync").alias("__last"), F.struct("last_sync_mode", "sync_status", "datasets_synced").alias("__old"))
    both = old.join(runs, "portal_url", "full")
    come = F.col("sync_status").isNotNull()
    return both.select(
        "portal_url",
        F.when(F.col("sync_status") == "completed", F.col("last_sync")).otherwise(F.col("__last")).alias("last_successful_sync"),
        F.when(come, F.col("mode")).otherwise(F.col("__old.last_sync_mode")).alias("last_sync_mode"),
        F.when(come, F.col("sync_status")).otherwise(F.col("__old.sync_status")).alias("sync_status"),
        F.when(come, F.col("datasets_synced")).otherwise(F.col("__old.datasets_synced")).alias("datasets_synced"),
    )


def sync_plan(portals: DataFrame, status: DataFrame, policy: Column, *, force_full: bool = False) -> DataFrame:
    """Plan of each portal's next sync: forced_full, first_full, incremental or full.

    Incremental needs the start of a completed sync and a family that can filter by date.
    """
    joined = portals.join(status.select(F.col("portal_url").alias("url"), "last_successful_sync"), "url", "left")
    plan = F.when(F.lit(force_full), "forced_full").when(F.col("last_successful_sync").isNull(), "first_full").when(policy == "full", "full").otherwise("incremental")
    since = F.when(F.col("plan") == "incremental", F.col("last_successful_sync"))
    return joined.withColumn("plan", plan).withColumn("since", since)


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change (added, changed, removed or unchanged) of each key of two snapshots; null hashes are equal."""
    now = current.select(*KEY, F.col("content_hash").alias("__now"), F.lit(True).alias("__in_now"))
    was = previous.select(*KEY, F.col("content_hash").alias("__was"), F.lit(True).alias("__in_was"))
    change = F.when(F.col("__in_was").isNull(), "added").when(F.col("__in_now").isNull(), "removed").when(F.col("__now").eqNullSafe(F.col("__was")), "unchanged").otherwise("changed")
    return now.join(was, KEY, "full").select(*KEY, change.alias("change"))


def changelog(changed: DataFrame) -> DataFrame:
    """Changes of each portal, most active first, then by portal."""
    kinds = ("added", "changed", "removed", "unchanged")
    counted = changed.groupBy("source_portal").agg(*[F.count_if(F.col("change") == x).alias(x) for x in kinds])
    return counted.orderBy((F.col("added") + F.col("changed") + F.col("removed")).desc(), "source_portal")
