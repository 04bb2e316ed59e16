"""Exports and snapshot files."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import csv_time, file_name, rfc3339
from lodestar.operators import curate, quality, runlog, store
from lodestar.sources import catalog as scans
from lodestar.sources.catalog import files, previous_snapshot_id

JSON_FIELDS = ["id", "original_id", "source_portal", "url", "title", "description", "metadata", "first_seen_at", "last_updated_at"]
CSV_FIELDS = ["id", "original_id", "source_portal", "url", "title", "description", "first_seen_at", "last_updated_at"]
BUCKETS_SHOWN = 15
#: Version of the manifest and of the rows.
SCHEMA_VERSION = "1"
#: Rows of a written Parquet part at most.
MOST_RECORDS = 500_000
#: Formats and media types that reports.json lists; resource_buckets.json has all.
MOST_BUCKETS = 1000
#: What counts as changed, as the changelog says it.
CHANGED = "content_hash differs from that of the earlier snapshot's row of the same source_portal and original_id; the source's own times of modification aren't used"


def json_rows(catalog: DataFrame) -> DataFrame:
    """K1: one JSON text for each row, nulls kept."""
    return catalog.select(_as_json().alias("value"))


def _as_json() -> Column:
    fields = [rfc3339(F.col(c)).alias(c) if c.endswith("_at") else F.col(c) for c in JSON_FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_jsonl(catalog: DataFrame, path: str) -> None:
    """K1."""
    json_rows(catalog).write.mode("overwrite").text(path)


def json_array_rows(catalog: DataFrame) -> DataFrame:
    """K2: the lines of a JSON array over all rows, by id: brackets as lines of their own, a comma after all but the last row.

    The order is kept by a range sort; only the last id and its last row are looked up. The
    brackets' places sort before and after all ids.
    """
    rows = catalog.select(F.lit(1).alias("part"), "id", F.monotonically_increasing_id().alias("row"), _as_json().alias("value"))
    last = rows.agg(F.max(F.struct("id", "row")).alias("last"))
    ended = rows.join(F.broadcast(last), F.lit(True)).withColumn("value", F.when(F.struct("id", "row") < F.col("last"), F.concat("value", F.lit(","))).otherwise(F.col("value")))
    ends = catalog.sparkSession.createDataFrame([(0, "", 0, "["), (2, "", 0, "]")], "part int, id string, row bigint, value string")
    return ended.select("part", "id", "row", "value").unionByName(ends).orderBy("part", "id", "row").select("value")


def write_json_array(catalog: DataFrame, path: str) -> None:
    """K2: a folder of text parts that are one JSON array when read in the order of their names."""
    json_array_rows(catalog).write.mode("overwrite").text(path)


def csv_rows(catalog: DataFrame) -> DataFrame:
    """K3: the columns of a CSV export, times as CSV has them."""
    return catalog.select(*[csv_time(F.col(c)).alias(c) if c.endswith("_at") else F.col(c) for c in CSV_FIELDS])


def write_csv(catalog: DataFrame, path: str) -> None:
    """K3: quotes only where needed, doubled inside."""
    csv_rows(catalog).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def file_collisions(snapshot: DataFrame) -> DataFrame:
    """K5: file names that several portals would share."""
    named = snapshot.select(file_name(F.col("portal_name")).alias("file"), "source_portal").distinct()
    return named.groupBy("file").agg(F.count("*").alias("portals")).where("portals > 1")


def snapshot_id(date: str, checksum: str) -> str:
    """From the date and the first twelve hex digits of the canonical file's SHA-256."""
    return f"snapshot-{date}-{checksum[:12]}"


def canonical_checksum(parts: list[str]) -> str:
    """SHA-256 of a file that is a folder of parts: over their checksums in ascending order, whatever the parts' names."""
    return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()


def _data_files(spark: SparkSession, folder: str) -> list[dict]:
    """Path below the folder, kind, rows, bytes and SHA-256 of every Parquet part of a snapshot."""
    found = files(spark, folder, "*.parquet")
    rows = None
    for name in ("all.parquet", "by_portal", "identity.parquet"):
        each = spark.read.parquet(f"{folder}/{name}").groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("row_count"))
        rows = each if rows is None else rows.unionByName(each)
    tail = lambda c: F.regexp_extract(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"/((all\.parquet|identity\.parquet|by_portal)/.*)$", 1)
    named = found.select(tail(F.col("path")).alias("path"), F.col("bytes").alias("size_bytes"), "sha256").join(rows.select(tail(F.col("path")).alias("path"), "row_count"), "path", "left")
    kind = F.when(F.startswith("path", F.lit("all")), "canonical").when(F.startswith("path", F.lit("identity")), "identity").otherwise("portal")
    return [r.asDict() for r in named.select("path", kind.alias("kind"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "size_bytes", "sha256").orderBy("path").collect()]


def _earlier(spark: SparkSession, previous: DataFrame | str | None) -> tuple[DataFrame | None, str | None]:
    """The identity of an earlier snapshot, if there is one to compare with, and its id, if known."""
    if not isinstance(previous, str):
        return previous, None
    try:
        return spark.read.parquet(f"{previous}/identity.parquet"), previous_snapshot_id(spark, previous)
    except AnalysisException:
        return None, None


def write_snapshot(catalog: DataFrame, portals: DataFrame, folder: str, date: str, previous: DataFrame | str | None = None, generated_at: str | None = None) -> dict:
    """K4-K9: a snapshot folder: all.parquet, by_portal, identity.parquet, manifest, reports and changelog.

    all.parquet holds the rows newest first, in the order of its parts' numbers. Everything else
    comes from what is written there, so that the catalog is read once.
    identity.parquet holds every row's key and hash with its position (pos) in that order; the
    changelog compares the first row of each key on both sides (W3), so of a record that a
    folded alias repeats the newest counts, however the catalog was partitioned. previous is the
    folder of an earlier snapshot, or an identity table as scans.identity reads it. What comes to the
    driver are the reports' aggregates, a few rows for each portal, and a row for each file; the
    buckets of formats and media types, which data may make many, are written by Spark
    (resource_buckets.json, resource_quality.json, portal_buckets.json).
    """
    spark = catalog.sparkSession
    generated_at = generated_at or datetime.now(UTC).isoformat(timespec="seconds")
    parquet = {"compression": "zstd", "maxRecordsPerFile": str(MOST_RECORDS)}
    curate.snapshot_rows(catalog, portals, ordered=True).write.mode("overwrite").options(**parquet).parquet(f"{folder}/all.parquet")
    written = spark.read.parquet(f"{folder}/all.parquet")
    if clash := file_collisions(written).first():
        raise ValueError(f"{clash['portals']} portals share the file name {clash['file']}")
    by_portal = written.withColumn("portal_file", file_name(F.col("portal_name"))).hint("rebalance", "portal_file")  # large portals are split by their bytes
    by_portal.write.mode("overwrite").partitionBy("portal_file").options(**parquet).parquet(f"{folder}/by_portal")
    keys = scans.with_positions(spark, f"{folder}/all.parquet").select(*store.KEY, "content_hash", "pos")
    keys.write.mode("overwrite").options(**parquet).parquet(f"{folder}/identity.parquet")
    identity = spark.read.parquet(f"{folder}/identity.parquet")
    data = _data_files(spark, folder)
    name = snapshot_id(date, canonical_checksum([f["sha256"] for f in data if f["kind"] == "canonical"]))

    counts = written.agg(F.count("*").alias("exported"), F.count_if("is_duplicate").alias("duplicate_flagged")).first().asDict()
    raw = catalog.count()
    curation = {"raw": raw, "exported": counts["exported"], "filtered": raw - counts["exported"], "duplicate_flagged": counts["duplicate_flagged"]}
    rule = {"method": "title-exact-ci-cross-portal", "version": "1", "alias_groups": quality.alias_groups(portals).first()[0], "note": "Equal titles on several portals; a hint, not an identity."}
    excluded = [r["name"] for r in quality.excluded_portals(portals, written).collect()]
    repeats = scans.collisions(identity).first()["collisions"] or 0
    warnings = [f"{repeats} rows repeat a key, of which the first counts"] * (repeats > 0) + [f"no rows of {len(excluded)} enabled portals"] * bool(excluded)
    per_portal = [r.asDict() | {"status": "included", "file": f"by_portal/portal_file={r['file']}"} for r in quality.per_portal(written).withColumn("file", file_name(F.col("portal_name"))).collect()]
    head = {"schema_version": SCHEMA_VERSION, "snapshot_id": name, "snapshot_date": date, "generated_at": generated_at}
    manifest = head | {
        "dataset_schema": {"version": SCHEMA_VERSION, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in written.schema]},
        "portal_config": {"sha256": runlog.config_checksum(portals).first()[0]},
        "duplicate_detection": rule,
        "row_counts": curation,
        "canonical_file": "all.parquet",
        "files": data,
        "portals": per_portal,
        "warnings": warnings,
    }
    quality.resource_buckets(written).write.mode("overwrite").json(f"{folder}/resource_buckets.json")
    quality.portal_buckets(written).write.mode("overwrite").json(f"{folder}/portal_buckets.json")
    per_bucket = spark.read.schema("source_portal string, facet string, bucket string, n bigint").json(f"{folder}/portal_buckets.json")
    quality.portal_top_buckets(per_bucket).write.mode("overwrite").json(f"{folder}/portal_top_buckets.json")
    quality.resource_quality(written).write.mode("overwrite").json(f"{folder}/resource_quality.json")
    coverage = [r.asDict() for r in quality.coverage(written).collect()]
    distinct = {"format": 0, "media_type": 0}
    buckets = spark.read.schema("facet string, bucket string, n bigint").json(f"{folder}/resource_buckets.json")
    for facet in distinct:  # the largest; resource_buckets.json has all
        own = buckets.where(F.col("facet") == facet)
        distinct[facet] = own.count()
        coverage += [{"dimension": facet, "bucket": r["bucket"], "n": r["n"]} for r in own.orderBy(F.col("n").desc(), "bucket").limit(MOST_BUCKETS).collect()]
    reports = head | {
        "totals": {"datasets": counts["exported"], "portals": len(per_portal)},
        "distinct_buckets": distinct,
        "curation": curation | {"duplicate_detection_method": rule["method"], "duplicate_detection_version": rule["version"], "excluded_portals": excluded},
        "coverage": coverage,
        "completeness": [r.asDict() for r in quality.completeness(written).collect()],
        "resource_quality_by_portal": [r.asDict() for r in quality.resource_quality(written).orderBy("source_portal").collect()],
    }
    before, before_id = _earlier(spark, previous)
    log: dict = head | {"previous_snapshot_id": before_id, "compared": before is not None, "changed_definition": CHANGED, "portals": []}
    if before is not None:
        log["portals"] = [r.asDict() for r in store.changelog(store.changes(scans.identity(identity), scans.identity(before))).collect()]
    log["total"] = {k: sum(p[k] for p in log["portals"]) for k in ("added", "changed", "removed", "unchanged")}
    for file, content in (("metadata.json", json.dumps(manifest)), ("reports.json", json.dumps(reports)), ("changelog.json", json.dumps(log)), ("report.md", report_markdown(name, reports)), ("changelog.md", changelog_markdown(name, log))):
        _write_text(catalog, f"{folder}/{file}", content)
    return manifest


def _write_text(catalog: DataFrame, path: str, content: str) -> None:
    """Write one small document as a folder of one text file."""
    catalog.sparkSession.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _table(title: str, header: tuple[str, str], rows: list[tuple], total: int | None = None) -> list[str]:
    """A Markdown table of the first rows, and how many more there are (of total, where rows are the largest only)."""
    out = [f"## {title}", "", f"| {header[0]} | {header[1]} |", "| --- | --- |"]
    out += [f"| {a} | {b} |" for a, b in rows[:BUCKETS_SHOWN]]
    more = (len(rows) if total is None else total) - BUCKETS_SHOWN
    return [*out, *([f"| {more} more | |"] if more > 0 else []), ""]


def report_markdown(name: str, reports: dict) -> str:
    """K8."""
    out = [f"# Snapshot {name}", ""]
    c = reports["curation"]
    out += _table("Curation", ("outcome", "rows"), [(k, c[k]) for k in ("raw", "exported", "filtered", "duplicate_flagged")])
    for dimension in ("type", "profile", "language", "portal", "format", "media_type"):
        rows = [(r["bucket"], r["n"]) for r in reports["coverage"] if r["dimension"] == dimension]
        out += _table(f"Rows by {dimension}", (dimension, "rows"), rows, reports["distinct_buckets"].get(dimension))
    out += _table("Completeness", ("facet", "rate"), [(r["facet"], r["rate"]) for r in reports["completeness"]])
    return "\n".join(out + _table("Datasets with resources", ("portal", "datasets with resources of all"), [(r["source_portal"], f"{r['with_resources']} of {r['datasets']}") for r in reports["resource_quality_by_portal"]]))


def changelog_markdown(name: str, log: dict) -> str:
    """K9."""
    if not log["compared"]:
        return f"# Changes in {name}\n\nNo earlier snapshot to compare with.\n"
    rows = [(p["source_portal"], f"+{p['added']} ~{p['changed']} -{p['removed']}") for p in log["portals"]]
    since = f"Compared with {log['previous_snapshot_id'] or 'an earlier snapshot'}. Changed: {log['changed_definition']}."
    return "\n".join([f"# Changes in {name}", "", since, "", *_table("Portals", ("portal", "changes"), rows)])
