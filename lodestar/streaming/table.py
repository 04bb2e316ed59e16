"""A catalog table as runs of changes that are merged by size, each run in buckets of keys."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import store

#: Columns that an incoming row replaces as a whole.
REPLACED = [c for c in store.VALUES if c != "embedding"]
#: A row of a run. Each part of it has the version at which it was set, and none where it wasn't: a
#: row's values, its vector, the time at which it was first seen, and whether it is stale.
ROW = (
    "source_portal string, original_id string, url string, title string, description string, record_kind string, metadata string, content_hash string, "
    "last_updated_at timestamp, number bigint, embedding array<float>, embedding_at bigint, first_seen_at timestamp, first_at bigint, is_stale boolean, stale_at bigint"
)
TABLE = [*store.KEY, *REPLACED, "embedding", "first_seen_at", "last_updated_at", "is_stale"]


def folded(rows: DataFrame) -> DataFrame:
    """One row for each key: of every part the value of the latest version, of first_seen_at the earliest. Folding may be done in any order and again."""
    last = F.max_by(F.struct(*REPLACED, "last_updated_at"), "number").alias("last")
    parts = [F.max_by("embedding", "embedding_at").alias("embedding"), F.max("embedding_at").alias("embedding_at"), F.min_by("first_seen_at", "first_at").alias("first_seen_at"), F.min("first_at").alias("first_at")]
    parts += [F.max_by("is_stale", "stale_at").alias("is_stale"), F.max("stale_at").alias("stale_at")]
    one = rows.groupBy(*store.KEY).agg(last, F.max("number").alias("number"), *parts)
    return one.select(*store.KEY, "last.*", "number", "embedding", "embedding_at", "first_seen_at", "first_at", "is_stale", "stale_at")


class Table:
    """Versions of a catalog in a folder; version n + 1 is what batch n makes of version n.

    A batch writes its own rows, as a run. Once there are more than merge_every runs of about one size,
    they are folded into one of the next size: a row is written once for each size that there
    is, and those are few (their number is a logarithm of the table). Runs lie in buckets of
    their keys; of merged runs only buckets in which several have rows are written anew, the
    others' files are taken over as they are. The log of a version lists its runs' files, and
    those that it no longer needs: they may be removed once no older version is read. A batch that is run
    again after a failure writes the same run and log anew.
    """

    def __init__(self, spark: SparkSession, folder: str, merge_every: int = 4, buckets: int = 16, least_bytes: int = 4 << 20) -> None:
        self.spark, self.folder, self.merge_every, self.buckets, self.least_bytes = spark, folder, merge_every, buckets, least_bytes

    # the log

    def log(self, version: int) -> dict:
        """runs (name, and files with their bytes for each bucket) and removed files of a version."""
        return json.loads(self.spark.read.text(f"{self.folder}/log/version={version}", wholetext=True).first()[0])

    def _commit(self, version: int, runs: list[dict], removed: list[str]) -> None:
        text = json.dumps({"version": version, "runs": runs, "removed": removed})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/log/version={version}")

    def _size(self, run: dict) -> int:
        """The run's tier: 0 up to least_bytes, one more for each time that it is merge_every + 1 times as large."""
        n = sum(size for files in run["files"].values() for _, size in files)
        return 0 if n <= self.least_bytes else 1 + int(math.log(n / self.least_bytes, max(2, self.merge_every + 1)))

    # runs

    def _write_run(self, rows: DataFrame, name: str) -> dict:
        path = f"{self.folder}/run={name}"
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*store.KEY), F.lit(self.buckets)))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        files: dict[str, list] = {}
        for r in found.select("path", "length", F.regexp_extract("path", r"bucket(?:=|%3D)([0-9]+)/[^/]*$", 1).alias("bucket")).collect():
            files.setdefault(r["bucket"], []).append([r["path"], r["length"]])
        return {"name": name, "files": files}

    def _rows(self, files: list[list]) -> DataFrame:
        paths = [path for path, _ in files]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def _merged(self, runs: list[dict], name: str) -> tuple[dict, list[str]]:
        """The runs as one, and the files that it replaces."""
        kept, rewritten = {}, []
        for bucket in {b for run in runs for b in run["files"]}:
            own = [run["files"][bucket] for run in runs if bucket in run["files"]]
            if len(own) == 1:
                kept[bucket] = own[0]
            else:
                rewritten += [f for files in own for f in files]
        out = self._write_run(folded(self._rows(rewritten)), name)
        out["files"] |= kept
        return out, [path for path, _ in rewritten]

    def _append(self, rows: DataFrame, number: int) -> None:
        """Write rows as the run that makes version number + 1, and merge runs of one size where there are too many."""
        version = number + 1
        runs, removed, merges = [*self.log(number)["runs"], self._write_run(rows, str(version))], [], 0
        while True:
            sizes: dict[int, list[dict]] = {}
            for run in runs:
                sizes.setdefault(self._size(run), []).append(run)
            crowded = next((own for _, own in sorted(sizes.items()) if len(own) > self.merge_every), None)
            if crowded is None:
                break
            one, gone = self._merged(crowded, f"{version}-{merges}")
            runs, removed, merges = [r for r in runs if r not in crowded] + [one], removed + gone, merges + 1
        self._commit(version, [r for r in runs if r["files"]], removed)

    # tables

    def write(self, rows: DataFrame, version: int) -> None:
        """Write a whole table as a version; what comes before it isn't needed any more."""
        none, v = F.lit(None).cast("bigint"), F.lit(version).cast("bigint")
        marks = {"number": v, "embedding_at": F.when(F.col("embedding").isNotNull(), v), "first_at": v, "stale_at": v}
        whole = rows.select(*TABLE).withColumns({k: F.coalesce(m, none) for k, m in marks.items()})
        self._commit(version, [self._write_run(whole, f"{version}-whole")], [])

    def read(self, version: int) -> DataFrame:
        """The table at a version.

        The largest run is read as it is where smaller ones have no rows in a bucket; elsewhere
        its rows are split by the changed keys, a join that is broadcast where they are few, and only
        rows of changed keys are folded.
        """
        runs = sorted(self.log(version)["runs"], key=lambda run: sum(size for files in run["files"].values() for _, size in files))
        large = runs.pop()["files"] if runs else {}
        smaller = [f for run in runs for files in run["files"].values() for f in files]
        touched = {b for run in runs for b in run["files"]}
        rows = self._rows([f for b, files in large.items() if b not in touched for f in files])
        if smaller:
            changed = folded(self._rows(smaller))
            keys, old = changed.select(*store.KEY), self._rows([f for b, files in large.items() if b in touched for f in files])
            rows = rows.unionByName(old.join(keys, store.KEY, "left_anti")).unionByName(folded(changed.unionByName(old.join(keys, store.KEY, "left_semi"))))
        return rows.where("number is not null").select(*TABLE)

    def apply(self, rows: DataFrame, number: int, now: Column) -> None:
        """Upsert a batch's rows (each key once) as store.upsert does; this makes version number + 1."""
        v = F.lit(number + 1).cast("bigint")
        stamped = rows.select(*store.KEY, *store.VALUES).withColumns(
            {"last_updated_at": now, "number": v, "embedding_at": F.when(F.col("embedding").isNotNull(), v), "first_seen_at": now, "first_at": v, "is_stale": F.lit(False), "stale_at": v}
        )
        self._append(stamped, number)

    def mark(self, keys: DataFrame, number: int) -> None:
        """Set is_stale of the keys (source_portal, original_id, is_stale; each once); this makes version number + 1. Keys that the table hasn't are left out."""
        names = [part.split()[0] for part in ROW.split(", ")]
        kinds = dict(zip(names, [part.split()[1] for part in ROW.split(", ")], strict=True))
        own = {**{c: F.col(c) for c in (*store.KEY, "is_stale")}, "stale_at": F.lit(number + 1).cast("bigint")}
        self._append(keys.select(*[own.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in names]), number)

    def removable(self, oldest: int, newest: int) -> list[str]:
        """Files that no version from `oldest` on needs, by the logs up to `newest`."""
        gone = {path for v in range(1, oldest + 1) for path in self.log(v)["removed"]}
        needed = {path for v in range(oldest, newest + 1) for run in self.log(v)["runs"] for files in run["files"].values() for path, _ in files}
        return sorted(gone - needed)
