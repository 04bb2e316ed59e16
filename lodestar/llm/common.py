"""Helpers that the text and vector operators share.

The array helpers work on whole Arrow batches inside a task: texts are laid out as one
array of code points, so that splitting and hashing cost a few passes over the array and
no Python call per word.
"""

from __future__ import annotations

import tempfile
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stand-in for a null id: sorts below every other id.
NULL_ID = -(2**63)
OTHER, LETTER, DIGIT, SPACE, UNKNOWN, EDGE = 0, 1, 2, 3, 4, 5
#: Code points of the Unicode property White_Space (fixed values).
WHITE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: Code points that one task lays out at a time.
CHUNK_CHARS = 1_000_000
#: Most rows and about as many bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder that all executors share and forget its lineage.

    The folder is the one of spark.checkpoint.dir; only a local session without one (a test)
    gets a folder of its own, a cluster's fails.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches kept to a few megabytes: texts can be long.

    An executor holds several batches for each of its tasks, in and out of Python.
    """
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def like(df: DataFrame, columns: str) -> str:
    """The DDL of df's columns and further ones."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), columns])


@cache
def classes() -> np.ndarray:
    """The class (letter, number, white space, other) of every code point.

    Code points that this Python's Unicode tables don't know are UNKNOWN: other libraries
    may know them.
    """
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            out[i] = LETTER
        elif kind[0] == "N":
            out[i] = DIGIT
        elif kind == "Cn":
            out[i] = UNKNOWN
    out[list(WHITE)] = SPACE
    return out


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Layout:
    """Texts as one array of code points, a line feed before each and after the last."""

    cp: np.ndarray  # uint32
    first: np.ndarray  # of each text in cp
    n: int

    @staticmethod
    def of(texts: list[str]) -> Layout:
        joined = "\n" + "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.ones(len(texts), np.int64)
        np.cumsum(lengths[:-1] + 1, out=first[1:])
        first[1:] += 1
        return Layout(cp, first, len(texts))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text of each position; positions ascend."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, self.first), append=len(at)))


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    inverse = pow(_BASE, -1, 2**64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((up, _BASE), (down, inverse)):
        out[0] = 1
        have = 1
        while have < n:  # doubling
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, 2**64))
            have += more
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def run_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each cp[start:end], by differences of one running sum."""
    size = 1 << max(16, int(len(cp)).bit_length())
    up, down = _powers(size)
    c = (cp.astype(np.uint64) + np.uint64(1)) * _K2
    c ^= c >> np.uint64(31)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(c * up[: len(cp)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words_of(layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters and numbers."""
    kind = classes()[layout.cp]
    inside = (kind == LETTER) | (kind == DIGIT)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star contraction: each round is joins and grouped
    minima over the edges, its result lies in the shared folder. An empty edge table
    gives an empty result. Nodes must not be null.
    """
    now = cut(_small_star(edges.where("a <> b").select("a", "b")))
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == seen:
            return _labelled(now)
        seen = state
        now = cut(_small_star(_large_star(now)))
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _labelled(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
