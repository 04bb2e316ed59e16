"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into equal segments; from two vectors' segment means and deviations follows a
lower bound of their distance, and with the norms an upper bound of their inner product:
within a segment of m components, x.y <= m (mean_x mean_y + dev_x dev_y). Coarse bounds
(few segments) are cheap and weak, finer ones tighter. They are applied coarse to fine, each
to the queries and rows of which a pair is left, and exact products decide among the survivors.
A query's floor, which a pair's bound must reach, is the k-th best score so far, raised at each
resolution by the exact scores of the rows of its best bounds.

How much the bounds discard depends on the vectors, see the README: on vectors without
structure nothing, on clustered ones most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import small_batches

#: Segments of each resolution, coarse to fine.
RESOLUTIONS = (1, 4, 16)
#: Queries and candidates that meet in one step.
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Shares of the rows, to each of which all queries are sent, where few rows would make fewer.
LEAST_SLOTS = 48
#: Blocks of queries that a task keeps between blocks of rows, with the best rows so far.
MOST_KEPT = 32
#: Share of pairs left above which one product of matrices costs less than pair by pair.
DENSE = 0.02
#: Score of a place that no row has taken; scores of rows are above it.
EMPTY = -(2**63)
#: Scaled components are below this in magnitude, so that their floors fit into a long.
MOST = 2**63


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x, the components floor(scale * component), of the vectors that take part.

    Vectors that are null or hold null or non-finite components don't, nor do those with a
    component of at least MOST after scaling, whose floor no long holds.
    """
    scaled = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(F.lit(float(scale)) * c.cast("double")) >= F.lit(float(MOST))))
    return vectors.where("embedding is not null").where(~F.coalesce(bad, F.lit(True))).select("vec_id", scaled.alias("x"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Dimension, ids, whether they are null, and matrix of the vectors of each length in a batch (vec_id, x)."""
    x, own = batch.column("x"), batch.column("vec_id")
    ids, none = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False)
    offsets = x.offsets.to_numpy()
    sizes, flat = np.diff(offsets), x.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), ids[at], none[at], flat[offsets[at][:, None] + np.arange(d)].astype(np.int64)


def _segments(x: np.ndarray) -> list[np.ndarray]:
    """For each resolution the scaled means and deviations; their inner products are the bounds."""
    out = []
    for n in RESOLUTIONS:
        parts = np.array_split(x, min(n, max(1, x.shape[1])), axis=1)
        size = [np.sqrt(max(1, p.shape[1])) for p in parts]
        mean = [p.mean(axis=1) * s if p.shape[1] else np.zeros(len(p)) for p, s in zip(parts, size, strict=True)]
        dev = [p.std(axis=1) * s if p.shape[1] else np.zeros(len(p)) for p, s in zip(parts, size, strict=True)]
        out.append(np.stack(mean + dev, axis=1))
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and rows of b, pairwise; exact in doubles where they suffice."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(int(u) * int(v) for u, v in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True)], object).clip(-(2**63) + 1, 2**63 - 1).astype(np.int64)


class Search:
    """The k best of the rows seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.stats = _segments(x.astype(np.float64))
        self.score = np.zeros((len(ids), 0), np.int64)
        self.best = np.zeros((len(ids), 0), np.int64)
        self.none = np.zeros((len(ids), 0), bool)  # best rows without an id
        self.own = np.zeros(len(ids), np.int64)  # rows equal to the query, itself included
        self.keys = [hashlib.blake2b(v.astype("<i8").tobytes(), digest_size=16).digest() for v in x]  # tell queries of one id apart
        self.self_score = _exact(x, x).astype(np.float64)
        self.left = np.zeros(len(RESOLUTIONS) + 1, np.int64)  # pairs: all, and after each resolution

    def add(self, ids: np.ndarray, x: np.ndarray, none: np.ndarray | None = None) -> None:
        """Compare all queries with more rows: bounds coarse to fine, then exact products of what is left.

        none tells rows without an id, whatever stands in ids for it, from those of any 64-bit id.
        """
        none = np.zeros(len(ids), bool) if none is None else none
        floor = np.full(len(self.ids), -np.inf)
        if self.score.shape[1] >= self.k:
            last = self.score[:, self.k - 1]
            floor = np.where(last > EMPTY, np.minimum(last.astype(np.float64), self.self_score), -np.inf)
        slack = self._slack(x)
        qs, rs = np.arange(len(self.ids)), np.arange(len(ids))
        near = np.ones((len(qs), len(rs)), bool)
        self.left[0] += near.size
        for level, (mine, theirs) in enumerate(zip(self.stats, _segments(x.astype(np.float64)), strict=True), 1):
            bound = mine[qs] @ theirs[rs].T + slack[qs, None]
            bound[~near] = -np.inf
            floor[qs] = np.maximum(floor[qs], self._reached(bound, qs, rs, ids, none, x))
            near &= bound >= floor[qs, None]
            self.left[level] += int(near.sum())
            some_q, some_r = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            qs, rs, near = qs[some_q], rs[some_r], near[np.ix_(some_q, some_r)]
        q, r, score = self._scores(qs, rs, near, x)
        same = np.flatnonzero((ids[r] == self.ids[q]) & ~none[r])
        equal = same[(self.x[q[same]] == x[r[same]]).all(axis=1)]
        np.add.at(self.own, q[equal], 1)
        stay = score >= floor[q]
        stay[equal] = False
        self._merge(q[stay], ids[r[stay]], none[r[stay]], score[stay])

    def _reached(self, bound: np.ndarray, qs: np.ndarray, rs: np.ndarray, ids: np.ndarray, none: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A score that k rows reach for each query of qs, from the rows of the best bounds.

        It is never above the query's product with itself, so that equal rows are always met.
        """
        if len(rs) <= 4 * self.k:
            return np.full(len(qs), -np.inf)
        top = np.argpartition(-bound, 2 * self.k, axis=1)[:, : 2 * self.k]
        exact = _exact(self.x[np.repeat(qs, top.shape[1])], x[rs[top.ravel()]]).reshape(top.shape).astype(np.float64)
        exact[(ids[rs[top]] == self.ids[qs, None]) & ~none[rs[top]]] = -np.inf
        return np.minimum(np.sort(exact, axis=1)[:, -self.k], self.self_score[qs])

    def _scores(self, qs: np.ndarray, rs: np.ndarray, near: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and exact score of the pairs that are left."""
        most = float(np.abs(self.x).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        a, b = np.nonzero(near)
        if near.size and len(a) > DENSE * near.size and most < 2**53:
            return qs[a], rs[b], (self.x[qs].astype(np.float64) @ x[rs].astype(np.float64).T)[a, b].astype(np.int64)
        q, r = qs[a], rs[b]
        parts = [_exact(self.x[q[i : i + 200_000]], x[r[i : i + 200_000]]) for i in range(0, len(q), 200_000)]
        return q, r, np.concatenate(parts or [np.zeros(0, np.int64)])

    def _slack(self, x: np.ndarray) -> np.ndarray:
        """More than the rounding errors of a query's bounds, which grow with the vectors' norms, not with the bound."""
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
        return np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1)) * norms * 1e-9 + 1e-6

    def _merge(self, q: np.ndarray, ids: np.ndarray, none: np.ndarray, score: np.ndarray) -> None:
        old = np.repeat(np.arange(len(self.ids)), self.score.shape[1])
        keep = self.score.ravel() > EMPTY
        q = np.concatenate((old[keep], q))
        ids = np.concatenate((self.best.ravel()[keep], ids))
        none = np.concatenate((self.none.ravel()[keep], none))
        score = np.concatenate((self.score.ravel()[keep], score))
        order = np.lexsort((ids, none, -score, q))
        q, ids, none, score = q[order], ids[order], none[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        width = min(self.k, int(rank.max(initial=-1)) + 1)
        self.best = np.zeros((len(self.ids), width), np.int64)
        self.none = np.zeros((len(self.ids), width), bool)
        self.score = np.full((len(self.ids), width), EMPTY, np.int64)
        self.best[q[top], rank[top]] = ids[top]
        self.none[q[top], rank[top]] = none[top]
        self.score[q[top], rank[top]] = score[top]

    def result(self) -> pa.RecordBatch:
        """The best rows of each query, and for queries met in rows equal to them the number of those in own."""
        q, rank = np.nonzero(self.score > EMPTY)
        own = np.flatnonzero(self.own)
        columns = [
            pa.array(np.concatenate((self.ids[q], self.ids[own])), pa.int64()),
            pa.array(np.concatenate((self.best[q, rank], self.ids[own])), pa.int64(), mask=np.append(self.none[q, rank], np.zeros(len(own), bool))),
            pa.array(np.concatenate((self.score[q, rank], _exact(self.x[own], self.x[own]))), pa.int64()),
            pa.array(np.concatenate((np.zeros(len(q), np.int64), self.own[own])), pa.int64()),
            pa.array([self.keys[i] for i in [*q.tolist(), *own.tolist()]], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "own", "key"])


def _packed(dim: int, ids: np.ndarray, none: np.ndarray, x: np.ndarray) -> dict:
    """A block as bytes; components of 32 bits where all fit."""
    small = np.abs(x).max(initial=0) < 2**31
    return {"dim": dim, "ids": ids.astype("<i8").tobytes(), "none": np.packbits(none).tobytes(), "x": x.astype("<i4" if small else "<i8").tobytes()}


def _unpacked(dim: int, ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    kind = "<i4" if len(x) == 4 * dim * len(ids) else "<i8"
    return ids, np.frombuffer(x, kind).astype(np.int64).reshape(len(ids), dim)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` vectors of one dimension: block, dim, ids, none (bits), x (bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_packed(dim, *map(np.concatenate, zip(*held.pop(dim), strict=True)))], schema)

        for batch in batches:
            for dim, *block in _rows(batch):
                for i in range(0, len(block[0]), size):
                    part = tuple(a[i : i + size] for a in block)
                    if dim in held and sum(len(p[0]) for p in held[dim]) + len(part[0]) > size:
                        yield out(dim)
                    held.setdefault(dim, []).append(part)
        for dim in list(held):
            yield out(dim)

    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("none", pa.binary()), ("x", pa.binary())])
    return rows.mapInArrow(pack, "dim int, ids binary, none binary, x binary").withColumn("block", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query, by integer inner product.

    vectors has vec_id and embedding; components become floor(scale * component). Queries
    are the rows whose vec_id is divisible by `every`, candidates all rows but the
    query's own; equal scores go to the smaller vec_id. Queries and candidates meet block
    by block, every block of queries with every block of rows of the same dimension; a
    block holds a bounded number of vectors, and each pair of blocks returns at most k rows
    for each query. Both are shuffled, none is broadcast, and the search runs once; queries
    are sent about as often as there are blocks of rows, or shuffle partitions if these are
    fewer. The rows are counted first.

    Vectors that are null or hold null or non-finite components take no part, nor do those
    with a component whose floor doesn't fit into a long (2^63 / scale or more). A score that
    doesn't fit is given, and compared, as the nearest long above -2^63. A null vec_id
    is no query and comes after all ids among equal scores. A repeated row is another row:
    it is a candidate for its copies and, if a query, answered as often as it is there.
    Other columns are left out; an empty table gives an empty result.
    """
    rows = integers(small_batches(vectors), scale)
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "x").distinct()
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = min(spread, max(LEAST_SLOTS, -(-vectors.count() // ROW_BLOCK)))
    blocks = _blocks(rows, ROW_BLOCK).withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    # every block of queries goes to all slots, a block of rows to one; Spark takes what explode makes for as
    # small as what it is made of, and would broadcast it
    queries = _blocks(asked, QUERY_BLOCK).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    sent = queries.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    pairs = blocks.join(sent.hint("merge"), ["slot", "dim"]).select("dim", "q_block", "q_ids", "q_x", "ids", "none", "x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Search] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block, dim = row["q_block"], row["dim"]
                if block not in kept:
                    if len(kept) >= MOST_KEPT:
                        yield kept.pop(next(iter(kept))).result()
                    kept[block] = Search(*_unpacked(dim, row["q_ids"], row["q_x"]), k)
                ids, x = _unpacked(dim, row["ids"], row["x"])
                none = np.unpackbits(np.frombuffer(row["none"], np.uint8), count=len(ids)).astype(bool)
                kept[block].add(ids, x, none)
        for found in kept.values():
            yield found.result()

    hits = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint, own bigint, key binary")
    mine = Window.partitionBy("query_id", "key")
    # rows equal to the query come as counts, one of them is the query itself; all other steps are windows of the same
    # key, so that the hits are shuffled once and the search isn't repeated
    counted = hits.withColumn("times", F.sum("own").over(mine)).withColumn("nth", F.row_number().over(mine.orderBy(F.col("own").desc())))
    copies = F.when(F.col("own") == 0, 1).when(F.col("nth") == 1, F.least(F.col("times") - 1, F.lit(k))).otherwise(0)
    each = counted.withColumn("n", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    best = each.withColumn("rank", F.row_number().over(mine.orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))).where(F.col("rank") <= k)
    repeated = best.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select("query_id", "rank", "vec_id", "score")
