"""Similarity search over embedded catalog rows, and the embedding pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lodestar.functions.text import content_hash
from lodestar.operators.curate import is_pending, is_searchable

DEFAULT_LIMIT, MOST_LIMIT = 10, 100
#: Queries that are sent to every task as one broadcast; more of them meet the rows in blocks.
BROADCAST_QUERIES = 1000
#: Queries and rows of a block, about, and rows that meet a block's queries at a time.
BLOCK_QUERIES, BLOCK_ROWS, STEP_ROWS = 1000, 20_000, 5000
PROJECTION = ["id", "title", "description", "url", "source_portal", "record_kind"]


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """M6: cosine similarity in doubles; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def search(catalog: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """For each query (query_id, query) the searchable rows of the largest cosine, score as float.

    Ties go to the smaller id, rows without a cosine (a zero vector) come last. At most MOST_LIMIT rows for each
    query. Up to BROADCAST_QUERIES queries are sent to all tasks, which take ids and vectors alone
    in blocks and keep the best of each query; the columns shown are read for what is left, at
    most queries x limit rows. More queries are dealt to blocks, as are the rows, and each block of
    queries meets each of rows in the same way, a pair of blocks at a time.
    """
    limit = max(1, min(limit, MOST_LIMIT))
    asked = queries.select("query_id", "query").limit(BROADCAST_QUERIES + 1).collect()
    if len(asked) > BROADCAST_QUERIES:
        return _search_many(catalog.where(is_searchable()), queries.select("query_id", "query"), limit)
    rows = catalog.where(is_searchable())
    kind = queries.schema["query_id"].dataType
    found = rows.select("id", "embedding").mapInArrow(_best(asked, limit, kind), _found(kind))
    return _with_columns_shown(rows, F.broadcast(_ranked(found, limit)))  # at most BROADCAST_QUERIES x MOST_LIMIT rows


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc_nulls_last(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def _with_columns_shown(rows: DataFrame, best: DataFrame) -> DataFrame:
    return rows.select(*PROJECTION).join(best, "id").select("query_id", *PROJECTION, "similarity_score", "rank")


def _found(kind: DataType) -> str:
    return f"query_id {kind.simpleString()}, id string, similarity_score float"


def _best(asked: list, limit: int, kind: DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (id, embedding) that gives the best rows of each query in a partition."""
    arrow = to_arrow_type(kind)
    by_size: dict[int, list] = {}
    for q in asked:
        if q["query"] is not None:
            by_size.setdefault(len(q["query"]), []).append(q)
    blocks = {d: (pa.array([q["query_id"] for q in own], arrow), np.array([q["query"] for q in own], np.float64).reshape(len(own), d)) for d, own in by_size.items()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {d: Best(matrix, limit) for d, (_, matrix) in blocks.items()}
        for batch in batches:
            vectors = batch.column(1)
            ends = vectors.offsets.to_numpy()
            sizes, flat = np.diff(ends), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for d, best in kept.items():
                at = np.flatnonzero(sizes == d)
                if len(at):
                    best.add(ids[at], flat[ends[at][:, None] + np.arange(d)])
        for d, best in kept.items():
            query, row, score = best.result()
            columns = [blocks[d][0].take(pa.array(query, pa.int64())), pa.array(row, pa.string()), pa.array(score, pa.float32(), mask=np.isnan(score))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "similarity_score"])

    return apply


class Best:
    """The rows of the largest cosine with each query so far; equal scores by id, rows without a score last."""

    def __init__(self, queries: np.ndarray, limit: int) -> None:
        self.queries, self.limit = queries, limit
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = queries / np.sqrt((queries**2).sum(axis=1, keepdims=True))
        self.rows: list[list[tuple[float, str]]] = [[] for _ in queries]  # (-score, id); no score is infinite

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Meet more rows: one product of matrices tells which may be among the best, and those are scored exactly."""
        with np.errstate(invalid="ignore", divide="ignore"):
            norms = np.sqrt((x**2).sum(axis=1))
            rough = self.unit @ (x / norms[:, None]).T
        rough[~np.isfinite(rough)] = -2
        for q, near in enumerate(rough):
            own = self.rows[q]
            floor = -own[-1][0] if len(own) >= self.limit else -np.inf
            if len(near) > self.limit:
                floor = max(floor, np.partition(near, -self.limit)[-self.limit])
            at = np.flatnonzero(near >= floor - 1e-6)
            if not len(at):
                continue
            with np.errstate(invalid="ignore", divide="ignore"):
                exact = (x[at] * self.queries[q]).sum(axis=1) / (norms[at] * np.sqrt((self.queries[q] ** 2).sum()))
            score = exact.astype(np.float32).astype(np.float64)
            score[np.isnan(score)] = -np.inf
            self.rows[q] = sorted([*own, *zip((-score).tolist(), ids[at].tolist(), strict=True)])[: self.limit]

    def result(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        query = np.repeat(np.arange(len(self.rows)), [len(own) for own in self.rows])
        score = np.array([-s for own in self.rows for s, _ in own], np.float32)
        score[np.isneginf(score)] = np.nan
        return query, [i for own in self.rows for _, i in own], score


def _search_many(rows: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The search for any number of queries: a task holds one block of rows and one of queries, whatever the number of either."""
    kind = queries.schema["query_id"].dataType
    slots, blocks = (max(1, -(-table.count() // most)) for table, most in ((rows.select("id"), BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    place = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("id", "embedding", place(slots, "id").alias("slot")).withColumn("block", every(blocks))
    sent = queries.withColumn("block", place(blocks, "query_id", "query")).withColumn("slot", every(slots))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        batches = own.select(["id", "embedding"]).to_batches(max_chunksize=STEP_ROWS)
        out = list(_best(asked.select(["query_id", "query"]).to_pylist(), limit, kind)(iter(batches)))
        return pa.Table.from_batches(out, pa.schema([("query_id", to_arrow_type(kind)), ("id", pa.string()), ("similarity_score", pa.float32())]))

    found = dealt.groupBy("slot", "block").cogroup(sent.groupBy("slot", "block")).applyInArrow(meet, _found(kind))
    return _with_columns_shown(rows, _ranked(found, limit))


def pending(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows to embed, last updated first."""
    rows = catalog.where(is_pending()).orderBy(F.col("last_updated_at").desc(), "id")
    return rows.limit(limit) if limit is not None else rows


def pending_count(catalog: DataFrame) -> DataFrame:
    """number of rows to embed, of any kind."""
    return catalog.where(is_pending(any_kind=True)).agg(F.count("*").alias("pending"))


@dataclass(frozen=True)
class Provider:
    """An embedding provider: its name, the vectors' dimension, the most texts that it takes at once, and the call itself."""

    name: str
    dimension: int
    max_batch_size: int
    generate: Callable[[list[str]], np.ndarray]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """One vector for each text, in calls of at most max_batch_size texts."""
        vectors = []
        for i in range(0, len(texts), self.max_batch_size):
            part = texts[i : i + self.max_batch_size]
            found = np.asarray(self.generate(part), np.float32)
            if len(found) != len(part):
                raise ValueError(f"{self.name}: {len(found)} vectors for {len(part)} texts")
            if found.ndim != 2 or found.shape[1] != self.dimension:
                raise ValueError(f"{self.name}: vectors of shape {found.shape[1:]} instead of {self.dimension} components")
            vectors.append(found)
        return np.concatenate(vectors) if vectors else np.zeros((0, self.dimension), np.float32)


def length_provider(dimension: int = 8, max_batch_size: int = 500) -> Provider:
    """A deterministic stand-in for a model: component i of a text is (its UTF-8 length + i) / 1000."""

    def embed(texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t.encode()) for t in texts], np.float64)
        return ((sizes[:, None] + np.arange(dimension)) / 1000).astype(np.float32)

    return Provider("length", dimension, max_batch_size, embed)


def embed(rows: DataFrame, provider: Provider) -> DataFrame:
    """Id, embedding and content_hash (kept, or computed where it is null) of the rows.

    Texts are title and description. A provider that returns another number of vectors than
    it got texts, or vectors of another dimension than its own, fails the batch.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["id", "content_hash"]].assign(embedding=provider(pdf["text"].tolist()).tolist())[["id", "embedding", "content_hash"]]

    hashed = F.coalesce("content_hash", content_hash(F.col("title"), F.col("description")))
    texts = rows.select("id", hashed.alias("content_hash"), F.trim(F.concat(F.col("title"), F.lit(" "), F.coalesce("description", F.lit("")))).alias("text"))
    return texts.mapInPandas(apply, "id string, embedding array<float>, content_hash string")


def write_back(catalog: DataFrame, embedded: DataFrame, now: Column) -> DataFrame:
    """The catalog with new vectors and hashes; a row's kind is preserved."""
    new = embedded.select("id", F.col("embedding").alias("__vector"), F.col("content_hash").alias("__hash"))
    joined = catalog.join(new, "id", "left")
    hit = F.col("__vector").isNotNull()
    return joined.withColumns(
        {"embedding": F.coalesce("__vector", "embedding"), "content_hash": F.coalesce("__hash", "content_hash"), "last_updated_at": F.when(hit, now).otherwise(F.col("last_updated_at"))}
    ).drop("__vector", "__hash")


def dimension_errors(catalog: DataFrame, dimension: int) -> DataFrame:
    """Number of vectors, and of those that haven't the configured dimension."""
    return catalog.agg(F.count("embedding").alias("vectors"), F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != dimension)).alias("wrong"))
