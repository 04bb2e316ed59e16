"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Layout, chunks, held_out, mixed, run_hashes, small_batches, words_of

#: Hash space of the features; the bias has the index after the last.
BITS = 20
#: Characters whose features a task lays out at a time; each takes some 60 bytes.
CHUNK = 250_000
#: Most labelled documents of each class that training reads.
MOST_PER_CLASS = 4000
EPOCHS = 6
#: Features of fewer training documents are left out: they only let the model learn documents by heart.
LEAST_DOCS = 5
ALPHA, BETA, L2 = 1.0, 1.0, 1.0
#: L1 for each root of the number of rows: the gradients' noise on a neutral feature grows so.
L1 = 0.5
#: Letters of a word's stem; a longer word counts as its stem, too, so that rare forms of a word are known by it.
STEM = 6


@dataclass
class Weights:
    """The model: the few coordinates that L1 left, ascending, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; 0 for all if there weren't both labels to learn."""
        total = np.full(len(texts), self.bias)
        if not self.trained:
            return np.zeros(len(texts))
        dense = np.zeros(1 << BITS)
        dense[self.index] = self.weight
        for a, b in chunks(texts, CHUNK):
            for feature, owner in features(texts[a:b]):
                hit = np.flatnonzero(dense[feature])
                both = np.unique(owner[hit] << BITS | feature[hit])  # presence: once for each text
                total[a:b] += np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and text of each word, stem, bigram, trigram and skip-gram (one and two words left out)."""
    layout = Layout.of([x.lower() for x in texts])
    start, end = words_of(layout)
    h = run_hashes(layout.cp, start, end)
    owner = layout.owner(start)
    shift = np.uint64(64 - BITS)
    yield (h >> shift).astype(np.int64), owner
    long = end - start > STEM
    stem = mixed(run_hashes(layout.cp, start[long], start[long] + STEM) + np.uint64(STEM))
    yield (stem >> shift).astype(np.int64), owner[long]
    for salt, gaps in enumerate(((1,), (2,), (3,), (1, 2)), 1):
        far = gaps[-1]
        if len(h) <= far:
            return
        x = h[:-far] * np.uint64(2 * salt + 1)
        for gap in gaps:
            x = mixed(x + h[gap : len(h) - far + gap])
        same = owner[:-far] == owner[far:]
        yield (x[same] >> shift).astype(np.int64), owner[:-far][same]


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct feature indices of each text."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts, CHUNK):
        parts = [owner << BITS | feature for feature, owner in features(texts[a:b])]
        both = np.unique(np.concatenate(parts))
        cuts = np.searchsorted(both, np.arange(1, b - a) << BITS)
        out += np.split(both & ((1 << BITS) - 1), cuts)
    return out


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, least_docs: int = LEAST_DOCS) -> dict[int, float]:
    """Per-coordinate FTRL-proximal over the rows in their order; the coordinates left by L1.

    A toxic row weighs as much as the root of the number of clean rows for each toxic one.
    """
    bias = 1 << BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    met = np.zeros(bias, np.int32)
    for index, _ in rows:
        met[index] += 1  # a row's indices are distinct
    rows = [(x[met[x] >= least_docs], y) for x, y in rows]
    sparse = L1 * len(rows) ** 0.5
    toxic = sum(y for _, y in rows)
    weigh = {0: 1.0, 1: max(1.0, (len(rows) - toxic) / max(1, toxic)) ** 0.5}

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        strength = np.where(i == bias, 0.0, sparse)
        w = -(zi - np.sign(zi) * strength) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= strength, 0.0, w)

    for _ in range(epochs):
        for index, label in rows:
            i = np.append(index, bias)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * weigh[label]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    left = np.arange(bias + 1)
    w = weights(left)
    keep = np.flatnonzero(w)
    return dict(zip(keep.tolist(), w[keep].tolist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS, epochs: int = EPOCHS) -> Weights:
    """Learn from at most most_per_class labelled documents of each class.

    The sample is the labelled ids of smallest hash that aren't held out. An id with both
    labels counts as toxic, a repeated id is learnt once (its largest text). Featurising
    runs in parallel, the bounded sample is then learnt in one task, and only the
    coordinates that L1 left come back.
    """
    labelled = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(toxic > 0)")).alias("label"))
    labelled = labelled.where(~held_out(F.col("doc_id"))).withColumn("rank", F.xxhash64("doc_id"))
    kept = [labelled.where(F.col("label") == y).orderBy("rank", "doc_id").limit(most_per_class) for y in (0, 1)]
    sample = kept[0].unionByName(kept[1])
    texts = small_batches(docs).select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "label", "rank").agg(F.max("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.astype(np.int32) for x in feature_sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("rank"), pa.array([x.tobytes() for x in sets])], ["doc_id", "label", "rank", "set"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            sets = [np.frombuffer(x, np.int32) for x in batch.column("set").to_pylist()]
            ids, ranks = batch.column("doc_id").to_pylist(), batch.column("rank").to_pylist()
            rows += zip(ranks, ids, sets, batch.column("label").to_pylist(), strict=True)
        # not in the order of the sample's hash: the rarer class has a larger part of its hashes
        rows.sort(key=lambda r: (zlib.crc32(b"turn %d" % r[1]), r[1]))
        if {r[3] for r in rows} == {0, 1}:
            found = ftrl([r[2:] for r in rows], epochs)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.float64())], ["i", "w"])

    sets = texts.mapInArrow(featurise, "doc_id bigint, label int, rank bigint, set binary")
    found = sets.repartition(1).mapInArrow(learn, "i int, w double").collect()
    pairs = sorted((r.i, r.w) for r in found)
    index = np.array([i for i, _ in pairs if i < 1 << BITS], np.int64)
    weight = np.array([w for i, w in pairs if i < 1 << BITS])
    return Weights(index, weight, sum(w for i, w in pairs if i == 1 << BITS), bool(pairs))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text, ...).

    Whole texts; a null or empty text gets the score of a text without features. Rows are
    independent: repeated rows and null ids come back as they are (the checksum of a null
    id is that of empty text), other columns are left out, an empty table gives an
    empty result. If the labels lack toxic or clean documents, every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, weights: Weights, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score under the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([x or "" for x in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return small_batches(docs).mapInArrow(apply, docs.schema)
