"""Language identification: each document is a mixture of languages, inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LETTER, Layout, chunks, classes, held_out, mixed, small_batches

BITS = 16
#: About so many documents of each language are learnt.
DOCS_PER_LANGUAGE = 2000
#: Weight of the smoothing: a bin counts as if met so often.
SMOOTHING = 0.5
ROUNDS = 8
#: Log-likelihood, times the log of the number of words, that a further language must gain.
PENALTY = 3.0
#: Share below which a language has no part in a document, after two rounds; what rounding may add to a likelihood.
LEAST_SHARE, SLACK = 1e-3, 1.0
BLANK = np.uint32(32)


def _letters(layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters."""
    inside = classes()[layout.cp] == LETTER
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2]


def grams(layout: Layout, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the trigram around each letter (blanks stand beyond a word's ends), and each word's first."""
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(start - first, size)
    c = layout.cp[at].astype(np.uint64)
    before, after = layout.cp[at - 1].astype(np.uint64), layout.cp[at + 1].astype(np.uint64)
    before[first] = BLANK
    after[first + size - 1] = BLANK
    return (mixed(before << np.uint64(42) ^ c << np.uint64(21) ^ after) >> np.uint64(64 - BITS)).astype(np.int64), first


@dataclass
class Model:
    """Log-probabilities of the bins under each language."""

    languages: list[str]
    table: np.ndarray  # bins x languages, float32

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its share of each text."""
        names, shares = [], np.zeros(len(texts))
        most = max(100_000, 4_000_000 // max(4, len(self.languages)))
        for a, b in chunks(texts, most):
            names += self._of_part(texts[a:b], shares[a:b])
        return names, shares

    def _of_part(self, texts: list[str], shares: np.ndarray) -> list[str]:
        layout = Layout.of([x.lower() for x in texts])
        start, end = _letters(layout)
        if not len(start) or not self.languages:
            return ["und"] * len(texts)
        bins, first = grams(layout, start, end)
        words = np.add.reduceat(self.table[bins], first, axis=0)
        edges = np.searchsorted(start, layout.first)
        count = np.diff(edges, append=len(start))
        some = np.flatnonzero(count)
        share = mixture(words, edges[some], count[some])
        best = share.argmax(axis=1)
        shares[some] = share[np.arange(len(some)), best]
        names = ["und"] * len(texts)
        for i, k in zip(some.tolist(), best.tolist(), strict=True):
            names[i] = self.languages[k]
        return names


def _em(words: np.ndarray, first: np.ndarray, count: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document's allowed languages, and its log-likelihood under them."""
    top = words.max(axis=1)
    like = np.exp(np.maximum(words - top[:, None], -60))
    base = np.add.reduceat(top, first).astype(np.float64)
    share = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        joint = like * np.repeat(share, count, axis=0)
        total = np.maximum(joint.sum(axis=1), np.float32(1e-30))
        share = np.add.reduceat(joint / total[:, None], first, axis=0) / count[:, None].astype(np.float32)
    total = np.maximum((like * np.repeat(share, count, axis=0)).sum(axis=1), np.float32(1e-30))
    return share, base + np.add.reduceat(np.log(total), first)


def _columns(words: np.ndarray, chosen: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each document's words the columns of its chosen languages."""
    return np.take_along_axis(words, np.repeat(chosen, count, axis=0), axis=1)


def mixture(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Language shares of each document from its words' log-likelihoods.

    Two rounds of expectation-maximisation over all languages leave a document those with a share of
    LEAST_SHARE; the full number of rounds orders them. Then the sets of the 1, 2, ... largest are
    fitted, and the set of the best penalised likelihood stays. No set is likelier than all
    languages together, so a document is done once the penalty of a further language outweighs what it could gain:
    few sets are fitted, however many languages there are.
    """
    n, k = len(first), words.shape[1]
    share, _ = _em(words, first, count, np.ones((n, k), np.float32), 2)
    ranked = np.argsort(-share, axis=1, kind="stable")
    width = max(1, int((share >= LEAST_SHARE).sum(axis=1).max(initial=1)))
    ranked = np.sort(ranked[:, :width], axis=1)
    words = words if width == k else _columns(words, ranked, count)
    share, most = _em(words, first, count, np.ones((n, width), np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    price = PENALTY * np.log(count + 1.0)
    best = np.add.reduceat(words.astype(np.float64), first, axis=0)[np.arange(n), order[:, 0]]
    found = np.zeros((n, width), np.float32)
    found[np.arange(n), order[:, 0]] = 1
    for size in range(2, width + 1):
        at = np.flatnonzero(most + SLACK - price * (size - 1) > best)
        if not len(at):
            break
        if size == width:
            fitted, value = share[at], most[at]
        else:
            some = np.zeros(n, bool)
            some[at] = True
            own, top = count[at], order[at, :size]
            part, value = _em(_columns(words[np.repeat(some, count)], top, own), np.cumsum(own) - own, own, np.ones((len(at), size), np.float32), ROUNDS // 2)
            fitted = np.zeros((len(at), width), np.float32)
            np.put_along_axis(fitted, top, part, axis=1)
        value = value - price[at] * (size - 1)
        better = value > best[at]
        best[at[better]], found[at[better]] = value[better], fitted[better]
    out = np.zeros((n, k), np.float32)
    np.put_along_axis(out, ranked, found, axis=1)
    return out


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Count letter trigrams of about docs_per_language documents of each language.

    Documents without text or language and held-out ones aren't learnt. A document joins
    the sample if its id's hash lies under its language's rate. The languages must be few
    enough for one table of bins by languages; all of them are learnt.
    """
    learnt = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in learnt.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    rate = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, docs_per_language / v))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = small_batches(learnt).where(draw < rate[F.col("lang")]).select("lang", "text")
    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            texts, of = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(of):
                own = [t.lower() for t, x in zip(texts, of, strict=True) if x == lang]
                for a, b in chunks(own):
                    layout = Layout.of(own[a:b])
                    start, end = _letters(layout)
                    if len(start):
                        total[place[lang]] += np.bincount(grams(layout, start, end)[0], minlength=1 << BITS)
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[k, i])], ["k", "i", "n"])

    counts = np.zeros((1 << BITS, len(languages)))
    for k, i, n in sample.mapInArrow(count, "k int, i int, n bigint").groupBy("k", "i").agg(F.sum("n")).toPandas().itertuples(index=False):
        counts[i, k] = n
    counts += SMOOTHING
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, ...).

    score is the predicted language's share of the text's words. A text that is null or
    has no letter is `und` with score 0, as is any text if nothing was learnt. Rows are
    independent: repeated rows and null ids come back as they are, other columns are left
    out, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares = shared.value.predict([x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(shares.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(apply, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
