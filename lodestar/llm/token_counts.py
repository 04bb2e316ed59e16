"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestar.llm.common import Layout, chunks, small_batches
from lodestar.llm.pretokens import MOST_BYTES, Known, byte_level, distinct, file_of, special, strange, tokenizer

NONE = np.int32(2**31 - 1)


class Merges:
    """The vocabulary's merges as arrays: rank of a pair, and the symbol that it makes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        self.key, self.rank_of = key, order[first].astype(np.int32)
        self.byte = np.array([vocab[c] for c in byte_signs()], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], NONE)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word.

        All words are merged at the same time: in a round, each applies its lowest-rank
        pair wherever it stands (of overlapping ones every second, from the left). A
        pair that a merge makes ranks above that merge, so this equals one merge at a time.
        """
        lens = np.fromiter(map(len, words), np.int64, len(words))
        out = np.ones(len(words), np.int64)
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        alive = np.arange(len(words))
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
        while len(alive):
            first = np.cumsum(lens) - lens
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                out[alive[done]] = lens[done]
                stay = np.repeat(~done, lens)
                sym, rank = sym[stay], rank[stay]
                alive, lens, least = alive[~done], lens[~done], least[~done]
                if not len(alive):
                    break
            owner = np.repeat(np.arange(len(lens)), lens)
            hit = rank == least[owner]
            if (hit[1:] & hit[:-1]).any():
                at = np.arange(len(hit))
                before = np.maximum.accumulate(np.where(hit, -1, at))
                hit &= (at - before) % 2 == 1
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            lens = lens - np.bincount(owner[at], minlength=len(lens))
            sym, rank, owner = sym[keep], rank[keep], owner[keep]
            new = at - np.arange(len(at))
            for i in (new, new[new > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                same = (owner[i] == owner[j]) & (i < j)
                rank[i] = np.where(same, self.ranks(sym[i], sym[j]), NONE)
        return out


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in plain}
    signs |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in signs)}
    return [signs[b] for b in range(256)]


@cache
def merges_of(name: str) -> Merges:
    return Merges(file_of(name))


class Counter:
    """Counts tokens, remembering the pre-tokens that it has met."""

    def __init__(self, name: str) -> None:
        self.name, self.merges, self.known = name, merges_of(name), Known()

    def of_words(self, words: list[str]) -> np.ndarray:
        return self.merges.survivors([w.encode("utf-8", "replace") for w in words])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings inside count as one each."""
        pattern, _ = special(self.name)
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if strange(text):
                out[i] = len(tokenizer(self.name).encode(text, add_special_tokens=False).ids)
                continue
            own = pattern.split(text) if "<" in text else [text]
            out[i] += len(own) - 1
            parts += own
            owner += [i] * len(own)
        for a, b in chunks(parts):
            np.add.at(out, owner[a:b], self._of_parts(parts[a:b]))
        return out

    def _of_parts(self, texts: list[str]) -> np.ndarray:
        layout = Layout.of(texts)
        start, end = byte_level(layout)
        if not len(start):
            return np.zeros(len(texts), np.int64)
        codes, words = distinct(layout, start, end)
        if self.known.size > MOST_BYTES:
            self.known = Known()
        counts = self.known.get(words)
        new = np.flatnonzero(counts < 0)
        if len(new):
            unknown = words.take(new)
            counts[new] = self.of_words(unknown.texts())
            self.known.add(unknown, counts[new])
        owner = np.searchsorted(layout.first, start + 1, side="right") - 1
        return np.bincount(np.maximum(owner, 0), weights=counts[codes], minlength=len(texts)).astype(np.int64)


@cache
def counter_of(name: str) -> Counter:
    """One counter for all tasks of a worker, so that what it knows outlives a task."""
    return Counter(name)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text, ...).

    Whole texts, no truncation. A null text counts as empty: 0 bytes, 0 tokens. Rows are
    independent: repeated rows and null ids come back as they are, other columns are
    left out, an empty table gives an empty result. One pass without a shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            tokens = counter.counts(text.to_pylist())
            n_bytes = pc.binary_length(text).cast(pa.int64())
            over = pa.array(tokens > limit)
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens), over], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return small_batches(docs).select("doc_id", "text").mapInArrow(count, schema)
