"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Layout, chunks, cut, small_batches
from lodestar.llm.pretokens import MOST_BYTES, Known, Words, distinct, special, strange, tokenizer, word_level

LENGTH = 4096
END = 2


class Encoder:
    """Ids of the word vocabulary; pre-tokens that were met before are looked up."""

    def __init__(self, name: str) -> None:
        self.tokenizer, self.pattern = tokenizer(name), special(name)[0]
        self._forget()

    def _forget(self) -> None:
        self.known = Known()
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, words: Words) -> None:
        texts = words.texts()
        ids, size = [], np.zeros(len(words), np.int64)
        for i in range(0, len(texts), 4096):  # the library's results are large
            found = self.tokenizer.encode(texts[i : i + 4096], is_pretokenized=True, add_special_tokens=False)
            size[i : i + 4096] = np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts[i : i + 4096]))
            ids.append(np.array(found.ids, np.uint32))
        self.known.add(words, np.arange(len(self.size), len(self.size) + len(words)))
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, *ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, owner = [], []
        for i, text in enumerate(texts):
            if strange(text) or ("<" in text and self.pattern.search(text)):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(normal(text))
                owner.append(i)
        for a, b in chunks(plain):
            for i, ids in zip(owner[a:b], self._of_parts(plain[a:b]), strict=True):
                out[i] = ids
        return out

    def _of_parts(self, texts: list[str]) -> list[np.ndarray]:
        layout = Layout.of(texts)
        start, end = word_level(layout)
        if not len(start):
            return [np.zeros(0, np.uint32)] * len(texts)
        codes, words = distinct(layout, start, end)
        if max(self.known.size, 4 * len(self.flat)) > MOST_BYTES:
            self._forget()
        place = self.known.get(words)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.size), len(self.size) + len(new))
            self._learn(words.take(new))
        token = place[codes]
        size = self.size[token]
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(self.at[token] - (ends - size), size)
        ids = self.flat[index]
        cuts = np.searchsorted(start, layout.first[1:])  # start ascends
        return np.split(ids, np.append(0, ends)[cuts])


@cache
def encoder_of(name: str) -> Encoder:
    """One encoder for all tasks of a worker, so that what it knows outlives a task."""
    return Encoder(name)


def normal(text: str) -> str:
    """NFC and lower case, code point by code point."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # no special form at a word's end
    return text.lower()


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut at multiples of length."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            owner, start, size, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), length):
                    part = ids[s : s + length]
                    owner.append(i)
                    start.append(s)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: items by falling size, each into the first bin with room.

    The tree's leaves hold the bins' free room and inner nodes the larger of their
    children, so the first bin with room is found in as many steps as the tree is high.
    """
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes >= capacity).sum())
    bins, offsets = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    leaves = 1 << max(0, (len(rest) - 1)).bit_length()
    tree = [capacity] * (2 * leaves)
    for i, size in zip(rest.tolist(), sizes[rest].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = full + node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            largest = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == largest:
                break
            tree[node] = largest
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = END, group_pieces: int = 2048, seed: int = 9) -> DataFrame:
    """Pack every document of docs (doc_id, text, ...) into sequences of at most `length` ids.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document is cut only at multiples of `length` of its own ids,
    so that the checksums come from the one pass that tokenises. The pieces are
    dealt at random into groups of about group_pieces, and each group is packed on its
    own; a group leaves at most one bin less than half full.

    A null text is empty: its document is the end id alone. Repeated rows are packed
    once each; a null doc_id stays null; other columns are left out; an empty table
    gives an empty result.
    """
    parts = cut(pieces(docs, vocabulary, length, end_id).withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-parts.count() // group_pieces))
    dealt = parts.withColumn("bunch", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups))).drop("row")

    def fit(bunch: pa.Table) -> pa.Table:
        bunch = bunch.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(bunch["length"].to_numpy(), length)
        group = bunch["bunch"].to_numpy()
        return bunch.drop_columns("bunch").append_column("sequence_id", pa.array(group * 2**32 + bins)).append_column("offset", pa.array(offsets))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("bunch").applyInArrow(fit, schema)
