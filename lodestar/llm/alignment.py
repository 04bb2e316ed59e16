"""Alignment of two tokenizers' tokens: a merge of their end positions, cut along its path.

The ends of A's and of B's tokens are two ascending lists. Binary searches along diagonals cut
their merge into pieces of equal work that depend on nothing but their own ends and
the ones beside them: each gives the pairs of tokens that overlap in it, and the ends that both
share; groups that go over several pieces come from the shared ends of all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Layout, chunks, cut, small_batches
from lodestar.llm.pretokens import BLANK, MOST_BYTES, Known, Words, byte_level, distinct, file_of, strange
from lodestar.llm.token_counts import byte_signs

#: Ends that a piece of the merge holds.
WORK = 1 << 16
#: Characters of the documents whose pairs of ids are looked up together.
BUNCH_CHARS = 16_000_000
#: Sign that the piece vocabulary writes for a blank.
UNDERLINE = "▁"


class Vocabulary:
    """Ids of words; those of words that were met before are remembered."""

    token: list[bytes]  # of each id

    def __init__(self) -> None:
        self.length = np.array([len(t) for t in self.token], np.int64)
        self._forget()

    def split(self, layout: Layout, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ascending starts and ends of words that tokens never cross; they cover all texts."""
        raise NotImplementedError

    def ids(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _forget(self) -> None:
        self.known = Known()
        self.at, self.size, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, words: Words) -> None:
        texts = words.texts()
        found = [own for i in range(0, len(texts), 1024) for own in self.ids(texts[i : i + 1024])]
        size = np.fromiter(map(len, found), np.int64, len(found))
        same = np.array([b"".join([self.token[i] for i in own]) == text.encode() for own, text in zip(found, texts, strict=True)], bool)
        self.known.add(words, np.arange(len(self.size), len(self.size) + len(words)))
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
        self.size, self.same = np.concatenate((self.size, size)), np.concatenate((self.same, same))
        self.flat = np.concatenate((self.flat, np.fromiter((i for own in found for i in own), np.int32, int(size.sum()))))

    def encode(self, layout: Layout, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each text has, and whether each text's ids stand for its bytes."""
        start, end = self.split(layout, texts)
        codes, words = distinct(layout, start, end)
        if max(self.known.size, 4 * len(self.flat)) > MOST_BYTES:
            self._forget()
        place = self.known.get(words)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.size), len(self.size) + len(new))
            self._learn(words.take(new))
        word = place[codes]
        size = self.size[word]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.at[word] - (ends - size), size)]
        first = np.searchsorted(start, layout.first)  # each text has a word
        return ids, np.add.reduceat(size, first), np.logical_and.reduceat(self.same[word], first)


class ByteLevel(Vocabulary):
    """A byte-level vocabulary of the tokenizers library, special strings being plain text."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file_of(name))
        self.tokenizer.encode_special_tokens = True
        byte_of = {sign: b for b, sign in enumerate(byte_signs())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token = [b""] * (1 + max(vocab.values()))
        for sign, i in vocab.items():
            self.token[i] = bytes(byte_of[c] for c in sign) if all(c in byte_of for c in sign) else sign.encode()
        super().__init__()

    def split(self, layout: Layout, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        start, end = byte_level(layout)
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        odd = np.array([i for i, text in enumerate(texts) if strange(text)], np.int64)
        if len(odd):  # the library splits these texts itself
            stay = ~np.isin(np.searchsorted(layout.first, start, side="right") - 1, odd)
            after = np.append(layout.first[1:], len(layout.cp))[odd] - 1
            start, end = np.append(start[stay], layout.first[odd]), np.append(end[stay], after)
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return start, end

    def ids(self, words: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]


class Pieces(Vocabulary):
    """A vocabulary of the sentencepiece library, which puts a blank before a text.

    No piece goes from another sign on to a blank, so words begin at each first blank.
    """

    def __init__(self, name: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=file_of(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(UNDERLINE in p.lstrip(UNDERLINE) for p in pieces):
            raise ValueError("a piece of this vocabulary goes over a word's end")
        self.token = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(UNDERLINE, " ").encode() for i, p in enumerate(pieces)]
        super().__init__()

    def split(self, layout: Layout, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blank = layout.cp == BLANK
        start = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # texts begin with a blank
        end = np.append(start[1:], len(layout.cp))
        end[np.isin(end, layout.first, assume_unique=True)] -= 1
        end[-1] = len(layout.cp) - 1
        return start, end

    def ids(self, words: list[str]) -> list[list[int]]:
        blank = [self.model.piece_to_id(UNDERLINE)]  # the library gives an empty text no blank
        return [own or blank for own in self.model.encode([w[1:] for w in words], num_threads=1)]


@cache
def vocabularies(a: str, b: str) -> tuple[Vocabulary, Vocabulary]:
    """One pair for all tasks of a worker, so that what they know outlives a task."""
    return ByteLevel(a), Pieces(b)


def path_cuts(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b come before each `work`-th place of their merge; a goes first where ends are equal.

    Along a diagonal the number of a's ends is found by a binary search, for all diagonals at a time.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (some := low < high).any():
        mid = (low + high) // 2
        onward = np.zeros(len(d), bool)
        onward[some] = a[mid[some]] <= b[d[some] - mid[some] - 1]
        low, high = np.where(onward, mid + 1, low), np.where(some & ~onward, mid, high)
    return low, d - low


def piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps whose last byte ends at a[i0:i1] or b[j0:j1], as numbers of a's and b's tokens, and a's numbers at shared ends.

    Where an end of both lies on the border of two pieces, a's piece has it.
    """
    own_a, own_b = a[i0:i1], b[j0:j1]
    i, j = np.arange(i0, i1), j0 + np.searchsorted(own_b, own_a)
    shared = i[b[j] == own_a]
    i_of_b = i0 + np.searchsorted(own_a, own_b)
    met = np.zeros(len(own_b), bool)
    inside = i_of_b < i1
    met[inside] = a[i_of_b[inside]] == own_b[inside]
    if i0 and len(own_b):
        met[0] |= a[i0 - 1] == own_b[0]
    return np.append(i, i_of_b[~met]), np.append(j, np.arange(j0, j1)[~met]), shared


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a's and b's tokens of all overlaps, and a's numbers at shared ends, ascending.

    a and b are the ascending ends of tokens that cover the same bytes.
    """
    i, j = path_cuts(a, b, work)
    found = [piece(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Aligned:
    """The tokens of some texts (none null), and how they overlap."""

    def __init__(self, texts: list[str], a: Vocabulary, b: Vocabulary, work: int = WORK) -> None:
        self.n = len(texts)
        some = np.array([i for i, t in enumerate(texts) if t], np.int64)
        self.n_a, self.n_b, self.n_groups = (np.zeros(self.n, np.int64) for _ in range(3))
        self.a = self.b = np.zeros(0, np.int32)
        self.link_a = self.link_b = self.last_a = self.last_b = self.end_a = self.end_b = np.zeros(0, np.int64)
        if not len(some):
            return
        led = [" " + texts[i] for i in some]
        layout = Layout.of(led)
        (ids_a, n_a, fine_a), (ids_b, n_b, fine_b) = a.encode(layout, led), b.encode(layout, led)
        fine = fine_a & fine_b
        self.a, self.b = ids_a[np.repeat(fine, n_a)], ids_b[np.repeat(fine, n_b)]
        self.n_a[some], self.n_b[some] = n_a * fine, n_b * fine
        if not fine.any():
            return
        self.end_a, self.end_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        self.link_a, self.link_b, self.last_a = overlaps(self.end_a, self.end_b, work)
        self.last_b = np.searchsorted(self.end_b, self.end_a[self.last_a])
        edges = np.append(0, np.cumsum(self.n_a))
        self.n_groups = np.diff(np.searchsorted(self.last_a, edges))

    @property
    def n_links(self) -> np.ndarray:
        return self.n_a + self.n_b - self.n_groups

    def pairs(self, width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (A's id x width + B's id, below span) and times of the distinct linked pairs of each text, ascending."""
        owner = np.repeat(np.arange(self.n) * span, self.n_a)[self.link_a]
        key = np.sort(owner + self.a[self.link_a].astype(np.int64) * width + self.b[self.link_b])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return *np.divmod(key[first], span), np.diff(np.append(first, len(key)))

    def group_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of the group of each of A's and of B's tokens."""
        return np.searchsorted(self.last_a, np.arange(len(self.a))), np.searchsorted(self.last_b, np.arange(len(self.b)))

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        group_a, group_b = self.group_of()
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        last = np.zeros(len(self.a), np.int64)
        last[self.last_a] = 1
        codes[np.arange(len(self.a)) + np.append(0, self.last_b + 1)[group_a]] = 3 * self.a.astype(np.int64) + last
        last = np.zeros(len(self.b), np.int64)
        last[self.last_b] = 2
        codes[np.arange(len(self.b)) + (self.last_a + 1)[group_b]] = 3 * self.b.astype(np.int64) + last
        written = numbers(1 + max(int(self.a.max(initial=0)), int(self.b.max(initial=0))))
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            parts = [written[c] for c in codes[at : at + n].tolist()]
            out.append(hashlib.sha256(b"".join(parts)[:-1]).hexdigest() if n else "")
            at += n
        return out


_NUMBERS: list[bytes] = []


def numbers(n: int) -> list[bytes]:
    """Decimal numbers below n or more, each followed by a comma, a bar and a semicolon."""
    for i in range(len(_NUMBERS) // 3, n):
        _NUMBERS.extend(f"{i}{sign}".encode() for sign in ",|;")
    return _NUMBERS


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as bytes: of 8, 16 or 64 bits each, as the largest asks for."""
    most = x.max(initial=0)
    return x.astype("u1" if most < 2**8 else "<u2" if most < 2**16 else "<i8").tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    kind = {1: "u1", 2: "<u2", 8: "<i8"}[len(x) // n] if n else "u1"
    return np.frombuffer(x, kind).astype(np.int64)


class Bunch:
    """Documents whose pairs are looked up together; places in the list of their distinct pairs stand for pairs."""

    def __init__(self, number: int) -> None:
        self.number, self.chars, self.rows, self.found = number, 0, [], []

    def add(self, rows: pa.RecordBatch, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], chars: int) -> None:
        self.rows.append(rows)
        self.found.append((np.bincount(pairs[0], minlength=rows.num_rows), pairs[1], pairs[2]))
        self.chars += chars

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The documents with their pairs' places and times; the bunch's pairs and their times stand at the first."""
        total = np.concatenate([x[1] for x in self.found])
        distinct_pairs, inverse = np.unique(total, return_inverse=True)
        times = np.bincount(inverse, weights=np.concatenate([x[2] for x in self.found]), minlength=len(distinct_pairs)).astype("<i8")
        lists = [distinct_pairs.astype("<i8").tobytes(), times.tobytes()]
        at = 0
        for rows, (size, pair, times) in zip(self.rows, self.found, strict=True):
            place = inverse[at : at + len(pair)]
            at += len(pair)
            ends = np.cumsum(size)
            places, often = [], []
            for s, e in zip((ends - size).tolist(), ends.tolist(), strict=True):
                places.append(_narrow(np.diff(place[s:e], prepend=0)))
                often.append(_narrow(times[s:e]))
            n = rows.num_rows
            first = [[lists[k], *[None] * (n - 1)] if n and lists else [None] * n for k in (0, 1)]
            lists = lists if not n else []
            columns = [*rows.columns, pa.array(size, pa.int64()), pa.array(places, pa.binary()), pa.array(often, pa.binary()), *(pa.array(x, pa.binary()) for x in first), pa.array(np.full(n, self.number))]
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "n_pairs", "places", "times", "pairs", "pair_times", "bunch"])


COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def _bunches(docs: DataFrame, a: str, b: str, bunch_chars: int, work: int) -> DataFrame:
    """A row for each document, and its linked pairs as places among its bunch's; written to the shared folder."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabularies(a, b)
        number = TaskContext.get().partitionId() << 32
        bunch = Bunch(number)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for s, e in chunks(texts):
                own = Aligned(texts[s:e], va, vb, work)
                counts = [pa.array(x, pa.int64()) for x in (own.n_a, own.n_b, own.n_groups, own.n_links)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *counts, pa.array(own.digests(), pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                bunch.add(rows, own.pairs(len(vb.token), len(va.token) * len(vb.token)), sum(map(len, texts[s:e])))
                if bunch.chars >= bunch_chars:
                    yield from bunch.batches()
                    bunch = Bunch(bunch.number + 1)
        if bunch.rows:
            yield from bunch.batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {COUNTS}, groups_sha256 string, n_pairs bigint, places binary, times binary, pairs binary, pair_times binary, bunch bigint"
    rows = small_batches(docs).select("doc_id", "text").mapInArrow(apply, schema)
    cut(docs.sparkSession.range(0))  # sets a checkpoint folder where the session has none
    path = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _uses(bunches: DataFrame) -> DataFrame:
    """bunch, pair and n (links in the bunch) of each bunch's distinct pairs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bunch, pairs, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")
                for i in range(0, len(pair), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[part]), bunch)), pa.array(pair[part]), pa.array(n[part])], ["bunch", "pair", "n"])

    return bunches.where("pairs is not null").select("bunch", "pairs", "pair_times").mapInArrow(apply, "bunch bigint, pair bigint, n bigint")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", bunch_chars: int = BUNCH_CHARS, work: int = WORK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text, ...).

    Space and text by vocabulary a, text by b (which adds the space), whole and without special
    tokens. Byte offsets at which tokens of both end cut a document into groups; two tokens
    are linked where their bytes overlap. A pair of ids counts as often as it is linked in
    all documents: n_best is how many of a document's links are of their B id's most
    counted pair, count_sum the sum of the counts over its links.

    Documents are counted in bunches of about bunch_chars characters: a bunch's distinct
    pairs are what is shuffled, added up for all documents and sent back to the bunch, where
    each document looks its pairs up. A longer document is a bunch of its own.

    Texts that are null or empty, or whose tokens' bytes aren't the space and the text,
    have no tokens: zeros and ''. Rows are independent: repeated rows and null ids come back as they
    are and count again, other columns are left out, an empty table gives an empty
    result. A run of characters without a blank is tokenised by the library at once.
    """
    bunches = _bunches(docs, a, b, bunch_chars, work)
    uses = _uses(bunches)
    width = F.lit(piece_count(b)).cast("bigint")
    counts = uses.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % width)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    counted = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    found = uses.select("bunch", "pair").join(counted, "pair")

    def look_up(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pair"].to_numpy())
        count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for n, places, times in zip(rows["n_pairs"].to_pylist(), rows["places"].to_pylist(), rows["times"].to_pylist(), strict=True):
            place, often = np.cumsum(_wide(places, n)), _wide(times, n)
            n_best.append(int(often[best[place]].sum()))
            count_sum.append(int((often * count[place]).sum()))
        columns = {c: rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(columns | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": rows["groups_sha256"]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {COUNTS}, n_best bigint, count_sum bigint, groups_sha256 string"
    return bunches.drop("pairs", "pair_times").groupBy("bunch").cogroup(found.groupBy("bunch")).applyInArrow(look_up, schema)


@cache
def piece_count(name: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=file_of(name)).vocab_size()


def groups(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", work: int = WORK) -> DataFrame:
    """doc_id, start and stop (bytes of space and text), a_ids and b_ids of every group of every document, as align() cuts them."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabularies(a, b)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for s, e in chunks(texts):
                own = Aligned(texts[s:e], va, vb, work)
                owner = np.repeat(np.arange(own.n), own.n_groups)
                stop = own.end_a[own.last_a]
                start = np.append(0, stop[:-1])[: len(stop)]
                begin = np.zeros(own.n, np.int64)
                heads, at = np.unique(owner, return_index=True)
                begin[heads] = start[at]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), pa.array(ids, pa.int32())) for last, ids in ((own.last_a, own.a), (own.last_b, own.b))]
                columns = [batch.column(0).slice(s, e - s).take(pa.array(owner)), pa.array(start - begin[owner]), pa.array(stop - begin[owner]), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "stop", "a_ids", "b_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, start bigint, stop bigint, a_ids array<int>, b_ids array<int>")
