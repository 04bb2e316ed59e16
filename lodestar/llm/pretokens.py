"""Splitting texts into pre-tokens, over arrays of code points.

Both splits follow the public patterns of the vocabularies: contractions, runs of letters,
numbers, other signs, and white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from lodestar.llm.common import DIGIT, EDGE, LETTER, OTHER, SPACE, UNKNOWN, Layout, classes, run_hashes

APOSTROPHE, BLANK = ord("'"), ord(" ")
#: Letters that end a contraction after one sign, and pairs of letters (fixed values).
ONE = tuple(map(ord, "stmd"))
TWO = (("r", "e"), ("v", "e"), ("l", "l"))
#: Places for the words that a worker remembers, and the bytes at which it forgets them all.
PLACE_BITS, MOST_BYTES = 22, 64_000_000


def file_of(name: str) -> str:
    """A path as it is; a bare name is looked up in the installed vocabularies, on the executor."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file_of(name))


@cache
def special(name: str) -> tuple[re.Pattern, dict[str, int]]:
    """A pattern of the vocabulary's special strings, and their ids."""
    ids = {t.content: i for i, t in tokenizer(name).get_added_tokens_decoder().items()}
    longest_first = sorted(ids, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, longest_first)) or r"(?!)"), ids


@dataclass
class Words:
    """Words as one array of code points."""

    cp: np.ndarray  # uint32
    edge: np.ndarray  # where each word begins, and the last one ends

    def __len__(self) -> int:
        return len(self.edge) - 1

    def take(self, at: np.ndarray) -> Words:
        size = np.diff(self.edge)[at]
        edge = np.append(0, np.cumsum(size))
        return Words(self.cp[np.arange(edge[-1]) + np.repeat(self.edge[at] - edge[:-1], size)], edge)

    def texts(self) -> list[str]:
        cp, edge = self.cp.tobytes(), (self.edge * 4).tolist()
        return [cp[a:b].decode("utf-32-le") for a, b in pairwise(edge)]

    def equal(self, other: Words) -> np.ndarray:
        """Whether each word equals the one at the same place of as many others."""
        out = np.diff(self.edge) == np.diff(other.edge)
        at = np.flatnonzero(out)
        mine, theirs = (self, other) if len(at) == len(out) else (self.take(at), other.take(at))
        if len(at):
            out[at] = np.logical_and.reduceat(mine.cp == theirs.cp, mine.edge[:-1])
        return out


def distinct(layout: Layout, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, Words]:
    """For each span its place among the distinct ones, which are compared as bytes, and those.

    The spans don't overlap and aren't empty; what lies between them counts as words, too.
    """
    cut = np.zeros(len(layout.cp) + 1, bool)
    cut[start] = True
    cut[end] = True
    edges = np.flatnonzero(cut)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges * 4), pa.py_buffer(layout.cp)])
    coded = parts.dictionary_encode()
    codes = coded.indices.to_numpy()[(np.cumsum(cut, dtype=np.int32) - 1)[start]]
    _, edge, cp = coded.dictionary.buffers()
    edge = np.frombuffer(edge, np.int64)[: len(coded.dictionary) + 1] // 4
    return codes, Words(np.frombuffer(cp, np.uint32)[: edge[-1]], edge)


class Known:
    """Numbers of the words that a worker remembers.

    A word is looked for at the place that its hash gives and compared there by its code
    points, so that no two words are taken for one. A word whose place is taken isn't
    remembered.
    """

    def __init__(self) -> None:
        self.place = np.full(1 << PLACE_BITS, -1, np.int32)
        self.words, self.number = Words(np.zeros(0, np.uint32), np.zeros(1, np.int64)), np.zeros(0, np.int64)

    @property
    def size(self) -> int:
        return 4 * len(self.words.cp) + 16 * len(self.words)

    def _places(self, words: Words) -> np.ndarray:
        return (run_hashes(words.cp, words.edge[:-1], words.edge[1:]) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)

    def get(self, words: Words) -> np.ndarray:
        """The numbers of the words, -1 for unknown ones."""
        out = np.full(len(words), -1)
        at = self.place[self._places(words)]
        some = np.flatnonzero(at >= 0)
        same = words.take(some).equal(self.words.take(at[some]))
        out[some[same]] = self.number[at[some[same]]]
        return out

    def add(self, words: Words, numbers: np.ndarray) -> None:
        """Remember distinct words that aren't known yet, where their places are free."""
        place = self._places(words)
        place, first = np.unique(place, return_index=True)
        first = first[self.place[place] < 0]
        more = words.take(first)
        self.place[self._places(more)] = np.arange(len(self.words), len(self.words) + len(first))
        edge = np.append(self.words.edge, len(self.words.cp) + more.edge[1:])
        self.words = Words(np.append(self.words.cp, more.cp), edge)
        self.number = np.append(self.number, numbers[first])


def runs(layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and class of each run of one class; the edges between texts are runs of their own."""
    kind = classes()[layout.cp]
    kind[layout.first - 1] = EDGE
    kind[-1] = EDGE
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    # two edges meet at an empty text; they may share a run, as no token holds them
    return start, np.append(start[1:], len(kind)), kind[start]


def _contractions(cp: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each run: how many letters of the next run its apostrophe takes (0: none)."""
    taken = np.zeros(len(start), np.int64)
    at = np.flatnonzero((kind[:-1] == OTHER) & (kind[1:] == LETTER))
    at = at[(end[at] - start[at] == 1) & (cp[start[at]] == APOSTROPHE)]
    if len(at):
        a = cp[end[at]]
        b = np.where(end[at + 1] - start[at + 1] > 1, cp[np.minimum(end[at] + 1, len(cp) - 1)], 0)
        two = np.zeros(len(at), bool)
        for x, y in TWO:
            two |= (a == ord(x)) & (b == ord(y))
        taken[at] = np.where(np.isin(a, ONE), 1, np.where(two, 2, 0))
    return taken


def byte_level(layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token of the byte-level vocabularies, in no order."""
    cp = layout.cp
    start, end, kind = runs(layout)
    after = np.append(kind[1:], EDGE)
    space = kind == SPACE
    joins = np.zeros(len(start), bool)  # a blank right before the run goes with it
    joins[1:] = space[:-1] & (cp[start[1:] - 1] == BLANK)
    taken = _contractions(cp, start, end, kind)
    taken[joins] = 0
    begin = start - joins
    begin[1:] += taken[:-1]
    own = (kind == LETTER) | (kind == DIGIT) | (kind == OTHER)
    own &= begin < end
    last = space & (after == EDGE)
    inner = space & ~last
    many = inner & (end - start > 1)
    lone = inner & (cp[end - 1] != BLANK)
    starts = np.concatenate((begin[own], start[last], start[many], end[lone] - 1))
    ends = np.concatenate(((end + taken)[own], end[last], end[many] - 1, end[lone]))
    return starts, ends


def word_level(layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token of the word vocabulary, ascending: single numbers, no white space."""
    cp = layout.cp
    start, end, kind = runs(layout)
    taken = _contractions(cp, start, end, kind)
    begin = start.copy()
    begin[1:] += taken[:-1]
    end = end + taken
    own = ((kind == LETTER) | (kind == OTHER) | (kind == DIGIT)) & (begin < end)
    begin, end, number = begin[own], end[own], kind[own] == DIGIT
    times = np.where(number, end - begin, 1)
    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    begin, single = np.repeat(begin, times) + offset, np.repeat(number, times)
    return begin, np.where(single, begin + 1, np.repeat(end, times))


def strange(text: str) -> bool:
    """Whether the text holds code points whose class other Unicode tables may know better."""
    if text.isascii():
        return False
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool((classes()[cp] == UNKNOWN).any())
