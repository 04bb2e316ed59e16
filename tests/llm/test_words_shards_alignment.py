"""Spelling variants, sharding and alignment against brute force, and on edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import alignment, pretokens, sharding, spelling
from tests.conftest import SF
from tests.llm.test_operators import EDGE, make

DOCUMENTS = f"{SF}/documents.parquet"

# 11: spelling variants


def _near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _words(rows_) -> Counter:
    found: Counter = Counter()
    for doc_id, text in rows_:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 7 and n >= 2})


def _variants(words: Counter) -> set:
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def _mutations(seed: int) -> list[tuple[int | None, str | None]]:
    """Texts with words of few letters that differ by one edit and more, of very unlike frequencies."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abÀÿ") for _ in range(rng.randint(7, 12))) for _ in range(12)] + ["aaaaaaaa", "abababab", "aaaabaaaa"]
    pool = []
    for base in bases:
        pool += [base] * rng.choice([2, 30, 400])
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "b", "ç", "ab"])
            pool += ["".join(w)] * rng.choice([1, 2, 2, 25])
    rng.shuffle(pool)
    rows_ = [(i, " ".join(w.upper() if w.isascii() and i % 3 == 0 else w for w in pool[i::40])) for i in range(40)]
    return [*rows_, (None, "aaaaaaaa, ABABABAB!"), (3, None), (4, "")]


@pytest.mark.parametrize("most", [spelling.MOST, 4, 0])
def test_spelling_by_brute_force(spark, most):
    rows_ = _mutations(5)
    got = spelling.variants(make(spark, [(*r, "en", "a") for r in rows_]), most=most).collect()
    want = _variants(_words(rows_))
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(r.form and r.root != r.form for r in got) and any(r.n_near > 8 for r in got)


@pytest.mark.parametrize("most", [spelling.MOST, 3])
def test_spelling_of_words_that_share_a_half(spark, most):
    rng = random.Random(1)
    words = {"common" + "".join(rng.choice("abcd") for _ in range(rng.randint(5, 7))) for _ in range(900)} | {"".join(rng.choice("abcd") for _ in range(6)) + "endings" for _ in range(300)}
    frame = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n bigint")
    got = Counter(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(frame, most).collect())
    listed = sorted(words)
    assert got == Counter((a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if _near(a, b))


def test_spelling_on_edge_rows(spark):
    assert spelling.variants(make(spark, EDGE)).count() == len(_words([r[:2] for r in EDGE]))
    assert spelling.variants(make(spark, [(1, None, "en", "a"), (2, "123 -", "en", "a")])).count() == 0
    assert spelling.variants(make(spark, []).limit(0)).count() == 0


def test_runs_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 5)
    text = "abcdefghij kl mnopqrstuv; Wx-yz" * 3
    assert spelling.runs_of(text) == Counter(re.findall("[a-z]{7,}", text.lower()))


# 12: sharding


def _shards(rows_, shards):
    sized = sorted(((-(2**63) - 1 if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), d) for d, t in rows_), key=lambda r: r[:3])
    total, at, out, seen = sum(r[1] for r in sized), 0, Counter(), Counter()
    for _, size, crc, d in sized:
        shard = (2 * at + size) * shards // (2 * total)
        out[(d, size, crc, "bytes", shard, seen[shard], None)] += 1
        seen[shard] += 1
        at += size
    return out


@pytest.mark.parametrize("shards", [40, 3, 1])
def test_sharding_by_brute_force(spark, shards):
    docs = spark.read.parquet(DOCUMENTS)
    for d in (docs, make(spark, EDGE), make(spark, EDGE * 40 + [(9, "hot", "en", "a")] * 500), make(spark, [(None, "x" * i, "en", "a") for i in range(60)])):
        want = _shards([(r.doc_id, r.text) for r in d.collect()], shards)
        assert Counter(map(tuple, sharding.assign(d, shards).collect())) == want


def test_shards_are_near_equal_and_contiguous(spark):
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    got = sharding.assign(docs, 7).orderBy("doc_id").collect()
    sums, largest = Counter(), max(r.size for r in got)
    for r in got:
        sums[r.shard] += r.size
    mean = sum(sums.values()) / 7
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    assert set(sums) == set(range(7)) and all(abs(n - mean) <= largest for n in sums.values())


def test_hot_ids_are_dealt_to_several_partitions(spark):
    docs = make(spark, [(1, "the same", "en", "a")] * 4000)
    placed = sharding._placed(docs, [F.col("doc_id")], 4)
    assert placed.rdd.getNumPartitions() >= 4
    assert max(len(x) for x in placed.rdd.glom().collect()) < 2500


def test_written_shards(spark, tmp_path):
    docs = make(spark, EDGE)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), f"{tmp_path}/no", 3)
    sharding.write_shards(docs, f"{tmp_path}/out", 3, slot_column="place")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select(docs.columns).exceptAll(docs).count() == docs.exceptAll(back.select(docs.columns)).count() == 0
    want = Counter((r.doc_id, r.shard, r.slot) for r in sharding.assign(docs, 3).collect())
    assert Counter((r.doc_id, r.shard, r.place) for r in back.collect()) == want


# 13: alignment


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(pretokens.file_of("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=pretokens.file_of("piece_bpe_32k.model"))


def _tokens(libraries, text):
    """Ids and bytes of both libraries' tokens, or nothing where the bytes aren't the text's."""
    a, b = libraries
    if not text:
        return [], [], [], []
    signs = {s: bytes([i]) for i, s in enumerate(alignment.byte_signs())}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [b"".join(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    return ids_a, ids_b, np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()


def _aligned(libraries, rows_):
    links, groups = [], []
    for _, text in rows_:
        ids_a, ids_b, ends_a, ends_b = _tokens(libraries, text)
        own = [(x, y) for i, x in enumerate(ids_a) for j, y in enumerate(ids_b) if max(([0] + ends_a)[i], ([0] + ends_b)[j]) < min(ends_a[i], ends_b[j])]
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        groups.append([([x for x, e in zip(ids_a, ends_a, strict=True) if s < e <= t], [y for y, e in zip(ids_b, ends_b, strict=True) if s < e <= t]) for s, t in zip(cuts, cuts[1:])])
        links.append((len(ids_a), len(ids_b), own))
    count = Counter(p for *_, own in links for p in own)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = Counter()
    for (doc_id, _), (n_a, n_b, own), cut_ in zip(rows_, links, groups, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut_)
        out[(doc_id, n_a, n_b, len(cut_), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(written.encode()).hexdigest() if cut_ else "")] += 1
    return out


NASTY = [
    " leading", "trailing  ", "   ", "\n\n\t x\n", "a  b   c    d", "▁ is a sign", "a▁b", "<s> </s> <unk> <|endoftext|> <0x0A>", "déjà ﬁ ① 中文字 日本語 🙂👍🏽 é", "͸ unknown sign", "x" * 500, "don't I'll we've 'S ''s",
    "1234567 89,000.5", " nbsp em", "tab\tand\r\nlines", "\x00 zero", "﻿mark", "ß" * 40, "word", " ",
]


@pytest.mark.parametrize(("bunch_chars", "work"), [(alignment.BUNCH_CHARS, alignment.WORK), (50, 7), (1, 1)])
def test_alignment_by_brute_force(spark, libraries, bunch_chars, work):
    rows_ = [r[:2] for r in EDGE if r[0] != 6] + list(enumerate(NASTY, 100)) + [(50, "The same text, twice."), (50, "The same text, twice."), (2**60 + 1, "large"), (None, "null")]
    docs = make(spark, [(*r, "en", "a") for r in rows_])
    assert Counter(map(tuple, alignment.align(docs, bunch_chars=bunch_chars, work=work).collect())) == _aligned(libraries, rows_)


def test_alignment_of_documents(spark, libraries):
    docs = spark.read.parquet(DOCUMENTS).where(F.length("text") < 1500)
    rows_ = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows_) > 50
    assert Counter(map(tuple, alignment.align(docs.repartition(3), bunch_chars=20_000).collect())) == _aligned(libraries, rows_)


def test_groups_are_whole(spark, libraries):
    rows_ = list(enumerate(NASTY))
    found = defaultdict(list)
    for r in alignment.groups(make(spark, [(*r, "en", "a") for r in rows_])).collect():
        found[r.doc_id].append(r)
    for doc_id, text in rows_:
        ids_a, ids_b, *_ = _tokens(libraries, text)
        own = sorted(found[doc_id], key=lambda r: r.start)
        assert [i for r in own for i in r.a_ids] == ids_a and [i for r in own for i in r.b_ids] == ids_b
        assert [r.start for r in own] == [0, *(r.stop for r in own)][: len(own)]
        assert not own or own[-1].stop == len(text.encode()) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab 'éß▁中\n<1͸🙂", max_size=12), min_size=1, max_size=8))
def test_tokens_equal_the_libraries(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(pretokens.file_of("byte_bpe_50k.json"))
    b = SentencePieceProcessor(model_file=pretokens.file_of("piece_bpe_32k.model"))
    own = alignment.Aligned(texts, *alignment.vocabularies("byte_bpe_50k.json", "piece_bpe_32k.model"))
    fine = [t for t in texts if t and "▁" not in t]
    assert own.a.tolist() == [i for t in fine for i in a.encode(" " + t, add_special_tokens=False).ids]
    assert own.b.tolist() == [i for t in fine for i in b.encode(t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 9))
def test_pieces_of_the_merge_give_all_overlaps(a, b, work):
    total = max(sum(a), sum(b)) + 1
    a, b = np.cumsum([*a, total - sum(a)]), np.cumsum([*b, total - sum(b)])
    i, j, shared = alignment.overlaps(a, b, work)
    span = lambda ends, k: (int(ends[k - 1]) if k else 0, int(ends[k]))
    want = {(x, y) for x in range(len(a)) for y in range(len(b)) if max(span(a, x)[0], span(b, y)[0]) < min(span(a, x)[1], span(b, y)[1])}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert a[shared].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    at_a, at_b = alignment.path_cuts(a, b, work)
    assert (np.diff(at_a) + np.diff(at_b) <= work).all() and (np.diff(at_a) >= 0).all() and (np.diff(at_b) >= 0).all()
