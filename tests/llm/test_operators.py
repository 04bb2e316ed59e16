"""Each operator against a brute-force version, and on empty, null, repeated and clashing input."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import embed_dedup, langid, licenses, line_dedup, mixing, packing, pretokens, queries, simhash, token_counts, topk, toxicity
from lodestar.llm.common import connected_components
from lodestar.llm.pretokens import tokenizer
from tests.conftest import SF
from tests.oracle import connect, rows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size int, _id string, copies string, row string"
LONG = "word " * 60_000 + "x" * 30_000


def make(spark, rows_):
    """Documents (doc_id, text, lang, source) with further columns whose names clash with helpers'."""
    return spark.createDataFrame([(*r, 0, 0.5, 7, "own", "c", "r") for r in rows_], DOCS)


EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "Licensed under CC BY 4.0.\n12345", "de", "b"), (None, "no id here", "en", "b"),
    (5, "same text of several words", "en", "a"), (5, "same text of several words", "en", "a"), (5, "other text, one id", "fr", None), (6, LONG, "en", ""), (7, "é" * 50 + " <|endoftext|> 'S 's", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "embeddings", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# 1, 8: classifiers


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    clean = [found[r.doc_id].predicted for r in labels.where("toxic = 0").collect() if held(r.doc_id)]
    assert sum(clean) <= 0.05 * len(clean)


def test_toxicity_recall(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels.where("toxic is not null"), "doc_id")
    bad = F.col("toxic") > 0
    n = found.agg(F.count_if(bad).alias("bad"), F.count_if(bad & (F.col("predicted") == 1)).alias("caught"), F.count_if(~bad).alias("clean"), F.count_if(~bad & (F.col("predicted") == 1)).alias("alarms")).first()
    assert n.bad > 50
    assert n.caught >= 0.9 * n.bad
    assert n.alarms <= 0.005 * n.clean


@pytest.mark.parametrize("least_docs", [1, 3])
def test_ftrl_equals_a_plain_loop(monkeypatch, least_docs):
    monkeypatch.setattr(toxicity, "L1", 0.05)
    rng = np.random.default_rng(3)
    rows_ = [(np.unique(rng.integers(0, 40, 12)), int(rng.random() < 0.3)) for _ in range(120)]
    got = toxicity.ftrl(rows_, epochs=3, least_docs=least_docs)
    seen = Counter(int(i) for x, _ in rows_ for i in x)
    bias, toxic = 1 << toxicity.BITS, sum(y for _, y in rows_)
    z, n = defaultdict(float), defaultdict(float)
    strength = lambda i: 0.0 if i == bias else 0.05 * len(rows_) ** 0.5

    def weight(i):
        if abs(z[i]) <= strength(i):
            return 0.0
        return -(z[i] - np.sign(z[i]) * strength(i)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for x, y in rows_:
            own = [i for i in x.tolist() if seen[i] >= least_docs] + [bias]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            g *= ((len(rows_) - toxic) / toxic) ** 0.5 if y else 1.0
            for i in own:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_toxicity_features_are_words_stems_and_grams():
    one = lambda t: set(toxicity.feature_sets([t])[0].tolist())
    assert len(one("a b c d")) == 4 + 3 + 2 + 2 + 1  # words, pairs, pairs over one and two, triples
    assert len(one("longerword")) == 2
    assert len(one("longerword") & one("longerwards")) == 1
    assert one("") == set()
    assert one("Same same") == one("same SAME")


def test_toxicity_of_ties_and_repeated_rows(spark):
    data = [(i, "good words here" if i % 2 else "vile words here", "en", "a") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, toxic int")
    weights = toxicity.train(make(spark, data), labels)
    twice = toxicity.train(make(spark, data + data), labels.unionByName(labels))
    assert (weights.index.tolist(), weights.weight.tolist(), weights.bias) == (twice.index.tolist(), twice.weight.tolist(), twice.bias)
    got = Counter((r.doc_id, r.score) for r in toxicity.score(make(spark, data + data), weights).collect())
    assert set(got.values()) == {2}
    assert len({s for i, s in got if i % 2}) == 1


def test_toxicity_learns_and_forgets_ids(spark):
    rng = random.Random(1)
    text = lambda bad: " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(40)) + (" vile awful insult" if bad else "")
    data = [(i, text(i % 4 == 0), "en", "a") for i in range(400)]
    d = make(spark, data)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 0), (None, 1), (9, None)], "doc_id bigint, toxic int")
    weights = toxicity.train(d, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(d, weights).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(400)}
    assert toxicity.train(d, labels).weight.tolist() == weights.weight.tolist()
    assert toxicity.keep_clean(d, weights).count() == 300
    assert toxicity.keep_clean(d, weights).columns == d.columns
    none = toxicity.train(d, labels.where("toxic = 0"))
    assert toxicity.score(d, none).where("score > 0").count() == 0


def test_toxicity_edges(spark):
    weights = toxicity.Weights(np.array([5]), np.array([2.0]), -1.0, True)
    got = toxicity.score(make(spark, EDGE), weights).collect()
    assert len(got) == len(EDGE)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {1 / (1 + np.exp(1))}


def test_language_held_out(spark, docs):
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    checked = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if held(r.doc_id)]
    assert sum(a == b for a, b in checked) >= 0.9 * len(checked)


def test_language_sets_equal_enumeration():
    """EM over every set of languages, each by a plain loop: the chosen one has the best penalised likelihood."""
    rng = np.random.default_rng(13)
    for _ in range(30):
        k, n = 3, int(rng.integers(5, 40))
        true = rng.dirichlet(np.ones(k) * 0.4)
        words = rng.normal(-12, 1, (n, k))
        words[np.arange(n), rng.choice(k, n, p=true)] += 6
        words = words.astype(np.float32)
        best = (-np.inf, None, None)
        for members in range(1, 1 << k):
            own = [i for i in range(k) if members >> i & 1]
            share = np.zeros(k)
            share[own] = 1 / len(own)
            like = np.exp(words.astype(np.float64))
            for _ in range(300):
                joint = like * share
                share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            value = np.log((like * share).sum(axis=1)).sum() - langid.PENALTY * np.log(n + 1.0) * (len(own) - 1)
            if value > best[0]:
                best = (value, own, share)
        got = langid.mixture(words, np.array([0]), np.array([n]))[0]
        assert np.flatnonzero(got > 1e-3).tolist() == np.flatnonzero(best[2] > 1e-3).tolist()
        assert got == pytest.approx(best[2], abs=0.05)


def test_language_of_ties_and_repeated_rows(spark):
    data = [(i, "bako bilu" if i % 2 else "zyx qyz", "aa" if i % 2 else "zz", "s") for i in range(60)]
    model = langid.train(make(spark, data))
    assert langid.Model(["aa", "zz"], np.zeros((1 << langid.BITS, 2), np.float32)).predict(["any words"])[0] == ["aa"]
    got = Counter(map(tuple, langid.identify(make(spark, data + data[:10]), model).collect()))
    assert got == Counter({(i, held(i), "aa" if i % 2 else "zz", 1.0): 1 + (i < 10) for i in range(60)})


def test_language_mixture_and_edges(spark):
    words = {"aa": ["bako", "bilu", "banu", "bobi"], "zz": ["zyx", "zwex", "xyzz", "qyz"]}
    rng = random.Random(2)
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    d = make(spark, [(i, text("aa" if i % 2 else "zz", 60), "aa" if i % 2 else "zz", "s") for i in range(200)])
    model = langid.train(d)
    names, shares = model.predict([text("aa", 70) + " " + text("zz", 30), text("zz", 50), "123 !", ""])
    assert names == ["aa", "zz", "und", "und"]
    assert 0.6 < shares[0] < 0.8
    assert shares[1:].tolist() == [1.0, 0.0, 0.0]
    got = langid.identify(make(spark, EDGE), model).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert len(got) == len(EDGE)


def test_mixtures_of_a_hundred_languages():
    """The time a word grows no faster than the languages, and mixtures of two are found among a hundred."""
    import time

    rng = np.random.default_rng(4)
    took = {}
    for k in (4, 100):
        count = np.full(40, 250)
        first = np.cumsum(count) - count
        words = rng.normal(-12, 1, (count.sum(), k)).astype(np.float32)
        for i, f in enumerate(first):
            a, b = i % k, (i + 1) % k
            words[f : f + 150, a] += 8
            words[f + 150 : f + 250, b] += 8
        share = langid.mixture(words, first, count)
        assert (share.argmax(axis=1) == np.arange(40) % k).all()
        assert np.allclose(share.max(axis=1), 0.6, atol=0.05) and ((share > 0.05).sum(axis=1) == 2).all()
        began = time.perf_counter()
        for _ in range(5):
            langid.mixture(words, first, count)
        took[k] = time.perf_counter() - began
    assert took[100] <= 25 * took[4]


# 2, 9: tokens


TEXTS = st.text(st.one_of(st.sampled_from(" '\nstmdrevlaAé1!?<|>Σσİﬁ ́中"), st.characters()), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_and_ids_equal_the_libraries(text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_counts.Counter("byte_bpe_50k.json").counts([text])[0] == len(tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)
    assert packing.encoder_of("word_bpe_49k.json").encode([text])[0].tolist() == tokenizer("word_bpe_49k.json").encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1024, 2048])
def test_counts_and_ids_of_words_that_polynomial_hashes_take_for_one(size):
    for a, b in ("ab", "xq", "é1", "'s", "<|"):
        swaps = [bin(i).count("1") % 2 for i in range(size)]
        texts = ["".join(b if s else a for s in swaps), "".join(a if s else b for s in swaps)] * 2
        texts += [texts[0] + " " + texts[1], texts[1] + "\n" + texts[0]]
        byte, word = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
        assert token_counts.Counter("byte_bpe_50k.json").counts(texts).tolist() == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts]
        encoder = packing.Encoder("word_bpe_49k.json")
        for _ in range(2):  # then from memory
            assert [x.tolist() for x in encoder.encode(texts)] == [word.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("hashes", ["all equal", "few"])
def test_counts_and_ids_where_all_hashes_collide(monkeypatch, docs, hashes):
    few = lambda cp, start, end: (end - start).astype(np.uint64) << np.uint64(62 if hashes == "few" else 63) << np.uint64(1)
    monkeypatch.setattr(pretokens, "run_hashes", few)
    texts = [r.text or "" for r in docs.limit(60).collect()]
    counter, encoder = token_counts.Counter("byte_bpe_50k.json"), packing.Encoder("word_bpe_49k.json")
    byte, word = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    for part in (texts[:20], texts[20:], texts):
        assert counter.counts(part).tolist() == [len(byte.encode(t, add_special_tokens=False).ids) for t in part]
        assert [x.tolist() for x in encoder.encode(part)] == [word.encode(t, add_special_tokens=False).ids for t in part]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(["aA ", "ab1 '\n", "éΣσ中 <|>", "xyz\t\u3000.,"]))
def test_counts_and_ids_of_long_texts(seed, signs):
    rng = random.Random(seed)
    text = "".join(rng.choice(signs) for _ in range(10_000))
    assert token_counts.Counter("byte_bpe_50k.json").counts([text])[0] == len(tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)
    assert packing.Encoder("word_bpe_49k.json").encode([text])[0].tolist() == tokenizer("word_bpe_49k.json").encode(text, add_special_tokens=False).ids


def test_counts_of_repeated_letters():
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 30)]
    assert token_counts.Counter("byte_bpe_50k.json").counts(words).tolist() == [len(tokenizer("byte_bpe_50k.json").encode(w).ids) for w in words]


def test_token_counts(spark, docs):
    library = tokenizer("byte_bpe_50k.json")
    for d in (docs, make(spark, EDGE)):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in d.collect())
        assert Counter(tuple(r) for r in token_counts.token_counts(d).collect()) == want


@pytest.mark.parametrize("group", [2048, 3])
def test_packing(spark, docs, group):
    library = tokenizer("word_bpe_49k.json")
    for d in (docs, make(spark, EDGE)):
        ids = Counter()
        for r in d.collect():
            own = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            ids[(r.doc_id, tuple(own))] += 1
        got = packing.pack(d, group_pieces=group).collect()
        parts = defaultdict(list)
        for r in got:
            parts[(r.doc_id, r.doc_tokens)].append(r)
        want = Counter()
        for (doc, own), n in ids.items():
            for s in range(0, len(own), 4096):
                piece = np.array(own[s : s + 4096], "<u4")
                want[(doc, s, len(piece), zlib.crc32(piece.tobytes()), len(own))] += n
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))]
            assert sum(n for _, n in b) <= 4096
        if d is docs and group == 2048:
            assert sum(r.length for r in got) > 0.97 * 4096 * len(bins)


def test_first_fit_decreasing_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            b = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert {i: (int(bins[i]), int(offsets[i])) for i in range(n)} == want


# 3: mixing


def _targets(sizes: dict) -> dict:
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / total > 3 * sizes[k]]
        if not over:
            return out | {k: left * weight[k] / total for k in free}
        for k in over:
            out[k] = 3.0 * sizes[k]
        left, free = left - sum(3 * sizes[k] for k in over), free - set(over)
    return out


def test_packing_keeps_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, 2**60 + 2, None, -(2**63), 2**63 - 1]
    got = packing.pack(make(spark, [(i, "one two three", "en", "a") for i in ids])).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)


@pytest.mark.parametrize("which", ["documents", "edge", "capped"])
def test_mixing(spark, docs, which):
    capped = [(i, "w " * (1 + i % 9), "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 5 + ["c"] * 3 + [None] * 40)]
    d = {"documents": docs, "edge": make(spark, EDGE), "capped": make(spark, capped)}[which]
    want = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in d.collect())
    got = mixing.mix(d).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == want
    sizes, taken, target, reach = Counter(), Counter(), {}, defaultdict(lambda: 1)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.size * r.copies
        for _ in range(3):
            reach[r.source] |= reach[r.source] << r.size
    assert target == pytest.approx(_targets(sizes))
    for source, goal in target.items():
        under, over = (reach[source] & (1 << int(goal) + 1) - 1).bit_length() - 1, reach[source] >> int(goal) + 1
        best = min(goal - under, int(goal) + (over & -over).bit_length() - goal if over else goal)
        assert abs(taken[source] - goal) <= best + 0.02 * goal + 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(d.repartition(3)).collect()))


def test_subset_reaches_budgets():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 3000, 12))
        have = rng.integers(1, 40, len(lengths))
        budget = int(rng.integers(0, (lengths * have).sum() + 1))
        take = mixing.subset(lengths, have, 1, budget)
        assert ((take >= 0) & (take <= have)).all()
        best, total = 1, int((lengths * take).sum())
        for length, n in zip(lengths.tolist(), have.tolist(), strict=True):
            for _ in range(n):
                best |= best << length
        under = (best & (1 << budget + 1) - 1).bit_length() - 1
        assert abs(budget - total) <= max(50, budget - under)


@pytest.mark.parametrize(
    ("lengths", "have", "budget", "times", "best"),
    [
        ([100, 1_000_000], [100, 1], 950_000, 1, 1_000_000),
        ([150_000], [4], 590_000, 1, 600_000),
        ([150_000, 180_000], [4, 1], 480_000, 1, 480_000),
        ([500_000, 600_000], [2, 1], 1_000_000, 1, 1_000_000),
        ([200_000, 900_000], [1, 1], 1_090_000, 3, 1_100_000),
        ([300_000, 700_000], [1, 1], 900_000, 3, 900_000),
    ],
)
def test_subset_of_long_items(lengths, have, budget, times, best):
    take = mixing.subset(np.array(lengths), np.array(have), times, budget)
    assert ((take >= 0) & (take <= times * np.array(have))).all()
    assert int((np.array(lengths) * take).sum()) == best


def test_subset_of_few_long_items_is_near_the_best():
    rng = np.random.default_rng(4)
    for n in (2, 3, 5, 8):
        for _ in range(20):
            lengths = np.unique(rng.integers(1, 2_000_000, n))
            budget = int(rng.integers(1, lengths.sum()))
            sums = {0}
            for length in lengths.tolist():
                sums |= {s + length * k for s in sums for k in (1, 2)}
            want = min(abs(budget - s) for s in sums)
            took = mixing.subset(lengths, np.ones(len(lengths), np.int64), 2, budget)
            assert ((took >= 0) & (took <= 2)).all()
            assert abs(budget - int((lengths * took).sum())) <= want + 1e-4 * budget


# 4: SimHash


def _components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_by_hand(spark):
    import xxhash

    text = "One two\tTHREE four five É"
    words = ["one", "two", "three", "four", "five", "É"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash.fingerprint(text) == want
    assert spark.sql("SELECT xxhash64('one two three')").first()[0] % 2**64 == hashes[0]
    assert simhash.fingerprint("Ab") == xxhash.xxh64_intdigest(b"ab", 42)
    assert simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("most", [1, 4, 256])
def test_links_connect_what_brute_force_connects(spark, most):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0) for s in seeds for _ in range(30)} | set(seeds)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = [(r.a, r.b) for r in simhash.links(frame, most).collect()]
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert all(close(a, b) for a, b in found)
    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if close(a, b)]
    assert _components(found, signed) == _components(every, signed)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(found, "a bigint, b bigint")).collect()}
    assert {n: got.get(n, n) for n in signed} == _components(every, signed)


@pytest.mark.parametrize("which", ["documents", "edge"])
def test_simhash(spark, docs, which):
    d = docs if which == "documents" else make(spark, EDGE)
    data = d.collect()
    fps = [simhash.fingerprint(r.text or "") for r in data]
    roots = _components([(a, b) for i, a in enumerate(set(fps)) for b in list(set(fps))[:i] if (a ^ b).bit_count() <= 2], set(fps))
    least = {}
    for r, f in zip(data, fps, strict=True):
        if r.doc_id is not None:
            least[roots[f]] = min(least.get(roots[f], r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least.get(roots[f])) for r, f in zip(data, fps, strict=True))
    assert Counter(map(tuple, simhash.components(d).collect())) == want
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert kept.count() == len({roots[f] for f in fps})


def test_connected_components_of_a_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.where("false")).count() == 0


# 5: lines


def test_lines(spark):
    long = "This line is long enough to count"
    data = [(1, f"{long}\nown 1", "en", "a"), (2, f"  {long.upper()} \r\nown 2\n{long}", "en", "a"), (3, f"x\n{long}\n{long}\n", "en", "a"), (4, "", "en", "a"), (None, long, "en", "a"), (5, None, "en", "a"), (1, "another text of the same id", "en", "a"), (6, "short line\n" * 3, "en", "a"), (7, "short line", "en", "a"), (8, "short line", "en", "a")]
    got = Counter(map(tuple, line_dedup.line_report(make(spark, data)).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 2, 1, sha("own 1")), (2, 3, 2, sha("own 2")), (3, 4, 0, sha(f"x\n{long}\n{long}\n")), (4, 1, 0, sha("")), (None, 1, 1, sha("")), (5, 1, 0, sha("")), (1, 1, 0, sha("another text of the same id")), (6, 4, 0, sha("short line\n" * 3)), (7, 1, 0, sha("short line")), (8, 1, 0, sha("short line"))]
    assert got == Counter(want) == _lines_by_hand(data)
    assert Counter(map(tuple, line_dedup.line_report(make(spark, EDGE)).collect())) == _lines_by_hand(EDGE)
    kept = line_dedup.drop_lines(make(spark, data))
    assert kept.columns == make(spark, data).columns
    assert {(r.doc_id, r.text, r.n_chars) for r in kept.where("doc_id = 2 or doc_id = 5").collect()} == {(2, "own 2", 5), (5, None, 0)}


def test_lines_held_by_two_documents_stay(spark):
    line = "A line that two documents hold, in many rows"
    data = [(1, line, "en", "a")] * 4 + [(2, f"{line}\n{line}", "en", "a")]
    assert line_dedup.line_report(make(spark, data)).where("n_dropped > 0").count() == 0


def test_lines_of_neighbouring_large_ids(spark):
    line = "A line that three documents of large ids hold"
    data = [(2**60 + i, line, "en", "a") for i in range(3)] + [(-(2**60) - i, "Another line that three documents hold", "en", "a") for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_report(make(spark, data)).collect()}
    assert got == {2**60: 1, 2**60 + 1: 1, 2**60 + 2: 0, -(2**60): 0, -(2**60) - 1: 1, -(2**60) - 2: 1}


def _lines_by_hand(data):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").translate({i: i + 32 for i in range(65, 91)})
    for doc, text, *_ in data:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-(2**63) if doc is None else doc)
    out = Counter()
    for doc, text, *_ in data:
        lines = (text or "").split("\n")
        own = -(2**63) if doc is None else doc
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or own == max(holders[key(x)])]
        out[(doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_by_brute_force(spark, parts):
    """Hot lines over several partitions and Arrow batches, lines at partitions' ends, repeated rows and a very long text."""
    rng = random.Random(parts)
    pool = [f"Line {i} of the pool, long enough to count" for i in range(60)]
    hot = "A line that a third of all documents hold, and some hold it often"
    data = []
    for i in range(900):
        lines = [rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(4))] + [f"own {i} " * rng.randrange(6)]
        lines += [hot.upper() if i % 2 else hot] * rng.randrange(1, 4) if i % 3 == 0 else []
        rng.shuffle(lines)
        data.append((i, "\n".join(lines), "en", "a"))
    data += data[:20] + [(None, hot, "en", "a"), (2**61, "\n".join([hot] * 5000 + pool + ["x" * 500_000]), "en", "a"), (2**61 + 1, "\n".join(pool * 2), "en", "a"), (7, None, "en", "a")]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert Counter(map(tuple, line_dedup.line_report(make(spark, data)).collect())) == _lines_by_hand(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_bitmaps_are_small(spark):
    data = [(i, "\n".join(f"line number {j} that all documents hold" for j in range(500)), "en", "a") for i in range(3)]
    maps = line_dedup.keep_bitmaps(make(spark, data).select("doc_id", F.xxhash64("text").alias("text_key"), "text")).collect()
    assert {r.doc_id for r in maps} == {0, 1}
    assert all(len(r.bitmap) < 30 for r in maps)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_lines_over_many_batches(spark, batch):
    """Lines repeated over several batches in two documents stay, in three they go."""
    rng = random.Random(batch)
    data = [(d, "\n".join(rng.choice(["two documents hold this line", "three documents hold this line", "one document holds this line", f"line {d} of its own, very long"]) for _ in range(150)), "en", "a") for d in (7, 8, 9)]
    data[0] = (7, data[0][1].replace("two documents", "no two documents"), "en", "a")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    line_dedup.small_batches, kept = lambda d: d, line_dedup.small_batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert Counter(map(tuple, line_dedup.line_report(make(spark, data)).collect())) == _lines_by_hand(data)
    finally:
        line_dedup.small_batches = kept
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_line_repeated_a_million_times_is_read_once(spark):
    import time

    columns = [F.lit(x).cast("bigint").alias(c) for c, x in (("h", 1), ("g", 2), ("doc_id", 5))]
    dealt = spark.range(0, 1_000_000, 1, 1).select(*columns, F.col("id").cast("int").alias("pos"), F.lit(1).cast("bigint").alias("text_key"), F.lit(1_000_000).alias("n_lines"))
    other = dealt.withColumn("doc_id", F.lit(4).cast("bigint"))
    began = time.perf_counter()
    assert line_dedup.lost(dealt.union(other).coalesce(1), {}, 3).count() == 0
    assert time.perf_counter() - began < 30
    third = dealt.limit(2).withColumn("doc_id", F.lit(3).cast("bigint"))
    assert line_dedup.lost(dealt.union(other).union(third).coalesce(1), {}, 3).count() == 1_000_002


# 6: licences


def test_license_texts_and_notices(spark):
    mit = "MIT Licence\n\nCopyright (c) 2020 Somebody\n\n" + licenses.MIT_GRANT.replace("sublicense", "sub-license").upper()
    data = [(1, mit, "en", "a"), (2, f"some prose\n* Released under the MIT License *\nLicenced under CC BY-NC 4.0\nReleased under the MIT license", "en", "a"), (3, licenses.MIT_GRANT + " and more", "en", "a"), (4, None, "en", "a")]
    got = {r.doc_id: r for r in licenses.scan(make(spark, data)).collect()}
    assert (got[1].license_id, got[2].license_id, got[3].license_id, got[4].license_id) == ("MIT", None, None, None)
    assert (got[2].notices, got[2].n_notices) == ("CC-BY-NC-4.0,MIT", 3)
    assert got[4].digest == hashlib.sha256(b"").hexdigest()
    assert len(licenses.known_texts()) < 200
    assert licenses.scan(make(spark, EDGE)).count() == len(EDGE)


@pytest.mark.parametrize("width", [30, 47, 60, 72, 80, 100])
def test_license_texts_in_any_wrapping(spark, width):
    wrap = lambda text: "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
    data = []
    for license_id, text in licenses.TEXTS:
        starred = re.sub(r"(?m)^[0-9]\. ", "* ", text)
        for form in (text, starred, re.sub(r"(?m)^([0-9])\. ", r"(\1) ", text), " ".join(text.split())):
            for head in ("", "Copyright (c) 2020 Some Body\n\n", "Copyright 2019-2020, Some Body\nAll rights reserved.\n\n", "Copyright Some Body\n\n"):
                data.append((license_id, head + wrap(form), "en", "a"))
    numbered = [(i, *x[1:]) for i, x in enumerate(data)]
    got = {r.doc_id: r.license_id for r in licenses.scan(make(spark, numbered)).collect()}
    assert [got[i] for i in range(len(data))] == [x[0] for x in data]


LONG_TEXTS = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize("file", sorted(LONG_TEXTS))
def test_long_license_texts(spark, file):
    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("no installed licence texts")
    text = path.read_text()
    own = lambda p: re.search(r"(?m)^\s*Copyright", p)  # noqa: E731  # a line that states a copyright stays one
    wrap = lambda width: "\n\n".join(p if own(p) else textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n\s*\n", text))
    forms = [text, text.upper(), text.replace("license", "licence"), wrap(66), wrap(100), text.replace("\n", "\r\n"), text.split("END OF TERMS AND CONDITIONS")[0], text.replace("warranty", "guaranty", 1)]
    got = {r.doc_id: r.license_id for r in licenses.scan(make(spark, [(i, t, "en", "a") for i, t in enumerate(forms)])).collect()}
    same = text == forms[7]
    assert [got[i] for i in range(8)] == [LONG_TEXTS[file]] * 7 + [LONG_TEXTS[file] if same else None]


def test_every_known_license_text_has_a_cue():
    texts = [t for _, t in licenses.known_texts()] + [p.read_text() for f in LONG_TEXTS if (p := Path("/usr/share/common-licenses", f)).exists()]
    assert all(any(cue in " ".join(t.lower().split()) for cue in licenses.CUES) for t in texts)


def test_licenses_of_edge_rows(spark):
    got = Counter((r.doc_id, r.license_id, r.notices, r.n_notices) for r in licenses.scan(make(spark, EDGE)).collect())
    assert got == Counter((i, None, "CC-BY-4.0" if i == 4 else "", int(i == 4)) for i, *_ in EDGE)


def test_license_texts_that_differ_stay_apart(spark):
    known = spark.createDataFrame([("A", "1. Keep this.\n2. Keep that."), ("B", "2. Keep this.\n1. Keep that.")], "license_id string, text string")
    data = [(1, "1. Keep this.\n2. Keep that.", "en", "a"), (2, "2. Keep this.\n1. Keep that.", "en", "a"), (3, "* Keep this.\n* Keep that.", "en", "a"), (4, licenses.ISC_GRANT, "en", "a")]
    assert {r.doc_id: r.license_id for r in licenses.scan(make(spark, data), known).collect()} == {1: "A", 2: "B", 3: None, 4: None}


# 7, 10: vectors


VECTORS = "vec_id bigint, embedding array<float>, label int, score double, keys string"


def vectors(spark, data):
    return spark.createDataFrame([(*r, 0.1, "k") for r in data], VECTORS)


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), rng.normal(size=8).round(2).tolist(), 0) for i in range(200)]
    data += [(50, data[50][1], 0), (50, [1.0] * 8, 0), (None, [2.0] * 8, 0), (100, None, 0), (150, [1.0, None] + [0.0] * 6, 0), (0, [float("nan")] * 8, 0), (350, [1.0] * 3, 0), (351, [-5.0] * 3, 0), (400, [], 0)]
    fine = [(v, np.floor(256 * np.array(x, np.float32).astype(np.float64)).astype(np.int64)) for v, x, _ in data if x is not None and None not in x and not np.isnan(x).any()]
    want = Counter()
    for i, (v, x) in enumerate(fine):
        if v is not None and v % 50 == 0:
            scored = sorted((-int(x @ y), w if w is not None else 2**63, w) for j, (w, y) in enumerate(fine) if j != i and len(x) == len(y))
            want.update((v, rank, w, -s) for rank, (s, _, w) in enumerate(scored[:5], 1))
    assert Counter(map(tuple, topk.top_k(vectors(spark, data)).collect())) == want


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(10)
    data = [(int(i), [float(9_000_000 * (-1) ** (i // 7) - i), *(rng.normal(size=7) * 2e5).round().tolist()], 0) for i in range(150)] + [(151, [2.0**56] * 8, 0), (152, [1e30] * 8, 0), (153, [float("inf")] * 8, 0)]
    fine = {v: [int(np.floor(256 * np.float64(np.float32(c)))) for c in x] for v, x, _ in data if v < 151}
    got = defaultdict(list)
    for r in topk.top_k(vectors(spark, [x for x in data if x[0] != 151])).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    assert got == {q: sorted(((v, dot(fine[q], y)) for v, y in fine.items() if v != q), key=lambda p: (-p[1], p[0]))[:5] for q in (0, 50, 100)}
    assert {r.vec_id for r in topk.integers(vectors(spark, data), 256).collect()} == set(fine)
    assert topk.integers(vectors(spark, [(1, [2.0**54, -(2.0**54)], 0)]), 256).first().x == [2**62, -(2**62)]


def test_top_k_in_many_blocks(spark, monkeypatch):
    vec = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = Counter(map(tuple, topk.top_k(vec).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    assert Counter(map(tuple, topk.top_k(vec).collect())) == want


def test_top_k_keeps_ids_of_all_64_bits(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    rng = np.random.default_rng(14)
    ids = [-(2**63), 2**63 - 1, -(2**62) - 1, 0, 50, *(rng.integers(-(2**63), 2**63, 400) // 50 * 50).tolist(), None, None]
    data = [(i, rng.integers(-3, 4, 4).astype(float).tolist(), 0) for i in ids]
    x = 256 * np.array([r[1] for r in data], np.int64)
    want = Counter()
    for i, v in enumerate(ids):
        if v is not None and v % 50 == 0:
            scored = sorted((-int(x[i] @ x[j]), w is None, w or 0, w) for j, w in enumerate(ids) if j != i)
            want.update((v, rank, w, -s) for rank, (s, _, _, w) in enumerate(scored[:5], 1))
    one = vectors(spark, data).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert Counter(map(tuple, topk.top_k(one).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    found = topk.Search(np.array([-(2**63)]), np.array([[1, 0]]), 2)
    found.add(np.array([-(2**63) + 1, 2**63 - 1]), np.array([[5, 0], [4, 0]]))
    found.add(np.array([0, 7]), np.array([[1, 0], [2, 0]]), np.array([True, False]))
    assert found.best.tolist() == [[-(2**63) + 1, 2**63 - 1]]


def test_bounds_discard_pairs_of_structured_vectors():
    rng = np.random.default_rng(12)
    x = np.cumsum(rng.normal(size=(6000, 64)), axis=1)
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(len(x))
    asked = ids[::50]
    found = topk.Search(asked, x[asked], 5)
    for i in range(0, len(x), 1500):
        found.add(ids[i : i + 1500], x[i : i + 1500])
    share = found.left / found.left[0]
    assert (np.diff(share) < 0).all()
    assert share[-1] < 0.05
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -(2**62)
    for i in range(len(asked)):
        order = np.lexsort((ids, -exact[i]))[:5]
        assert (found.best[i].tolist(), found.score[i].tolist()) == (order.tolist(), exact[i][order].tolist())


def test_bounds_hold():
    rng = np.random.default_rng(6)
    for d in (1, 3, 64):
        x, y = rng.integers(-300, 300, (40, d)), rng.integers(-300, 300, (50, d))
        exact = x @ y.T
        levels = [a @ b.T for a, b in zip(topk._segments(x.astype(float)), topk._segments(y.astype(float)), strict=True)]
        assert all((bound + 1e-6 >= exact).all() for bound in levels)


def _dedup_by_hand(data, least=0.93):
    ok = {i: np.array(x, np.float32).astype(np.float64) for i, (_, x, lab, *_) in enumerate(data) if x and lab is not None and None not in x and np.isfinite(x).all() and any(x)}
    close = lambda a, b: data[a][2] == data[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= least
    pairs = [(a, b) for a in ok for b in ok if a < b and close(a, b)]
    links = Counter(x for p in pairs for x in p)
    roots = _components(pairs, range(len(data)))
    out = Counter()
    for i, row in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if roots[j] == roots[i] and data[j][0] is not None]
        component = min(ids) if ids else None
        out[(row[0], links[i], component, row[0] == component)] += 1
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_dedup_by_brute_force(spark, block):
    rng = np.random.default_rng(7)
    data = []
    for i in range(40):
        base = rng.normal(size=16)
        for j in range(6):
            data.append((10 * i + j, (base + rng.normal(size=16) * 0.04).astype(np.float32).tolist(), i % 2))
    data += [(900 + i, data[0][1], 0) for i in range(40)]
    data += [(5000, [0.0] * 16, 0), (5001, None, 0), (5002, [None] * 16, 0), (5003, [float("nan")] * 16, 0), (5004, data[0][1], None), (None, data[0][1], 0), (5005, [], 0), (5006, [1.0, 0.0], 0), (5007, [3.0, 0.0], 0), (5008, [float("inf")] * 16, 0)]
    got = Counter(map(tuple, embed_dedup.near_duplicates(vectors(spark, data), block=block).collect()))
    assert got == _dedup_by_hand(data)


def test_embedding_dedup_recall_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    data = []
    for i in range(400):
        u = rng.normal(size=64)
        u /= np.linalg.norm(u)
        v = rng.normal(size=64)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        data += [(2 * i, u.tolist(), 0), (2 * i + 1, (0.935 * u + np.sqrt(1 - 0.935**2) * v).tolist(), 0)]
    for plan in (None, embed_dedup.Plan(2, 0.6, 24), embed_dedup.Plan(3, 0.5, 36)):
        found = embed_dedup.near_duplicates(vectors(spark, data), plan=plan).where("n_links > 0").count()
        assert found >= 0.95 * 800


def test_embedding_dedup_comparisons_do_not_grow_with_the_table():
    rng = np.random.default_rng(11)
    meets = []
    for n in (2500, 10_000, 40_000):
        x = rng.normal(size=(n, 64))
        keys = embed_dedup.cells(x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(n, np.int64), embed_dedup.plan_for(n))
        together = 0
        for t in range(keys.shape[1]):
            filed = np.unique(np.stack((np.repeat(np.arange(n), 2), keys[:, t].ravel()), axis=1), axis=0)
            _, size = np.unique(filed[:, 1], return_counts=True)
            together += (size * (size - 1)).sum()
        meets.append(together / n)
    assert max(meets) <= 8


def test_embedding_dedup_of_doubles_beyond_floats(spark):
    rows_ = [(1, [1e200, 0.0], 0), (2, [1e200, 1e198], 0), (3, [1e-200, 0.0], 0), (4, [0.0, 5.0], 0), (5, [5.0, 0.1], 1)]
    d = spark.createDataFrame(rows_, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(d).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_e8_points_are_nearest():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8)) * 2
    near = embed_dedup.e8(x)
    doubled = np.rint(2 * near).astype(int)
    assert ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all()
    assert (doubled.sum(axis=1) % 4 == 0).all()
    assert ((x - near) ** 2).sum(axis=1).max() <= 1 + 1e-9
    roots = [r for r in np.unique(embed_dedup.e8(rng.normal(size=(4000, 8))), axis=0) if (r**2).sum() == 2]
    for r in roots[:60]:
        assert (((x - near) ** 2).sum(axis=1) <= ((x - near - r) ** 2).sum(axis=1) + 1e-9).all()


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    texts = [r.text for r in corpus_pipeline.STAGES[2][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()]
    fps = [simhash.fingerprint(t) for t in texts]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_on_edge_rows(spark, tmp_path):
    import corpus_pipeline

    make(spark, EDGE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
