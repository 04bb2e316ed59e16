"""Spelling variants: asymmetric q-chunks find all pairs of words that one edit apart.

The shorter word of a pair gives two disjoint chunks, its halves; the other one its
positional grams of the same length. One edit leaves a half as it is, at its place or
shifted by one. What is left of both words is one edit apart again, so chunks and grams are
taken of it, too: a chunk and a chunk of the rest, some three quarters of a word, make the key of
an equality join, and the distance is verified on what has met.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, small_batches

#: Runs of letters of Latin scripts (two signs among them, × and ÷), long enough to be a word.
RUN = re.compile("[A-Za-zÀ-ÿ]{7,}")
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A run in so many loses a code point.
EVERY = 31
#: Code points and occurrences that a word has at least.
LEAST_CHARS, LEAST_TIMES = 7, 2
#: A form is so many times as frequent as the word.
RATIO = 10
#: Words that may meet at one key; at larger ones what the key leaves of the words decides, too.
MOST = 64
#: Characters of a text that are split at a time, and words that a task counts before it hands them on.
SLICE, MOST_WORDS = 1_000_000, 500_000


def runs_of(text: str) -> Counter:
    """The runs of at least LEAST_CHARS letters in a text, A-Z lower-cased, and how often each stands there."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = OTHER.search(text, min(at + SLICE, len(text)))
        end = stop.start() if stop else len(text)
        found.update(RUN.findall(text[at:end].translate(LOWER)))
        at = end + 1
    return found


def word_of(seed: int, run: str) -> str:
    """The run, or the run without one code point where the crc32 that goes on from seed says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """word and n of the words in whole texts that have at least LEAST_CHARS code points, found LEAST_TIMES times or more.

    A null text has no words, a null doc_id counts as empty text; repeated rows count
    as often as they are there. Tasks count before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            words.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for run, n in runs_of(text).items():
                    if len(word := word_of(seed, run)) >= LEAST_CHARS:
                        words[word] += n
                if len(words) >= MOST_WORDS:
                    yield out()
        yield out()

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = small_batches(docs).where("text is not null").select(ids.alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _without(word: Column, at: Column) -> Column:
    """The word without its code point number `at`, from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def _split(word: Column, size: Column, second: bool, shift: int) -> tuple[Column, Column]:
    """A chunk of a word of `size` code points, or the gram of the same length of one with `shift` more, and the rest.

    Of all positional grams, those can equal a chunk that lie where one edit leaves it: a
    word of the same size (shift 0) keeps either half at its place; in a word that is longer by
    one code point (shift 1) the first half stays or the second one moves up by one.
    """
    q = F.floor(size / 2).cast("int")
    if not second:
        return F.substring(word, F.lit(1), q), F.substring(word, q + 1, size)
    return F.substring(word, q + shift + 1, q), F.concat(F.substring(word, F.lit(1), q + shift), F.substring(word, 2 * q + shift + 1, size))


def keys(words: DataFrame, *, free: bool = False) -> DataFrame:
    """word, n, key, way and shift: four keys of each word as one of the key's size, and four as one of a code point more.

    A way is whether a key's chunk is the second half (2) and whether the rest's is (1). With `free` also what
    the key leaves of the word.
    """
    halves, places = words.select("word", "n", F.length("word").alias("size")), [(shift, second) for shift in (0, 1) for second in (0, 1)]
    for shift, second in places:
        chunk, rest = _split(F.col("word"), F.col("size") - shift, bool(second), shift)
        halves = halves.withColumns({f"chunk{shift}{second}": chunk, f"rest{shift}{second}": rest})
    out = []
    for shift, second in places:
        size = F.col("size") - shift
        left = size - F.floor(size / 2).cast("int")
        for last in (0, 1):
            part, other = _split(F.col(f"rest{shift}{second}"), left, bool(last), shift)
            way = F.lit(2 * second + last)
            own = [F.xxhash64(size, way, F.col(f"chunk{shift}{second}"), part).alias("key"), way.alias("way"), F.lit(shift).alias("shift")]
            out.append(F.struct(*own, *([other.alias("free")] if free else [])))
    return halves.select("word", "n", F.inline(F.array(*out)))


def _way(a: Column, b: Column, shift: Column) -> Column:
    """The one way of a pair of near words: the first halves, of the words and of what is left, count if they are equal."""
    size, q = F.length(a), F.floor(F.length(a) / 2).cast("int")
    h = F.floor((size - q) / 2).cast("int")
    first = lambda w, n: F.substring(w, F.lit(1), n)
    same = first(a, q) == first(b, q)
    rest_a = F.when(same, F.substring(a, q + 1, size)).otherwise(F.concat(first(a, q), F.substring(a, 2 * q + 1, size)))
    rest_b = F.when(same, F.substring(b, q + 1, size + 1)).otherwise(F.concat(first(b, q + shift), F.substring(b, 2 * q + shift + 1, size)))
    return F.when(same, 0).otherwise(2) + F.when(first(rest_a, h) == first(rest_b, h), 0).otherwise(1)


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, a_n, b, b_n of every pair of words (word, n) that one edit apart, each pair once.

    Words that share a key meet and are verified. Keys at which over `most` words stand are
    never met as a whole: there meet the parts that the key leaves of the words, equal but for one
    place, or after the longer one has lost a code point. No more words than there are
    letters share such a part, so the work stays in proportion to the words and the pairs found.
    Keys are hashes; two that collide let words meet that the verification keeps apart.
    """
    counted = keys(words).groupBy("key").agg(F.count_if(F.col("shift") == 0).alias("own"), F.count("*").alias("all"))
    hot = cut(counted.where((F.col("own") > 0) & (F.col("all") > most)).select("key"))
    each_once = (F.col("shift") == 1) | (F.col("a") < F.col("b"))
    near = F.expr("levenshtein(a, b, 1) = 1")

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows as the shorter word or one of two of a size, and as the other one."""
        a = rows.where("shift = 0").withColumnsRenamed({"word": "a", "n": "a_n"}).drop("shift")
        return a, rows.withColumnsRenamed({"word": "b", "n": "b_n"}).drop("way")

    a, b = sides(keys(words).join(hot, "key", "left_anti").repartition("key"))  # dealt once for both
    met = a.join(b, "key")

    # at hot keys: parts of one size equal but for one place, or one part equal to the other one less a code point
    a, b = sides(keys(words, free=True).join(hot, "key", "left_semi"))
    places = F.sequence(F.lit(1), F.length("free"))
    open_at = F.transform(places, lambda i: F.struct(i.alias("at"), _without(F.col("free"), i).alias("part")))
    less = F.array_distinct(F.transform(places, lambda i: F.struct(F.lit(0).alias("at"), _without(F.col("free"), i).alias("part"))))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("free").alias("part")))
    mine = a.select("key", "way", "a", "a_n", F.inline(F.concat(open_at, whole))).withColumn("shift", F.when(F.col("at") > 0, 0).otherwise(1))
    theirs = b.select("key", "b", "b_n", "shift", F.inline(F.when(F.col("shift") == 0, open_at).otherwise(less)))
    apart = mine.join(theirs, ["key", "shift", "at", "part"])

    columns = ["way", "shift", "a", "a_n", "b", "b_n"]
    found = met.select(columns).unionByName(apart.select(columns)).where(each_once).where(near)
    return found.where(F.col("way") == _way(F.col("a"), F.col("b"), F.col("shift"))).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word that has a form: forms followed to the last, twice as far each round.

    A form is RATIO times as frequent as its word, so that chains are short.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word in docs (doc_id, text, ...).

    Words are the runs of letters of whole texts (see count_words); near words differ by
    exactly one inserted, deleted or replaced code point. A word's form is its most frequent
    near word, of equal ones the first in code-point order, if it is `ratio` times as
    frequent as the word or more, else null; its root is the last of the forms that follow each other.

    A null text has no words, a null doc_id counts as empty text, repeated rows count
    again, other columns are left out; an empty table, or one without words, gives an empty
    result.
    """
    words = cut(count_words(docs))
    pairs = near_pairs(words, most)
    seen_from = lambda word, near: F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(f"{near}_n").alias("near_n"))
    both = pairs.select(F.inline(F.array(seen_from("a", "b"), seen_from("b", "a"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
