"""Mixing sources to target weights: subset-sum budget fitting over counts by exact length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
MOST_TIMES = 3
#: The columns that mix() adds.
ADDED = ("size", "source_size", "target", "copies", "taken")
#: Buckets that the documents of one source and length are ranked in.
BUCKETS = 1024
#: Words of budget that dynamic programming fits; the rest is filled by length before.
ROOM = 16384
#: Sums that the search over the whole budget tells apart, at most and at least, and its sums times steps.
SUMS, FEWEST, WORK = 1 << 20, 1 << 16, 1 << 31


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from the words of each source (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; together they get all words,
    none more than MOST_TIMES its own. The excess goes to the others by weight: a source
    is full if its size per weight is at most the level that the rest then shares. The
    table has one row for each source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    least_first = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = least_first.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", (F.row_number().over(in_order) - 1) % 3 + 1)
        .withColumn("cap", MOST_TIMES * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.when(F.col("ratio") > F.col("left") / F.col("weights"), F.col("left") / F.col("weights")))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double"))))
        .drop("weight", "cap", "ratio", "left", "weights", "level")
    )


def subset(lengths: np.ndarray, have: np.ndarray, times: int, budget: int) -> np.ndarray:
    """How many items of each length to take (have[i] different ones, each up to `times`) for a sum next to the budget.

    First the same share of every length, then one more of each from the longest while more
    than ROOM words are left. The last words are fitted by bounded-knapsack dynamic
    programming over bit sets of reachable sums: with items not taken yet, and only if
    these don't meet the budget, with items a further time. If the sum is then further off
    than the lengths' common divisor explains, as with a few long items, all items are
    fitted to the whole budget instead, if that comes nearer.
    """
    total = int((lengths * have).sum())
    take = np.array([int(n) * min(budget, times * total) // total for n in have.tolist()], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable").tolist()
    for i in order:
        more = min(int(have[i] - take[i]), max(0, left - ROOM) // int(lengths[i])) if take[i] < have[i] else 0
        take[i] += more
        left -= more * int(lengths[i])
    goal = max(0, min(left, 4 * ROOM))
    mask = (1 << (2 * goal + 1)) - 1
    reach, steps = 1, []
    for free_of in (np.maximum(have - take, 0), times * have - np.maximum(take, have)):
        for i in order[::-1]:
            length = int(lengths[i])
            free, k = min(int(free_of[i]), 2 * goal // length), 1
            while free > 0 and not reach >> goal & 1:
                k = min(k, free)
                steps.append((reach, i, k))
                reach |= reach << k * length & mask
                free, k = free - k, k * 2
    under, over = (reach & (1 << goal + 1) - 1).bit_length() - 1, reach >> goal + 1
    above = goal + (over & -over).bit_length() if over else 3 * goal + 1
    at = under if goal - under <= above - goal else above
    for before, i, k in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    miss = abs(budget - int((lengths * take).sum()))
    other = _nearest(lengths, have, times, budget, miss)
    return take if other is None else other


def _nearest(lengths: np.ndarray, have: np.ndarray, times: int, budget: int, miss: int) -> np.ndarray | None:
    """How many items of each length to take for the sum nearest to the budget; None if none is nearer than miss.

    One reached sum is held for each of many equal ranges up to budget + miss: exact if a range is
    one word wide, else near to within some ranges. A sum keeps the step that reached it
    first, so the way back needs no more. Items are first taken once, then, unless these meet
    the budget, further times.
    """
    divisor = int(np.gcd.reduce(lengths))
    least = min(budget % divisor, -budget % divisor)
    if miss <= least:
        return None
    items = []
    for free_of in (have, (times - 1) * have):
        for i in np.argsort(-lengths, kind="stable").tolist():
            free, k = int(free_of[i]), 1
            while free > 0:
                k = min(k, free)
                items.append((i, k, k * int(lengths[i])))
                free, k = free - k, k * 2
    top = budget + miss  # sums from here on are no nearer
    items = [x for x in items if x[2] < top]
    width = -(-top // min(SUMS, max(FEWEST, WORK // max(1, len(items)))))
    sums, step = np.full(-(-top // width), -1, np.int64), np.full(-(-top // width), -1, np.int32)
    sums[0], best = 0, (abs(budget), 0, -1)
    for t, (_, _, more) in enumerate(items):
        new = sums[: (top - 1 - more) // width + 1]
        new = new[new >= 0] + more
        new = new[new < top]
        if not len(new):
            continue
        off = np.abs(new - budget)
        if int(off.min()) < best[0]:
            best = int(off.min()), int(new[off.argmin()]), t
        place = new // width
        fresh = sums[place] < 0
        place, new = place[fresh], new[fresh]
        sums[place], step[place] = new, t
        if best[0] <= least:
            break
    if best[0] >= miss:
        return None
    take, (_, at, t) = np.zeros(len(lengths), np.int64), best
    while at:
        i, k, more = items[t]
        take[i] += k
        at -= more
        t = int(step[at // width])
    return take


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    """For one source, the passes over all of it and how many documents of each length come once more."""
    rows = rows.sort_values("size", ignore_index=True)
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(min(MOST_TIMES, target // size)) if size else 0
    length, have = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    extra, some = np.zeros(len(rows), np.int64), length > 0
    budget = int(round(target)) - passes * size
    if passes < MOST_TIMES and budget > 0 and some.any():
        extra[some] = subset(length[some], have[some], MOST_TIMES - passes, budget)
    whole = extra // np.maximum(have, 1)
    return rows.assign(passes=passes + whole, extra=extra - whole * have)[["__source", "size", "source_size", "target", "passes", "extra"]]


def mix(docs: DataFrame, seed: int = 3) -> DataFrame:
    """All rows and columns of docs with size, source_size, target, copies and taken.

    size is the number of words (0 for null), taken = size x copies the words that the mix
    takes. Every source is passed over whole as often as its target allows; for the
    rest documents are counted by exact length, a number of each length is fitted to the
    remaining budget, and so many of each length are chosen by a seeded hash. Documents
    without words are passed over like the others, but never chosen. The longest step of a
    source sees one row for each distinct length.

    Null sources are one source, the last. Repeated rows count and are taken one by one.
    A source of many documents meets its target exactly; one of few comes as near as sums of
    its lengths allow (if its budget is beyond half of SUMS words, to within a few of its SUMS-th
    parts, or FEWEST-th if it has many lengths). An empty table gives an empty result; clashing columns of docs are
    replaced.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = docs.select(*columns).withColumns(
        {
            "size": words(F.col("text")),
            "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),  # null apart from ""
            "__draw": draw,
            "__bucket": F.pmod(F.shiftright(draw, 20), F.lit(BUCKETS)),
            "__tie": F.xxhash64(F.lit(seed), F.col("text")),
        }
    )
    keys = ["__source", "size", "__bucket"]
    buckets = cut(sized.groupBy(*keys).agg(F.count("*").alias("n"), F.first("source").alias("source")))
    counts = buckets.groupBy("__source", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    sizes = counts.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.first("source").alias("source"))
    schema = "__source string, size bigint, source_size bigint, target double, passes int, extra bigint"
    quotas = counts.drop("source").join(targets(sizes).drop("source"), "__source").groupBy("__source").applyInPandas(_quotas, schema)
    # the chosen documents of a length fill its buckets in their order
    before = Window.partitionBy("__source", "size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = buckets.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "source")
    share = places.join(quotas, ["__source", "size"]).withColumn("__extra", F.col("extra") - F.col("__before")).drop("__before", "extra")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__draw", "__tie"))
    copies = (F.col("passes") + (rank <= F.col("__extra")).cast("int")).alias("copies")
    mixed = sized.join(share, keys).select(*columns, "size", "source_size", "target", copies)
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))
