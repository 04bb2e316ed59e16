"""Embedding near-duplicates by lattice hashing.

A table projects a vector at random to one or more blocks of eight dimensions and decodes each
block's point to the nearest point of the E8 lattice; the blocks' points together are the
vector's cell. A vector is filed under its own cell and under the neighbouring cell across the
nearest border. Vectors of one label that share a cell of any table are compared by their
exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lodestar.llm.common import connected_components, cut, mixed

SEED = 10
#: Vectors of a cell that one step compares with as many others; larger cells are split.
BLOCK = 1024
#: Groups up to this size are compared together, larger ones by matrix products.
SMALL = 32
#: Bits of a cell's key beyond those that number all filed rows: so rarely two cells share a key,
#: which costs comparisons and nothing else.
SPARE_BITS = 10
#: A class of more than this share of all rows is joined by broadcast: there are fewer of them than its inverse.
HOT = 1e-3


class Plan(NamedTuple):
    """Blocks of eight dimensions in a cell, scale of the projection, and tables."""

    blocks: int
    scale: float
    tables: int


#: By the vectors of the largest label, which cells: a pair of cosine 0.93 meets with a chance of about 0.96 in
#: each row, and a vector meets about five others or fewer by chance, so the comparisons don't grow with the square.
PLANS = [
    (400, Plan(1, 0.7, 9)),
    (6_000, Plan(2, 0.5, 14)),
    (40_000, Plan(2, 0.6, 24)),
    (200_000, Plan(3, 0.5, 36)),
    (2_000_000, Plan(3, 0.6, 76)),
    (2**63, Plan(4, 0.6, 280)),
]


def plan_for(n: int) -> Plan:
    """The cells for n vectors of one label."""
    return next(plan for most, plan in PLANS if n <= most)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8, the integer points of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    rest = x[odd] - near[odd]
    worst = np.abs(rest).argmax(axis=1)
    at = np.arange(len(odd))
    near[odd, worst] += np.where(rest[at, worst] >= 0, 1, -1)
    return near


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: D8 and D8 shifted by one half in all coordinates."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@cache
def _projection(dim: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([SEED, dim])
    size = 8 * plan.blocks * plan.tables
    return draw.normal(size=(dim, size)) * plan.scale, draw.random(size)


def cells(unit: np.ndarray, label: np.ndarray, plan: Plan, bits: int = 63) -> np.ndarray:
    """Keys (vectors x tables x 2) of the cells of unit vectors: their own and a neighbour.

    The neighbour differs in the block that lies nearest to its cell's border; the two
    are equal if no block lies near one.
    """
    matrix, shift = _projection(unit.shape[1], plan)
    points = (unit @ matrix + shift).reshape(len(unit), plan.tables, plan.blocks, 8)
    keys = np.empty((len(unit), plan.tables, 2), np.int64)
    weights = mixed(np.arange(1, 9, dtype=np.uint64))
    salt = mixed(label.astype(np.int64).view(np.uint64) * np.uint64(2**32 + 15) + np.uint64(unit.shape[1]))
    for t in range(plan.tables):
        codes, margin = np.empty((2, len(unit), plan.blocks), np.uint64), np.empty((len(unit), plan.blocks))
        for b in range(plan.blocks):
            p = points[:, t, b]
            own = e8(p)
            other = e8(2 * p - own)
            margin[:, b] = ((p - other) ** 2).sum(axis=1) - ((p - own) ** 2).sum(axis=1)
            margin[(own == other).all(axis=1), b] = np.inf
            for k, cell in enumerate((own, other)):
                codes[k, :, b] = (np.rint(2 * cell).astype(np.int64).view(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        nearest = margin.argmin(axis=1)
        for k in (0, 1):
            h = salt + np.uint64(t)
            for b in range(plan.blocks):
                h = mixed(h ^ np.where((nearest == b) & (k == 1), codes[1, :, b], codes[0, :, b]))
            keys[:, t, k] = (h >> np.uint64(64 - bits)).astype(np.int64)
    return keys


def _can_link() -> Column:
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    some = F.exists("embedding", lambda c: c != 0)
    return F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x and h of the rows that can link: h is half of the SHA-256 of the vector's digits, so equal only for equal ones."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    x = F.col("embedding").cast(f"array<{'float' if single else 'double'}>")
    h = F.substring(F.unhex(F.sha2(F.concat_ws(",", x.cast("array<string>")), 256)), 1, 16)
    return vectors.where(_can_link()).select("vec_id", "label", x.alias("x"), h.alias("h"))


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _indexed(classes: DataFrame, plan: Plan, bits: int) -> DataFrame:
    """c, label, h, least, times, v (the vector's bytes) and keys (the distinct ones) of each class."""
    item = "<f4" if isinstance(classes.schema["x"].dataType.elementType, FloatType) else "<f8"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("x").value_lengths())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(item).reshape(len(part), -1)
                keys = cells(_units(x), part.column("label").to_numpy(), plan, bits).reshape(len(x), -1)
                columns = [*(part.column(c) for c in names[:5]), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([np.unique(k) for k in keys], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["c", "label", "h", "least", "times", "v", "keys"]
    types = [classes.schema[x].dataType.simpleString() for x in names[:5]] + ["binary", "array<bigint>"]
    return classes.select(*names[:5], "x").mapInArrow(apply, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def _pairs(group: np.ndarray, side: np.ndarray, across: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one group with a cosine of at least `least`; groups are runs of rows.

    In groups with across set only rows of different sides are compared.
    """
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    found = []
    for start, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        part = slice(start, start + n)
        if across[start]:
            one, other = (np.flatnonzero(side[part] == s) + start for s in (0, 1))
            a, b = np.nonzero(unit[one] @ unit[other].T >= least)
            found.append((one[a], other[b]))
        else:
            a, b = np.nonzero(np.triu(unit[part] @ unit[part].T >= least, 1))
            found.append((a + start, b + start))
    at, far = np.flatnonzero(np.repeat(size <= SMALL, size)), 1
    while len(at):
        at = at[at + far < len(group)]
        at = at[group[at] == group[at + far]]
        for i in range(0, len(at), 100_000):
            a = at[i : i + 100_000]
            a = a[~across[a] | (side[a] != side[a + far])]
            near = np.einsum("ij,ij->i", unit[a], unit[a + far]) >= least
            found.append((a[near], a[near] + far))
        far += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _meetings(a: np.ndarray, b: np.ndarray, key: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the rows of a pair share a cell, and whether the group is the first where they meet, so that each pair counts once.

    The first is the smaller shared key of the first table that has one.
    """
    shares, first = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for i in range(0, len(a), 20_000):
        part = slice(i, i + 20_000)
        x, y = keys[a[part]], keys[b[part]]
        same = (x[:, :, :, None] == y[:, :, None, :]).any(axis=3)
        met = same.any(axis=2)
        table = met.argmax(axis=1)
        at = np.arange(len(x))
        least = np.where(same[at, table], x[at, table], np.iinfo(np.int64).max).min(axis=1)
        shares[part] = met[at, table]
        first[part] = shares[part] & (least == key[a[part]])
    return shares, first


def _compare(rows: pa.Table, least: float, plan: Plan, bits: int, item: str) -> Iterator[pa.RecordBatch]:
    """c, links and root of the rows of whole groups that link with others of their group."""
    group_columns = [rows.column(x).to_numpy() for x in ("key", "i", "j", "bytes")]
    new = np.ones(len(rows), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in group_columns], axis=0)
    group = np.cumsum(new)
    c, times, side, label = (rows.column(x).to_numpy() for x in ("c", "times", "side", "label"))
    across = group_columns[1] != group_columns[2]
    for size in np.unique(group_columns[3]):
        own = np.flatnonzero(group_columns[3] == size)
        chosen = rows.column("v").take(pa.array(own))
        unit = _units(np.frombuffer(b"".join(chosen.to_pylist()), item).reshape(len(own), -1))
        a, b = _pairs(group[own], side[own], across[own], unit, least)
        if not len(a):
            continue
        met, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        keys = cells(unit[met], label[own][met], plan, bits)
        a, b = place[: len(a)], place[len(a) :]
        own = own[met]
        shares, once = _meetings(a, b, group_columns[0][own], keys)
        links = np.bincount(a[once], weights=times[own][b[once]], minlength=len(own)) + np.bincount(b[once], weights=times[own][a[once]], minlength=len(own))
        a, b, root = a[shares], b[shares], c[own].copy()
        while True:
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            if (root == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(links.astype(np.int64)), pa.array(root)], ["c", "links", "root"])


def linked(indexed: DataFrame, plan: Plan, bits: int, item: str, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """c, links and root: how many vectors a class links with in a part of the comparison, and a class that it connects to.

    Only keys and numbers of classes are dealt to find the cells that hold several; the
    vectors follow where they meet.
    """
    filed = indexed.select("c", F.explode("keys").alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    met = filed.join(sizes, "key").select("c", "key", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("c", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    full = met.join(indexed.select("c", "label", "times", "v", F.octet_length("v").alias("bytes")), "c")
    dealt = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "bytes")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            columns = [now.column(x).to_numpy() for x in ("key", "i", "j")]
            last = np.all([x == x[-1] for x in columns], axis=0)
            end = int(np.argmax(last))  # the last group may go on; sorted, it is the tail
            held = now.slice(end)
            if end:
                yield from _compare(now.slice(0, end), least, plan, bits, item)
        if held is not None and len(held):
            yield from _compare(held, least, plan, bits, item)

    names = ["key", "i", "j", "bytes", "side", "c", "label", "times", "v"]
    return dealt.select(*names).mapInArrow(apply, "c bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, least: float = 0.93, plan: Plan | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label, ...).

    Rows of one label that is not null link if their vectors' cosine, in doubles, is at
    least `least`; pairs are found by lattice hashing, so that a link may be missed (see
    PLANS; the plan is chosen by the largest label's number of different vectors) but none
    is wrong. n_links counts the other rows linked directly, component_id is the smallest
    vec_id reachable, kept whether it is the row's own.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor
    do rows without a label or of other dimensions. Equal vectors of a label are one class
    in all joins; a large cell is compared in blocks. Repeated rows are rows of their own.
    A null vec_id is the smallest only of rows that have no other, and such a row isn't
    kept if it belongs to a component with an id. Other columns are left out; an empty
    table gives an empty result.
    """
    rows = usable(vectors)
    classes = rows.groupBy("label", "h").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("x").alias("x"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"), F.sum("times").alias("rows"))
    size = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.sum("rows").alias("rows")).first()
    plan = plan or plan_for(size["most"] or 0)
    bits = min(63, ((size["all"] or 1) * 2 * plan.tables).bit_length() + SPARE_BITS)
    item = "<f4" if isinstance(classes.schema["x"].dataType.elementType, FloatType) else "<f8"
    indexed = cut(_indexed(classes, plan, bits))
    found = cut(linked(indexed, plan, bits, item, least, block))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("c").alias("a"), F.col("root").alias("b")).distinct())
    named = indexed.join(components, indexed.c == components.node, "left").join(links, "c", "left")
    named = named.select("label", "h", "least", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "c").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "root").select("label", "h", "times", (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id")
    others = vectors.where(~_can_link()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    linking = _joined(rows.select("vec_id", "label", "h"), of, HOT * (size["rows"] or 0))
    return linking.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _joined(rows: DataFrame, of: DataFrame, hot: float) -> DataFrame:
    """vec_id, n_links and component_id: rows of classes with more than `hot` rows by broadcast, the others by shuffle.

    At most rows / hot classes are broadcast.
    """
    facts = ["n_links", "component_id"]
    most = of.where(F.col("times") > hot).select("label", "h", *[F.col(x).alias(f"hot_{x}") for x in facts])
    met = rows.join(F.broadcast(most), ["label", "h"], "left")
    # a row that is done meets no class, wherever it is dealt to
    key = F.when(F.col("hot_n_links").isNull(), F.col("h")).otherwise(F.concat(F.lit("-"), F.col("vec_id")).cast("binary"))
    rest = met.withColumn("h", key).join(of.select("label", "h", *facts), ["label", "h"], "left")
    return rest.select("vec_id", *[F.coalesce(f"hot_{x}", x).alias(x) for x in facts])
