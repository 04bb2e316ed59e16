"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most two bits have a half (of two) in which they differ in
at most one. That half then agrees in one of its 32 variants with one bit left out, so an
equality join over all variants finds every such pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import NULL_ID, connected_components, cut, small_batches

SEED = 42
SHINGLE = 3
BITS = 2
#: A signature of more fingerprints is left to the exact way for large groups.
MOST_IN_SIGNATURE = 256


def fingerprint(text: str) -> int:
    """The 64 majority bits over all shingles of the text, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros(64, np.int64)
    bits = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(bits), 65536):
        ones += np.unpackbits(bits[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp, the fingerprint as a signed 64-bit number, of every row.

    Null and blank texts have fingerprint 0.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or "") for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(apply, f"doc_id {kind}, text_key bigint, fp bigint")


def _signatures(fps: DataFrame) -> DataFrame:
    """fp with each of its 64 signatures: half and left-out bit (sig), and what is left of the half."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63)))
    out = fps.select("fp", bit.alias("sig"))
    half = F.expr("if(sig < 32, 4294967295L, -4294967296L)")
    return out.withColumn("rest", F.col("fp").bitwiseAND(half).bitwiseAND(F.expr("~shiftleft(1L, sig)")))


def _close(sorted_pairs: DataFrame) -> DataFrame:
    """Links (a, b) among the fingerprints of each signature; sorted_pairs holds sig, rest, fp in this order.

    Each fingerprint is compared with those that follow it in its signature, a whole batch
    at a time; links that earlier links of the same signature imply aren't returned.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            # the last signature may go on in the next batch
            end = len(now[0]) - int(((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[::-1].argmin() or len(now[0]))
            held = [x[end:] for x in now]
            yield _links([x[:end] for x in now])
        if held is not None:
            yield _links(held)

    return sorted_pairs.mapInArrow(apply, "a bigint, b bigint")


def _links(part: list[np.ndarray]) -> pa.RecordBatch:
    sig, rest, fp = part
    found: list[np.ndarray] = []
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (rest[1:] != rest[:-1])
    group = np.cumsum(new)
    first = np.arange(len(sig))  # the earliest of its signature that a row is known to link with
    at, far = np.arange(len(sig)), 1
    while len(at):
        at = at[at + far < len(sig)]
        at = at[group[at] == group[at + far]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + far]).view(np.uint64)) <= BITS]
        fresh = near[first[near + far] > first[near]]
        first[fresh + far] = first[fresh]
        also = near[first[near + far] != first[near]]
        for i in (fresh, also):
            found.append(np.stack((fp[i], fp[i + far])))
        far += 1
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _masks() -> list[int]:
    """Masks that leave out two of 64 bits, as signed numbers."""
    masks = [2**64 - 1 - (1 << i) - (1 << j) for i in range(64) for j in range(i)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _large(fps: DataFrame) -> DataFrame:
    """Links among fingerprints that share large signatures: equal after leaving out the same two bits.

    All that agree in this way link with each other, and at most four fingerprints can, so
    the groups are small however large the group of copies is.
    """
    mask = F.explode(F.array(*[F.lit(m) for m in _masks()]))
    variants = fps.select("fp", mask.alias("mask")).withColumn("rest", F.col("fp").bitwiseAND(F.col("mask")))
    groups = variants.groupBy("mask", "rest").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    least = F.array_min("all")
    return groups.select(least.alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, most_in_signature: int = MOST_IN_SIGNATURE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) at BITS or fewer differing bits."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes become many rows here, so the partitions must not be merged by their size
    signatures = _signatures(fps.repartition(parts, F.xxhash64("fp")))
    sizes = signatures.groupBy("sig", "rest").agg(F.count("*").alias("n")).where("n > 1")
    # both sides are shuffled: Spark takes the signatures for as small as the fingerprints they are made of, and would broadcast them
    shared = cut(signatures.hint("merge").join(sizes, ["sig", "rest"]).select("sig", "rest", "fp", "n"))
    few = shared.where(F.col("n") <= most_in_signature).select("sig", "rest", "fp")
    small = _close(few.repartition("sig", "rest").sortWithinPartitions("sig", "rest", "fp"))
    large = _large(shared.where(F.col("n") > most_in_signature).select("fp").distinct())
    return small.unionByName(large).distinct()


def components(docs: DataFrame, most_in_signature: int = MOST_IN_SIGNATURE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links of fingerprints that differ in
    at most two bits. Texts that are null or blank have fingerprint 0 and link like any
    other. Repeated rows come back as often as they are there; a null doc_id takes part but
    is the smallest only of a component that has no other. Other columns are left out; an
    empty table gives an empty result. Exact copies are one fingerprint in all joins.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _rooted(docs, most_in_signature).select("doc_id", hexed, "component_id")


def _rooted(docs: DataFrame, most_in_signature: int) -> DataFrame:
    """doc_id, text_key, fp, root (the component's smallest fingerprint) and component_id of every row."""
    every = cut(fingerprints(docs))
    distinct = every.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(distinct.select("fp"), most_in_signature))
    named = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return every.join(named.select("fp", "root").join(smallest, "root"), "fp")


def keep_one(docs: DataFrame, most_in_signature: int = MOST_IN_SIGNATURE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row, of its smallest doc_id."""
    found = _rooted(docs, most_in_signature).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("__key"))
    kept = kept.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), "__key").distinct()
    rows = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(NULL_ID)), "__key": F.xxhash64("text")})
    # equal rows are one document: of each id and text the first stays
    nth = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(0)))
    return rows.join(kept, ["__id", "__key"]).withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
