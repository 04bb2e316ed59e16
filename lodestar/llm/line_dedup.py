"""Line deduplication: line hashes dealt by range with a secondary sort by document and position.

First occurrences are streamed and come back as compressed bitmaps of the lines to keep.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import NULL_ID, cut, small_batches

#: Code points that a key must have, and documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
BLANK = " \t\n\v\f\r"


def keys_of(text: str | None, least: int = LEAST_CHARS) -> tuple[list[bytes], list[int]]:
    """128-bit hash and position of each line whose key has at least `least` code points."""
    hashes, places = [], []
    for i, line in enumerate((text or "").split("\n")):
        key = line.strip(BLANK)
        if len(key) >= least:
            hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "replace").lower()))
            places.append(i)
    return hashes, places


def _hashed(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves of the hash, text and position of each line that counts."""
    owner, hashes, places = [], [], []
    for i, text in enumerate(texts):
        h, p = keys_of(text, least)
        owner += [i] * len(h)
        hashes += h
        places += p
    halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
    return halves, np.array(owner, np.int64), np.array(places, np.int32)


def occurrences(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """h, g (the halves of a line's hash), doc_id, pos, text_key and n_lines (of the text) of every line that counts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            halves, owner, places = _hashed(texts, least)
            lines = np.fromiter(((x or "").count("\n") + 1 for x in texts), np.int32, len(texts))
            at = pa.array(owner)
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at), pa.array(places), batch.column(1).take(at), pa.array(lines[owner])]
            yield pa.RecordBatch.from_arrays(columns, ["h", "g", "doc_id", "pos", "text_key", "n_lines"])

    schema = "h bigint, g bigint, doc_id bigint, pos int, text_key bigint, n_lines int"
    return small_batches(docs).select("doc_id", "text_key", "text").mapInArrow(apply, schema)


def _ranks(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sorted occurrences the number of its key, from 0, and of its document within the key, from 1."""
    h, g, doc = (pdf[c].to_numpy(np.int64) for c in ("h", "g", "doc_id"))
    new_key = np.ones(len(pdf), bool)
    new_key[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]  # in 64 bits: doubles take neighbouring ids for one
    key, docs = np.cumsum(new_key) - 1, np.cumsum(new_doc)
    return key, docs - docs[new_key][key] + 1


def _ends(batches: Iterator[pd.DataFrame], least_docs: int) -> Iterator[pd.DataFrame]:
    """h, g and doc_id of the largest least_docs documents of a sorted partition's first and last key."""
    first = last = None
    for pdf in batches:
        if not len(pdf):
            continue
        now = pdf[["h", "g", "doc_id"]] if last is None else pd.concat((last, pdf[["h", "g", "doc_id"]]), ignore_index=True)
        key, rank = _ranks(now)
        few = rank <= least_docs
        few[1:] &= (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])  # one row of each document
        last = now[few & (key == key[-1])]
        head = now[few & (key == 0)]
        if first is None:
            first, done = head, key[-1] > 0
        elif not done:  # the first key goes on
            first, done = head, key[-1] > 0
    if last is not None:
        yield pd.concat((first, last), ignore_index=True)


def _packed(rows: pd.DataFrame) -> pa.Buffer:
    """Rows as compressed bytes: those of one document differ in their positions only."""
    batch, out = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def _unpacked(rows: pa.Buffer) -> pd.DataFrame:
    return pa.ipc.open_stream(rows).read_pandas()


def lost(dealt: DataFrame, ends: dict[tuple[int, int], int | None], least_docs: int) -> DataFrame:
    """doc_id, text_key, pos and n_lines of the lines that go, from partitions sorted by key, falling document and position.

    A task streams its partition: a key's first document keeps its lines, the following
    ones lose theirs once least_docs documents are met. What a task holds until then are, compressed, a key's
    lines of fewer documents than that without the first; each is looked at once. ends has the keys
    at partitions' ends, which may lie in several: their keeper, or None if they aren't repeated.
    """
    columns = ["doc_id", "text_key", "pos", "n_lines"]
    shared = dealt.sparkSession.sparkContext.broadcast(ends)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, docs, last, held = None, 0, None, []  # the key that goes on, its documents so far, the latest, and lines that may go
        for pdf in batches:
            if not len(pdf):
                continue
            key, rank = _ranks(pdf)
            doc = pdf["doc_id"].to_numpy(np.int64)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            names = [tuple(int(x) for x in pdf.iloc[i][["h", "g"]]) for i in (0, start[-1])]
            if names[0] == name:
                rank[key == 0] += docs - int(doc[0] == last)
            else:
                held.clear()
            met = np.maximum.reduceat(rank, start)
            gone = (met[key] >= least_docs) & (rank > 1)
            for k, own in ((0, names[0]), (key[-1], names[1])):
                if own in shared.value:
                    keeper = shared.value[own]
                    gone[key == k] = False if keeper is None else doc[key == k] != keeper
            if met[0] >= least_docs:
                yield from map(_unpacked, held)
                held.clear()
            if len(start) > 1:
                held.clear()
            name, docs, last = names[1], int(met[-1]), doc[-1]
            if name not in shared.value and docs < least_docs:
                held.append(_packed(pdf.loc[(key == key[-1]) & (rank > 1), columns]))
            yield pdf.loc[gone, columns]

    return dealt.mapInPandas(stream, "doc_id bigint, text_key bigint, pos int, n_lines int")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_key and bitmap of the documents that lose lines: bit i stands for line i, set if it stays.

    Bitmaps are compressed bytes, the lowest bit first. docs must hold doc_id (no nulls),
    text_key and text. Lines are dealt by ranges of hash, falling document and position,
    so that a line that a third of all documents hold is spread over several tasks; of
    each partition's first and last key the driver learns the largest least_docs documents,
    a few rows for each partition.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", "g", F.col("doc_id").desc(), "pos"]
    dealt = cut(occurrences(docs, least_chars).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    found = dealt.mapInPandas(lambda batches: _ends(batches, least_docs), "h bigint, g bigint, doc_id bigint").distinct().collect()
    holders: dict[tuple[int, int], set[int]] = {}
    for r in found:
        holders.setdefault((r.h, r.g), set()).add(r.doc_id)
    ends = {key: max(ids) if len(ids) >= least_docs else None for key, ids in holders.items()}
    places = lost(dealt, ends, least_docs).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("places"), F.max("n_lines").alias("n_lines"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for at, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc_id", "text_key", "bitmap"])

    return places.mapInArrow(pack, "doc_id bigint, text_key bigint, bitmap binary")


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text's lines that stay, the number of lines before, and of those dropped; without a bitmap all stay."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    stay = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little", count=len(lines))
    return "\n".join(x for x, stays in zip(lines, stay.tolist(), strict=True) if stays), len(lines), int(len(lines) - stay.sum())


def _with_bitmaps(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """docs with __id (no nulls), __key and __bitmap."""
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(NULL_ID)), "__key": F.xxhash64("text")})
    maps = keep_bitmaps(keyed.select(F.col("__id").alias("doc_id"), F.col("__key").alias("text_key"), "text"), least_chars, least_docs)
    maps = maps.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("bitmap").alias("__bitmap"))
    return keyed.join(maps, ["__id", "__key"], "left")


def line_report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of docs (doc_id, text, ...).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys
    of at least least_chars code points in at least least_docs documents lose their lines
    in all documents but the one of the largest doc_id. A null text is one empty line; a
    null doc_id is one document below all others; repeated rows of one doc_id are one
    document and come back as often as they are there. Other columns are left out; an empty
    table gives an empty result.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_text(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            shas = [hashlib.sha256(x[0].encode("utf-8", "replace")).hexdigest() for x in kept]
            counts = [pa.array([x[i] for x in kept], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_bitmaps(docs.select("doc_id", "text"), least_chars, least_docs).select("doc_id", "text", "__bitmap")
    return rows.mapInArrow(report, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with their repeated lines dropped from text, and n_chars (if there) counted anew; null texts stay null."""
    rows = _with_bitmaps(docs, least_chars, least_docs).select(*docs.columns, "__bitmap")
    place = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(place).to_pylist(), batch.column(len(docs_columns)).to_pylist(), strict=True)
            texts = pa.array([x if b is None else kept_text(x, b)[0] for x, b in pairs], pa.string())
            columns = [texts if i == place else batch.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = list(docs.columns)
    out = rows.mapInArrow(apply, docs.schema)
    if "n_chars" in docs_columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out
