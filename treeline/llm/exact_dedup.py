"""Exact duplicates by recipes of content-defined chunks.

A rolling hash over the last 32 bytes cuts each normalised text into chunks of about
`chunk_bytes`, so equal passages give equal chunks wherever they stand. A chunk gets a
64-bit identifier. The chunk table is reduced by identifier, and an identifier is verified
when all its chunks have one SHA-256; the chunks of any other identifier are told apart by
their SHA-256. Documents are equal when their ordered lists of identifiers are. Texts
never leave the task that reads them; what is shuffled is about 40 bytes a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.store import lookup, parts, stored
from treeline.llm.words import buffer, mix, slices, spans_hash

CHUNK_BYTES = 2048
#: A chunk has at most so many times chunk_bytes; only texts without variety get there.
LONGEST = 16


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last 32 bytes at each byte, by doubling the width five times."""
    table = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    h = table[data]
    for k in range(5):
        step = 1 << k
        h[step:] += h[:-step].copy() << np.uint32(step)
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, chunk_bytes: int) -> list[list[int]]:
    """For each document the ends of its chunks, relative to all data."""
    if not len(data):
        return [[] for _ in offsets[1:]]
    mask = np.uint32((1 << max(1, chunk_bytes.bit_length() - 1)) - 1) << np.uint32(8)
    cuts = np.flatnonzero((rolling(data) & mask) == 0) + 1
    left = np.searchsorted(cuts, offsets[:-1] + 32, "left")
    right = np.searchsorted(cuts, offsets[1:], "left")
    longest, out = chunk_bytes * LONGEST, []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), left.tolist(), right.tolist()):
        ends, last = [], a
        for c in [*cuts[i:j].tolist(), b] if b > a else []:
            while c - last > longest:
                last += longest
                ends.append(last)
            if c > last:
                ends.append(c)
                last = c
        out.append(ends)
    return out


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of white space becomes one space."""
    whole, out = data.tobytes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = whole[a:b]
        short = b" ".join(text.split())
        if text[:1].isspace():
            short = b" " + short
        if text[-1:].isspace() and short != b" ":
            short += b" "
        out.append(short)
    return (np.frombuffer(b"".join(out), dtype=np.uint8),
            np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64))


def _recipes(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                data, offsets = normalised(*buffer(part.column("text")))
                ends = chunk_ends(data, offsets, chunk_bytes)
                flat_ends = np.array([e for x in ends for e in x], dtype=np.int64)
                sizes = np.array([len(x) for x in ends])
                first = np.concatenate(([0], np.cumsum(sizes)))
                flat_starts = np.concatenate(([0], flat_ends[:-1]))[: len(flat_ends)]
                flat_starts[first[:-1][sizes > 0]] = offsets[:-1][sizes > 0]
                chunk = spans_hash(data, flat_starts, flat_ends).view(np.int64)
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(flat_starts, flat_ends)]
                shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
                at = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(shas),
                    pa.ListArray.from_arrays(at, pa.array(chunk)),
                    pa.ListArray.from_arrays(at, pa.array(digests, pa.binary())),
                ], ["doc_id", "text_sha256", "chunks", "digests"])
    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text_sha256, and the ordered chunk hashes and chunk digests of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _recipes(chunk_bytes),
        "doc_id bigint, text_sha256 string, chunks array<bigint>, digests array<binary>")


def chunk_table(of: DataFrame) -> DataFrame:
    """chunk, n_uses, and whether all uses have one digest; one row per chunk hash."""
    each = of.select(F.explode(F.arrays_zip("chunks", "digests")).alias("c"))
    return each.groupBy(F.col("c.chunks").alias("chunk")).agg(
        F.count("*").alias("n_uses"),
        (F.min("c.digests") == F.max("c.digests")).alias("verified"))


def identified(of: DataFrame, table: DataFrame) -> DataFrame:
    """Adds `ids`: the list of verified identifiers."""
    doubtful = table.where(~F.col("verified")).select("chunk")
    uses = of.select("text_sha256", F.explode("chunks").alias("chunk")).distinct()
    mended = uses.join(doubtful, "chunk").groupBy("text_sha256").agg(F.collect_set("chunk").alias("_doubtful"))
    told_apart = F.transform(
        F.arrays_zip("chunks", "digests"),
        lambda c: F.when(F.array_contains("_doubtful", c["chunks"]), F.xxhash64(c["digests"]))
        .otherwise(c["chunks"]))
    return of.join(mended, "text_sha256", "left").withColumn(
        "ids", F.when(F.col("_doubtful").isNull(), F.col("chunks")).otherwise(told_apart)
    ).drop("_doubtful")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; a run
    at either end stays one space. A null text is an empty one, and all empty texts are
    one group. keep_id is the smallest id of the group; of repeated rows with that id all
    are kept. A row without an id goes if its group has an id, and stays if it has none. A text of any length is one list of identifiers. An empty table gives an
    empty result; other columns are not read.
    """
    of = stored(recipes(docs, id_col, text_col, chunk_bytes), "recipes")
    lists = identified(of, chunk_table(of)).select(
        "doc_id", "text_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
        .alias("list_key"), "ids")
    groups = lists.groupBy("list_key", "ids").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    several = groups.where("group_size > 1").select("list_key", "keep_id", "group_size")
    found = lookup(lists.drop("ids"), several, ["list_key"], "group_size", of.count(), parts(docs))
    keep = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep.isNull() | F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256")
