"""Removal of passages that repeat across documents, by Rabin-Karp window hashes.

Every window of `width` consecutive words is hashed (64 bits over word hashes). The ids
are cut into ascending ranges, called batches. A task sends each hash of a batch once to the
bucket of the hash, so a passage that a third of all documents share counts once per batch.
A bucket tells each batch which of its hashes an earlier batch has too. A batch then
meets its texts again: a window goes if an earlier batch has it, or a document with a
smaller id in the same batch. Covering windows merge into maximal intervals.

Hashes travel as packed 8-byte numbers: one row per batch and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.store import pieces
from treeline.llm.words import bucket_of, buffer, inside, release, slices, spans_hash, window_hashes, words

WIDTH = 50
#: Bytes of text of a batch, about.
BATCH_BYTES = 16 << 20
#: Bytes of text whose words and windows are worked out at a time, about.
BLOCK_BYTES = 1 << 20

#: Hashes looked up at a time.
_AT_ONCE = 1 << 18
#: Prefix of columns that are only carried along, so their names clash with nothing.
_OWN = "own "
_SPANS = "array<struct<first: bigint, past: bigint>>"


def with_batch(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """Adds `batch`: ascending ranges of the id with about `batch_bytes` of text each.

    Rows without an id are in the last batch.
    """
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("b"),
                     F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    n = pieces(total["b"] or 0, batch_bytes)
    if n == 1 or total["low"] == total["high"]:
        return docs.withColumn("batch", F.lit(0)), 1
    steps = [i / n for i in range(1, n)]
    cuts = docs.select(F.percentile_approx(id_col, steps, max(10_000, 20 * n)).alias("c")).first()["c"]
    inner = sorted({float(c) for c in cuts})
    splits = [-float("inf"), *inner, float("inf")]
    numbered = Bucketizer(splits=splits, inputCol="_id", outputCol="_batch", handleInvalid="keep").transform(
        docs.withColumn("_id", F.col(id_col).cast("double")))
    batch = F.coalesce(F.col("_batch"), F.lit(len(inner))).cast("int")
    return numbered.withColumn("batch", batch).drop("_id", "_batch"), len(inner) + 1


def _windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each window inside one document."""
    data, offsets = buffer(texts)
    starts, ends, counts = words(data, offsets)
    every = window_hashes(spans_hash(data, starts, ends), width)
    at, doc = inside(counts, width)
    return every[at], doc


def _all_windows(rows: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of many texts, block by block: only the hashes and documents are held of all."""
    hashes, docs, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    for part in slices(rows, "text", BLOCK_BYTES):
        found, doc = _windows(part.column("text"), width)
        hashes.append(found)
        docs.append((doc + n).astype(np.int32))
        n += part.num_rows
    return np.concatenate(hashes), np.concatenate(docs)


def _requests(width: int, n_buckets: int):
    def asked(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, doc = _all_windows(part, width)
        batch = np.asarray(part.column("batch"))[doc]
        for b in np.unique(batch):
            own = np.unique(hashes[batch == b])
            buckets = bucket_of(own, n_buckets)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(own)]
            firsts = buckets[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([
                pa.array(firsts, pa.int32()),
                pa.array(np.full(len(firsts), b), pa.int32()),
                pa.array([own[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
            ], ["bucket", "batch", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                yield from asked(part)
        release()
    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each batch the hashes of a bucket that an earlier batch has too."""
    batch = np.asarray(table.column("batch"))
    order = np.argsort(batch, kind="stable")
    blobs = table.column("hashes").to_pylist()
    own = [np.frombuffer(blobs[i], dtype=np.uint64) for i in order]
    of = np.repeat(batch[order], [len(x) for x in own])
    hashes = np.concatenate(own)
    del blobs, own
    by_hash = np.argsort(hashes, kind="stable")
    hashes, of = hashes[by_hash], of[by_hash]
    head = np.ones(len(hashes), dtype=bool)
    head[1:] = hashes[1:] != hashes[:-1]
    least = of[head][np.cumsum(head) - 1]
    late = of > least
    hashes, of = hashes[late], of[late]
    by_batch = np.argsort(of, kind="stable")
    hashes, of = hashes[by_batch], of[by_batch]
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
    return pa.table({
        "batch": pa.array(of[cuts[:-1]], pa.int32()),
        "hashes": pa.array([hashes[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
    })


def _answer_of(table: pa.Table) -> pa.Table:
    try:
        return _answer(table)
    finally:
        release()


def _late(rows: pa.RecordBatch, rank: np.ndarray, seen: np.ndarray, width: int) -> np.ndarray:
    """A flag for every window that goes. Texts ascend by rank; equal ids have equal ranks."""
    hashes, doc = _all_windows(rows, width)
    late = np.zeros(len(hashes), dtype=bool)
    if not len(hashes):
        return late
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    if len(seen):
        for i in range(0, len(hashes), _AT_ONCE):
            some = hashes[i: i + _AT_ONCE]
            place = np.minimum(np.searchsorted(seen, some), len(seen) - 1)
            late[order[i: i + _AT_ONCE][seen[place] == some]] = True
    heads = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    lengths = np.diff(np.append(heads, len(hashes)))
    # Most windows occur once; the first of the others is that of the least rank.
    heads, lengths = heads[lengths > 1], lengths[lengths > 1]
    first = np.repeat(rank[doc[order[heads]]], lengths)
    within = np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    again = order[np.repeat(heads, lengths) + within]
    late[again[rank[doc[again]] > first]] = True
    return late


def _removed(texts: pa.Array, late: np.ndarray, width: int):
    """(words, covered, windows): a flag for every word of these texts, from the flags of their first windows."""
    data, offsets = buffer(texts)
    starts, ends, counts = words(data, offsets)
    at, _ = inside(counts, width)
    gone = at[late[: len(at)]]
    steps = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(steps, gone, 1)
    np.add.at(steps, gone + width, -1)
    return (data, starts, ends, counts), np.cumsum(steps[:-1]) > 0, len(at)


def _apply(width: int, keep: list[str]):
    def applied(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("doc_id").combine_chunks()
        seen = np.unique(np.concatenate(
            [np.frombuffer(x, dtype=np.uint64) for x in right.column("hashes").to_pylist()]
            or [np.zeros(0, np.uint64)]))
        n_words, n_removed, spans, kept = [], [], [], []
        ids = left.column("doc_id").to_pylist()
        rank = np.cumsum([0, *(a != b for a, b in zip(ids, ids[1:]))][: len(ids)]).astype(np.int32)
        texts = pa.RecordBatch.from_arrays([pa.concat_arrays(left.column("text").chunks or [pa.array([], pa.string())])], ["text"])
        late, done = _late(texts, rank, seen, width), 0
        del seen
        for part in slices(texts, "text", BLOCK_BYTES):
            (data, starts, ends, counts), covered, n = _removed(part.column("text"), late[done:], width)
            done += n
            for i in range(part.num_rows):
                a, b = int(counts[i]), int(counts[i + 1])
                flags = covered[a:b]
                n_words.append(b - a)
                n_removed.append(int(flags.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                spans.append([{"first": int(x), "past": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                bounds = [0, *edges.tolist(), b - a]
                text = data[starts[a]: ends[b - 1]].tobytes() if b > a else b""
                base = int(starts[a]) if b > a else 0
                runs = [text[int(starts[a + x]) - base: int(ends[a + y - 1]) - base]
                        for x, y in zip(bounds[::2], bounds[1::2]) if y > x]
                kept.append(b" ".join(b" ".join(r.split()) for r in runs))
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            **{c: left.column("text" if c == "text" else _OWN + c) for c in keep}})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return applied(left, right)
        finally:
            release()
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH, batch_bytes: int = BATCH_BYTES,
                   keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans, kept_text.

    With `keep`, also `text` as it came and the columns named.

    A word goes if a window of `width` words covers it whose words, unchanged, also start
    in a document with a smaller id. spans are the removed word positions [first, past),
    kept_text the other words joined by one space. A document that repeats a passage only
    within itself keeps it. Null and empty texts have no words; texts shorter than
    `width` words lose nothing; an empty table gives an empty result. Ids are distinct
    numbers; of rows that share an id none precedes the other, and a row without an id comes
    behind all others of its batch.
    Other columns of the input are not read.
    """
    own = [] if keep is None else ["text", *keep]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *(F.col(text_col if c == "text" else c).alias(_OWN + c) for c in own if c != "text"))
    rows, n = with_batch(rows, "doc_id", "text", batch_bytes)
    asked = rows.select("batch", "text").mapInArrow(
        _requests(width, n), "bucket int, batch int, hashes binary")
    told = asked.groupBy("bucket").applyInArrow(_answer_of, "batch int, hashes binary")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    more = "".join(f", `{c}` {kinds[text_col if c == 'text' else c]}" for c in own)
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        _apply(width, own),
        f"doc_id bigint, n_words bigint, n_removed bigint, spans {_SPANS}, kept_text string{more}")
