"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words and of the character n-grams inside
them, all hashed into one table; a softmax over two outputs follows. Training is
stochastic gradient descent in numpy on a bounded sample of labelled rows. Scoring needs
only one number per table entry (the difference of the two outputs is linear in the
average), so a task holds a vector of n_buckets floats and reads each byte a few times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.words import buffer, release, slices, spans_hash, words

N_BUCKETS = 1 << 17
DIM = 12
NGRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
#: Bounds of the training sample: rows, and bytes of text in all.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32 << 20


def features(data: np.ndarray, offsets: np.ndarray, n_buckets: int,
             ngrams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(table entry, document) of every word and every n-gram inside a word.

    A word that repeats the word before it gives one entry more, the last of the table.
    """
    starts, ends, counts = words(data, offsets)
    hashes = spans_hash(data, starts, ends, 1)
    entries = [hashes % np.uint64(n_buckets - 1)]
    docs = [np.repeat(np.arange(len(offsets) - 1), np.diff(counts))]
    if len(starts):
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (docs[0][1:] == docs[0][:-1])) + 1
        entries.append(np.full(len(again), n_buckets - 1, dtype=np.uint64))
        docs.append(docs[0][again])
        solid = np.zeros(len(data) + 1, dtype=np.int8)
        solid[starts] += 1
        solid[ends] -= 1
        in_word = np.cumsum(solid[:-1]).astype(bool)
        letters = np.flatnonzero(((data & 0xC0) != 0x80) & in_word)
        word = np.searchsorted(starts, letters, "right") - 1
        for n in ngrams:
            if len(letters) >= n:
                first, last = letters[: len(letters) - n + 1], letters[n - 1:]
                past = np.append(letters[n:], ends[-1])[: len(first)]
                past = np.minimum(past, ends[word[n - 1:]])
                whole = word[: len(first)] == word[n - 1:]
                first, past, last = first[whole], past[whole], last[whole]
                entries.append(spans_hash(data, first, past, 10 + n) % np.uint64(n_buckets - 1))
                docs.append(docs[0][word[: len(whole)][whole]])
    return np.concatenate(entries).astype(np.int64), np.concatenate(docs)


@dataclass
class Model:
    #: Difference of the outputs, per table entry, and what is added to their average.
    weights: np.ndarray
    bias: float
    ngrams: tuple[int, ...]


def fit(texts: list[str], labels: list[int], n_buckets: int = N_BUCKETS, dim: int = DIM,
        ngrams: tuple[int, ...] = NGRAMS, epochs: int = EPOCHS, rate: float = RATE,
        seed: int = 11) -> Model:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero.

    Both labels weigh the same in all. Without rows of both labels there is nothing to
    learn: every score is then 0.5, or 1 or 0 if only one label occurs.
    """
    y = np.array(labels, dtype=np.int64)
    if len(np.unique(y)) < 2:
        bias = 0.0 if not len(y) else (40.0 if y[0] == 1 else -40.0)
        return Model(np.zeros(n_buckets, np.float32), bias, ngrams)
    bags = []
    for t in texts:
        data, offsets = buffer(pa.array([t], pa.string()))
        entry, n = np.unique(features(data, offsets, n_buckets, ngrams)[0], return_counts=True)
        bags.append((entry.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, (n_buckets, dim)).astype(np.float32)
    outputs, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in draw.permutation(len(y)):
            entry, share = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[entry]
            z = outputs @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(min(4.0, weight[y[i]]))
            back = p @ outputs
            outputs -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            vectors[entry] -= now * np.minimum(1.0, 20.0 * share)[:, None] * back
    return Model(vectors @ (outputs[1] - outputs[0]), float(bias[1] - bias[0]), ngrams)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 2 << 20):
                data, offsets = buffer(part.column("text"))
                entry, doc = features(data, offsets, len(model.weights), model.ngrams)
                n = np.maximum(np.bincount(doc, minlength=part.num_rows), 1)
                z = np.bincount(doc, weights=model.weights[entry], minlength=part.num_rows) / n
                p = 1 / (1 + np.exp(-np.clip(z + model.bias, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"])
    return run


def fitting(rows: list[tuple[int, int]], most_bytes: int) -> list[int]:
    """Places of the rows (label, size) to take, in order: a row that does not fit is skipped alone.

    Each label has half of the bytes first; what is left over goes to any row that still fits.
    """
    taken: dict[int, int] = {}
    left = {0: most_bytes // 2, 1: most_bytes // 2}
    for place, (label, size) in enumerate(rows):
        if size <= left[label]:
            left[label] -= size
            taken[place] = size
    rest = most_bytes - sum(taken.values())
    for place, (_, size) in enumerate(rows):
        if place not in taken and size <= rest:
            rest -= size
            taken[place] = size
    return sorted(taken)


def sample(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id",
           text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS,
           most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most `rows` labelled rows, half of each label if there are.

    Rows come in the order of a hash of their id; only those that do not fit the rest of
    `most_bytes` are left out, see `fitting`. Rows whose label is null, or that `learnable` (over labels) rejects, never count.
    """
    known = labels.where(learnable & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"),
        F.xxhash64(F.col(id_col)).alias("_order"))
    picked = [r for label in (0, 1) for r in
              known.where(F.col("_label") == label).orderBy("_order", "_id").limit(rows // 2).collect()]
    chosen = docs.sparkSession.createDataFrame(
        list({r["_id"]: (r["_id"], r["_label"], r["_order"]) for r in picked}.values()),
        "_id bigint, _label int, _order bigint")
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = found.join(F.broadcast(chosen), "_id").withColumn("_size", F.octet_length("_text"))
    found = found.dropDuplicates(["_id"])
    sizes = sorted(found.select("_order", "_id", "_size", "_label").collect())
    last = [sizes[i]["_id"] for i in fitting([(r["_label"], r["_size"]) for r in sizes], most_bytes)]
    taken = sorted(found.where(F.col("_id").isin(last)).select("_order", "_id", "_text", "_label").collect()
                   if len(last) < len(sizes) else
                   found.select("_order", "_id", "_text", "_label").collect())
    return [r["_text"] for r in taken], [r["_label"] for r in taken]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on).

    Whole texts of any length are read; only the text enters the score. A null or empty
    text scores by the bias alone. Repeated rows get equal scores; an empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scored(model), f"doc_id {kind}, score double, predicted int")


def _good(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_col, 2 << 20):
                one = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(part.num_rows)), part.column(text_col)], ["doc_id", "text"])
                good = [p >= 0.5 for out in _scored(model)([one]) for p in out.column("score").to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))
        release()
    return run


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores 0.5 or more."""
    return docs.mapInArrow(_good(model, text_col), docs.schema)
