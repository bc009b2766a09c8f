"""Hard negatives of stated anchors, mined by a secondary sort over scored pairs.

Anchors meet all rows in blocks: a task holds one block of rows and one of anchors, and the
blocks are bounded by numbers of rows. Scores are exact integer inner products. A pair leaves its
block only if it can count: of the rows with the anchor's label the best few of the block
(the best few of all are among them), and of the others the best few of the block inside each
window that the anchor's positives open. What leaves is a key (anchor, descending score,
positives first, id); a shuffle by anchor sorts these keys within each partition, and an
iterator reads them in that order: a positive opens its window, a negative is given to each
open window that it lies in. It holds the open windows of one anchor and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.store import parts, pieces, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative scores from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Rows and anchors that one task compares.
ROWS = 8192
ANCHORS = 32768
#: Scores held at once.
CELLS = 1 << 21

_LONG = np.iinfo(np.int64)


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, q): whole vectors of finite numbers with a label and an id, one row for each id.

    Each component becomes floor(scale * x). Of rows that share an id the one with the
    smallest label, then the smallest vector counts.
    """
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    found = rows.where(x.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"))
    least = found.where("id is not null and label is not null").groupBy("id").agg(
        F.min(F.struct("label", "q")).alias("v"))
    return least.select("id", "v.label", "v.q")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _longest(column: pa.ChunkedArray) -> int:
    sizes = [len(x) for x in column]
    return max(sizes, default=0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b; beyond the range of a long, its end."""
    most = max(int(np.abs(x).max(initial=0)) if x.size and x.min() > _LONG.min else 1 << 63 for x in (a, b))
    if most * most * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.T.astype(object) if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(whole, _LONG.min, _LONG.max).astype(np.int64)


class _Block:
    """The rows and anchors of one task, by ascending id."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        width = max(_longest(rows.column("q")), _longest(anchors.column("q")))
        rows, self.anchors = rows.sort_by("id"), anchors.sort_by("id")
        self.ids, self.labels = np.asarray(rows.column("id")), np.asarray(rows.column("label"))
        self.vectors = _matrix(rows.column("q"), width)
        self.anchor_ids = np.asarray(self.anchors.column("id"))
        self.anchor_labels = np.asarray(self.anchors.column("label"))
        self.anchor_vectors = _matrix(self.anchors.column("q"), width)

    def ranked(self, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor the (scores, ids) of the rows of its label, or of all others, best first."""
        for label in np.unique(self.anchor_labels):
            mine = np.flatnonzero(self.anchor_labels == label)
            chosen = (self.labels == label) if same else (self.labels != label)
            ids, vectors = self.ids[chosen], self.vectors[chosen]
            step = max(1, CELLS // max(1, len(ids)))
            for a in range(0, len(mine), step) if len(ids) else ():
                part = mine[a: a + step]
                scores = products(self.anchor_vectors[part], vectors)
                # Complement instead of minus: it has no overflow. Stable, so ties ascend by id.
                order = np.argsort(~scores, axis=1, kind="stable")
                for i, row in zip(part, range(len(part))):
                    yield int(i), scores[row][order[row]], ids[order[row]]


def _pairs(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    n = [len(s) for _, s, _ in found]
    empty = [np.zeros(0, np.int64)]
    return pa.table({
        "anchor": pa.array(np.repeat(np.array([a for a, _, _ in found], np.int64), n), pa.int64()),
        "score": pa.array(np.concatenate([s for _, s, _ in found] or empty), pa.int64()),
        "id": pa.array(np.concatenate([i for _, _, i in found] or empty), pa.int64())})


def _best_positives(most: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, found = _Block(rows, anchors), []
        for i, scores, ids in block.ranked(True):
            own = block.anchor_ids[i]
            first = np.flatnonzero(ids[: most + 1] != own)[:most]
            found.append((own, scores[first], ids[first]))
        return _pairs(found)
    return run


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and largest score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _best_negatives(most: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, found = _Block(rows, anchors), []
        opened = block.anchors.column("scores").to_pylist()
        for i, scores, ids in block.ranked(False):
            spans = []
            for s in set(opened[i]):
                least, largest = _bounds(s, low, high)
                a = int(np.searchsorted(~scores, ~min(max(largest, _LONG.min), _LONG.max), "left"))
                b = int(np.searchsorted(~scores, ~min(max(least, _LONG.min), _LONG.max), "right"))
                if least <= largest:
                    spans.append(np.arange(a, min(b, a + most)))
            at = np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)
            found.append((block.anchor_ids[i], scores[at], ids[at]))
        return _pairs(found)
    return run


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, work) -> DataFrame:
    """Every block of rows with every block of anchors."""
    r, a = pieces(n_rows, ROWS), pieces(n_anchors, ANCHORS)
    key = F.xxhash64("id")
    left = rows.select(F.pmod(key, F.lit(r)).cast("int").alias("r"),
                       F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("a"),
                       *(F.col(c).alias(c) for c in rows.columns))
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"),
                           F.pmod(key, F.lit(a)).cast("int").alias("a"),
                           *(F.col(c).alias(c) for c in anchors.columns))
    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(
        work, "anchor bigint, score bigint, id bigint")


def _sorted(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """The secondary sort: by anchor to partitions, by the whole key inside them."""
    return pairs.repartition(parts(pairs), "anchor").sortWithinPartitions("anchor", *order)


def _first(most: int):
    """The first rows of each anchor in the order that they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            anchors, take = batch.column("anchor").to_pylist(), []
            for k, anchor in enumerate(anchors):
                now, seen = (anchor, 0) if anchor != now else (now, seen)
                if seen < most:
                    take.append(k)
                seen += 1
            yield batch.take(pa.array(take, pa.int64()))
    return run


def _open_windows(most: int, low: int, high: int):
    """Gives each negative, in order, to every window of its anchor that is open and not full."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in batches:
            out: list[tuple] = []
            for anchor, score, negative, i in zip(*(batch.column(c).to_pylist() for c in
                                                    ("anchor", "score", "negative", "id"))):
                if anchor != now:
                    now, windows = anchor, []
                if not negative:
                    windows.append([i, score, *_bounds(score, low, high), 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3] and w[4] < most:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], i, w[1], score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)
    return run


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label: str | Column = "label", scale: int = SCALE, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `is_anchor`, a condition on the column `id`, holds. For each
    of an anchor's `positives` best other rows of its label the first `negatives` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score are
    returned, best first; equal scores ascend by id. Fewer rows than asked are all returned; an
    anchor without positives, and a positive without negatives, have no rows.

    Rows without an id, label or vector, or with a component that is null or not finite,
    take no part; so do empty tables, whose result is empty. Of rows that repeat an id one
    counts, see `usable`. Shorter vectors count as ending in zeros. Scores beyond the range
    of a long are held at its ends. Other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    found = stored(usable(rows, id_col, vector_col, label, scale), "vectors")
    anchors = found.where(is_anchor)
    n = found.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    near = _met(found, anchors, n["rows"], n["anchors"], _best_positives(positives))
    shape = "anchor bigint, score bigint, id bigint"
    best = stored(_sorted(near, [F.desc("score"), F.asc("id")]).mapInArrow(_first(positives), shape), "positives")
    opened = best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("scores"))
    far = _met(found, anchors.join(opened, "id"), n["rows"], n["anchors"], _best_negatives(negatives, low, high))
    keys = best.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True)))
    return _sorted(keys, [F.desc("score"), F.asc("negative"), F.asc("id")]).mapInArrow(
        _open_windows(negatives, low, high),
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
        "negative_score bigint")
