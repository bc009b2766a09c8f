"""Packing of documents into sequences by length patterns.

Lengths fall into bins. Patterns of at most three bins that fill a sequence are fitted to
the histogram of lengths by non-negative least squares; the repeat counts are rounded
down, and what is left is packed by best fit, also into the space that patterns leave.
All of this works on the histogram, which has at most `size` entries however many
documents there are. Spark counts the histogram and numbers the pieces of each length;
each piece then finds its sequence by its length and number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.encoding import Encoder
from treeline.llm.store import stored
from treeline.llm.words import slices

SIZE = 4096
END_ID = 1
N_BINS = 128
MOST_IN_PATTERN = 3
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def patterns(n_bins: int, most: int) -> np.ndarray:
    """Rows of bin counts: every way to write n_bins as a sum of at most `most` bins."""
    found: list[list[int]] = []

    def extend(parts: list[int], rest: int, low: int) -> None:
        if rest >= low:
            found.append([*parts, rest])
        if len(parts) + 2 <= most:
            for p in range(low, rest // 2 + 1):
                extend([*parts, p], rest - p, p)

    extend([], n_bins, 1)
    out = np.zeros((len(found), n_bins + 1))
    for i, parts in enumerate(found):
        np.add.at(out[i], parts, 1)
    return out


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[inside] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= limit:
            break
        inside[best] = True
        while True:
            at = np.flatnonzero(inside)
            own = a[:, at]
            s = np.linalg.solve(own.T @ own + 1e-12 * np.eye(len(at)), own.T @ b)
            low = s <= 0
            if not low.any():
                x[:] = 0
                x[at] = s
                break
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low][[int(np.argmin(x[at][low]))]]
            x[gone] = 0
            inside[gone] = False
    return x


class Plan:
    """Groups of equal sequences, each with runs of (length, copies), and where they begin."""

    def __init__(self, histogram: dict[int, int], size: int, n_bins: int, most: int):
        self.size = size
        self.left = {k: int(v) for k, v in histogram.items() if v}
        self.used = dict.fromkeys(self.left, 0)
        #: (length, first number, number past it, first sequence, copies, offset)
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.n_sequences = 0
        #: Groups by free space: (first sequence, number of sequences).
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.free: list[int] = []
        self._by_patterns(n_bins, most)
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _take(self, length: int, group: tuple[int, int], copies: int, offset: int) -> None:
        first, n = group
        at = self.used[length]
        self.slots.append((length, at, at + n * copies, first, copies, offset))
        self.used[length] += n * copies
        self.left[length] -= n * copies

    def _new(self, n: int) -> tuple[int, int]:
        self.n_sequences += n
        return self.n_sequences - n, n

    def _leave(self, free: int, group: tuple[int, int]) -> None:
        if free and group[1]:
            if not self.open.get(free):
                insort(self.free, free)
                self.open[free] = []
            self.open[free].append(group)

    def _by_patterns(self, n_bins: int, most: int) -> None:
        width = -(-self.size // n_bins)
        bins = {k: -(-k // width) for k in self.left}
        have = np.zeros(n_bins + 1)
        for k, b in bins.items():
            have[b] += self.left[k]
        if not have.sum():
            return
        ways = patterns(n_bins, most)
        repeat = np.floor(non_negative(ways.T, have) + 1e-6).astype(np.int64)
        stock = {b: sorted((k for k in bins if bins[k] == b), reverse=True) for b in set(bins.values())}
        order = np.lexsort((np.arange(len(ways)), ways.sum(1)))
        for i in order[repeat[order] > 0]:
            todo = int(repeat[i])
            need = {int(b): int(ways[i, b]) for b in np.flatnonzero(ways[i])}
            while todo:
                lengths = []
                for b, k in need.items():
                    own = [x for x in stock.get(b, ()) if self.left[x]]
                    while k and own:
                        # One length serves all copies of its bin while it lasts.
                        lengths += [(own[0], min(k, self.left[own[0]]))]
                        k -= lengths[-1][1]
                        own = own[1:]
                    if k:
                        lengths = []
                        break
                if not lengths:
                    break
                n = min(todo, *(self.left[x] // k for x, k in lengths))
                group, offset = self._new(n), 0
                for x, k in lengths:
                    self._take(x, group, k, offset)
                    offset += x * k
                self._leave(self.size - offset, group)
                todo -= n

    def _best_fit(self, length: int) -> None:
        while self.left[length]:
            at = bisect_left(self.free, length)
            n = self.left[length]
            if at == len(self.free):
                free, group = self.size, None
                copies = min(n, free // length)
                group = self._new(n // copies)
            else:
                free = self.free[at]
                group = self.open[free].pop()
                if not self.open[free]:
                    self.free.pop(at)
                copies = min(n, free // length)
                if group[1] * copies > n:
                    fit = n // copies
                    self._leave(free, (group[0] + fit, group[1] - fit))
                    group = (group[0], fit)
            self._take(length, group, copies, self.size - free)
            self._leave(free - copies * length, group)

    def table(self) -> np.ndarray:
        return np.array(sorted(self.slots), dtype=np.int64).reshape(-1, 6)


_PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
           " chunk int, number bigint")


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                ids, before = encoder.encode_array(part.column("text"))
                ids = np.insert(ids, before[1:], end_id).astype("<u4")
                before = before + np.arange(len(before))
                total = np.diff(before)
                n = -(-total // size)
                doc = np.repeat(np.arange(len(total)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, total[doc] - start)
                at = before[doc] + start
                crc = [zlib.crc32(ids[a: a + k]) for a, k in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.searchsorted(ranked, ranked)
                number = np.empty(len(length), dtype=np.int64)
                number[order] = np.arange(len(length)) - first + seen[ranked]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()),
                    pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), chunk), pa.int32()), pa.array(number),
                ], ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "number"])
        encoder.rest()
    return run


def _placed(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = np.asarray(b.column("length")), np.asarray(b.column("number"))
            sequence, offset = np.zeros_like(number), np.zeros_like(number)
            for k in np.unique(length):
                own = slots[np.searchsorted(slots[:, 0], k): np.searchsorted(slots[:, 0], k, "right")]
                mine = length == k
                r = number[mine]
                s = own[np.searchsorted(own[:, 1], r, "right") - 1]
                sequence[mine] = s[:, 3] + (r - s[:, 1]) // s[:, 4]
                offset[mine] = s[:, 5] + (r - s[:, 1]) % s[:, 4] * k
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         size: int = SIZE, end_id: int = END_ID, n_bins: int = N_BINS,
         most_in_pattern: int = MOST_IN_PATTERN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then end_id; a null or empty text is end_id alone.
    Documents of more than `size` ids are cut into pieces of `size`, the last may be
    shorter; all others are one piece. A sequence holds at most `size` ids without gaps,
    offsets begin at 0. Equal lengths are told apart by the order in which tasks read
    them. Repeated rows are packed as often as they occur; an empty table gives an empty
    result; other columns are not read.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(_cut(path, size, end_id), _PIECES), "pieces")
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Plan(histogram, size, n_bins, most_in_pattern).table()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")
    numbered = pieces.join(counts.select("chunk", "length", before.alias("before")), ["chunk", "length"])
    return numbered.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("number")
    ).mapInArrow(_placed(slots), "doc_id bigint, piece int, start bigint, length bigint,"
                 " ids_crc32 bigint, sequence_id bigint, offset bigint")
