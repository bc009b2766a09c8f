"""Words and hashes of whole Arrow batches, computed on their byte buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. In UTF-8 those six never occur inside another character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_BLOCK = 1 << 20


def release() -> None:
    """Give memory that a finished task no longer uses back to the system."""
    _block_powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # freed arrays stay with the allocator else
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts have about `most_bytes` together."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    block = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:][: len(texts) + 1]
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and the number of words before each document."""
    n = len(data)
    space = np.ones(n + 2, dtype=bool)
    space[1:-1] = _IS_SPACE[data]
    first = space[:-2].copy()
    last = space[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    last[inner - 1] = True
    solid = ~space[1:-1]
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of an odd base modulo 2**64, and their inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(2 * _BLOCK)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of data[start:end] for every span; starts ascend.

    Works through blocks of the bytes, so what it holds does not grow with one long text.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    letters = _letters(seed)
    up, down = _block_powers() if len(data) > _BLOCK // 8 else powers(len(data))
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + _BLOCK)))
        high = int(ends[i:j].max())
        if high - low >= len(up):
            up, down = powers(high - low)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(letters[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def inside(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that lie inside one document.

    counts: number of words before each document (and in all). Returns the position of
    each such window among all windows, and the document of each.
    """
    lengths = np.diff(counts)
    have = np.maximum(lengths - width + 1, 0)
    doc = np.repeat(np.arange(len(have)), have)
    start = np.repeat(counts[:-1] - (np.cumsum(have) - have), have)
    return np.arange(have.sum()) + start, doc


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending bucket numbers 0..n-1 of ascending hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
