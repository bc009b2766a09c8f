"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts texts into chunks of about `chunk_bytes`, wherever the
cut falls. The words that lie whole inside a chunk are encoded as one piece, once for all
documents that share the chunk, while the worker remembers it. A word that a cut runs
through is the join of two chunks: it is encoded again by the library, in one string with its neighbours,
of which more and more are taken in until what comes out agrees with what stands on both
sides; a document where not even that agrees is encoded in one. Tokenizers whose words do not
stand apart have no such joins and encode whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.encoding import Encoder
from treeline.llm.exact_dedup import rolling
from treeline.llm.packing import tokenizer_path
from treeline.llm.words import buffer, slices, spans_hash, words

CHUNK_BYTES = 1024
#: Bytes of ids that a worker remembers for its chunks.
CACHE_BYTES = 16 << 20


class ChunkEncoder:
    """Encodes texts by chunks, and remembers chunks up to a bound."""

    def __init__(self, encoder: Encoder, chunk_bytes: int):
        self.encoder = encoder
        self.mask = np.uint32((1 << max(1, chunk_bytes.bit_length() - 1)) - 1) << np.uint32(8)
        self.known: dict[int, bytes] = {}
        self.held = 0

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of the given spans, each distinct one encoded once."""
        hashes = spans_hash(data, starts, ends)
        own, first = np.unique(hashes, return_index=True)
        new = [i for h, i in zip(own.tolist(), first.tolist()) if h not in self.known]
        if new:
            found = [data[starts[i]: ends[i]] for i in new]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
            ids, before = self.encoder.encode(np.concatenate(found), offsets)
            whole, keys = ids.tobytes(), hashes[new].tolist()
            if self.held > CACHE_BYTES:
                kept = set(own.tolist())
                self.known = {h: x for h, x in self.known.items() if h in kept}
                self.held = sum(map(len, self.known.values()))
            for h, a, b in zip(keys, before[:-1].tolist(), before[1:].tolist()):
                self.known[h] = whole[4 * a: 4 * b]
                self.held += 4 * (b - a)
        return [self.known[h] for h in hashes.tolist()]

    def _agree(self, data, starts, ends, counts, broken, doc_of) -> tuple[list[bytes], set[int]]:
        """Ids of the words that cuts run through, and the documents where no join agrees.

        A join is encoded with `reach` words on each side; what the library gives has to begin
        and end with what stands there, and the rest are the ids of the join. Where it does not,
        the reach is doubled, up to the whole document.
        """
        out, odd = [b""] * len(broken), set()
        rest, reach = np.arange(len(broken)), 1
        while len(rest):
            own, docs = broken[rest], doc_of[rest]
            left = np.maximum(own - reach, counts[docs])
            right = np.minimum(own + reach, counts[docs + 1] - 1)
            texts = [data[a:b].tobytes().decode() for a, b in zip(starts[left], ends[right])]
            distinct = list(dict.fromkeys(texts))
            whole = dict(zip(distinct, (x.tobytes() for x in self.encoder.by_library(distinct))))
            before = self._runs(data, starts, ends, left, own)
            behind = self._runs(data, starts, ends, own + 1, right + 1)
            open_ = []
            for k, i in enumerate(rest.tolist()):
                ids, a, b = whole[texts[k]], before[k], behind[k]
                if len(a) + len(b) <= len(ids) and ids.startswith(a) and ids.endswith(b):
                    out[i] = ids[len(a): len(ids) - len(b)]
                elif left[k] == counts[docs[k]] and right[k] == counts[docs[k] + 1] - 1:
                    odd.add(int(docs[k]))
                else:
                    open_.append(i)
            rest, reach = np.array(open_, dtype=np.int64), 2 * reach
        return out, odd

    def _runs(self, data, starts, ends, first, past) -> list[bytes]:
        """Ids of the words from first to past, nothing where these are equal."""
        out = [b""] * len(first)
        at = np.flatnonzero(past > first)
        if len(at):
            order = at[np.argsort(first[at], kind="stable")]
            for i, x in zip(order.tolist(), self._pieces(data, starts[first[order]], ends[past[order] - 1])):
                out[i] = x
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids before each text)."""
        if not self.encoder.apart or not len(data):
            return self.encoder.encode(data, offsets)
        starts, ends, counts = words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts = np.flatnonzero((rolling(data) & self.mask) == 0) + 1
        word = np.searchsorted(starts, cuts, "left") - 1
        inner = (word >= 0) & (cuts > starts[word]) & (cuts < ends[word])
        broken = np.unique(word[inner])
        # A new piece begins at a document, behind a cut, at a broken word and behind it.
        begins = np.unique(np.concatenate([
            counts[:-1], np.searchsorted(starts, cuts, "left"), broken, broken + 1]))
        begins = begins[begins < len(starts)]
        past = np.append(begins[1:], len(starts)) - 1
        is_join = np.isin(begins, broken)
        pieces: list[bytes] = [b""] * len(begins)
        at = np.flatnonzero(~is_join)
        for i, x in zip(at.tolist(), self._pieces(data, starts[begins[at]], ends[past[at]])):
            pieces[i] = x
        doc_of = np.searchsorted(counts, begins, "right") - 1
        odd: set[int] = set()
        at = np.flatnonzero(is_join)
        if len(at):
            joined, odd = self._agree(data, starts, ends, counts, begins[at], doc_of[at])
            for i, x in zip(at.tolist(), joined):
                pieces[i] = x
        n = np.bincount(doc_of, weights=[len(x) // 4 for x in pieces],
                        minlength=len(offsets) - 1).astype(np.int64)
        ids = np.frombuffer(b"".join(pieces), dtype=np.uint32)
        before = np.concatenate(([0], np.cumsum(n)))
        if odd:
            each = [ids[a:b] for a, b in zip(before, before[1:])]
            for d in odd:
                each[d] = self.encoder.by_library([data[offsets[d]: offsets[d + 1]].tobytes().decode()])[0]
            ids = np.concatenate(each).astype(np.uint32)
            before = np.concatenate(([0], np.cumsum([len(x) for x in each])))
        return ids, before


def _encode(path: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        chunks = ChunkEncoder(encoder, chunk_bytes)
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                ids, before = chunks.encode(*buffer(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids.view(np.int32)))
                texts: list[str] = []
                for a in range(0, len(before) - 1, 64):
                    cut = before[a: a + 65].tolist()
                    texts += encoder.whole.decode_batch(
                        [ids[x:y].tolist() for x, y in zip(cut, cut[1:])], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        encoder.rest()
    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, ids, decoded.

    ids are what the tokenizers library gives for the whole text without special tokens,
    truncation or padding; decoded is its decode of them with special tokens kept. A null or
    empty text has no ids and decodes to an empty text; texts of any length are whole.
    Repeated rows give equal rows; an empty table gives an empty result; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_encode(path or tokenizer_path(), chunk_bytes),
                           f"doc_id {kind}, ids array<int>, decoded string")
