"""Removal of byte strings that repeat, by sorting suffixes in ranges of their leading bytes.

Which suffixes. A string of `width` bytes holds `reach` shorter strings of `k` bytes; the one
with the least hash, the leftmost of equals, is its anchor. Equal strings have their
anchors at the same place, so it is enough to sort the suffixes that start at anchors, about one in
`reach` / 2 bytes, with the bytes before them that the anchor's strings take in. The k bytes at an
anchor are counted first, as 64-bit hashes packed by (batch, bucket): an anchor whose k bytes
occur once belongs to no repeated string. Texts that equal an earlier one repeat whole,
so their anchors are not counted.

Sorting. A sample of the leading bytes gives splitters, and suffixes go to the bucket between two
splitters. A value that several splitters share, a passage in very many texts, has a bucket
of its own, which is cut into parts by text. Within a part, suffixes are sorted by multikey
quicksort on eight bytes at a time, and so are the bytes before them, read backwards. Neighbours give
common lengths; suffixes that agree in enough bytes to the right and to the left of an
anchor hold the same string of `width` bytes, and all but the first of these are removed. What
is first in one part of a cut bucket is compared across the parts by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.store import lookup, parts, pieces, stored
from treeline.llm.words import bucket_of, buffer, mix, release, slices

WIDTH = 100
#: Bytes of text in a batch, hashes in a bucket, and suffixes in a part, about.
BATCH_BYTES = 16 << 20
BUCKET_HASHES = 1 << 20
PART_SUFFIXES = 40_000
#: Leading bytes of a suffix that place it, k at most, and splitter candidates a bucket.
LEAD = 16
DRAWS = 30
_BLOCK = 1 << 20
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def key_bytes(width: int) -> int:
    """k: the bytes of an anchor, a multiple of eight."""
    if width < 16:
        raise ValueError("width has to be 16 at least")
    return 8 * max(1, width // 25)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, dtype=np.uint64)
    for o in range(8):
        m = (n - o + 7) // 8
        out[o::8] = padded[o: o + 8 * m].view(np.uint64)
    return out


def _block_anchors(data: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the string at each position, hash of the k bytes at each position)."""
    each = _eights(data) * _FACTORS[0]
    each ^= each >> np.uint64(32)
    n = len(data) - k + 1
    hashes = each[:n] * _FACTORS[1]
    for j in range(8, k, 8):
        hashes += each[j: j + n] * _FACTORS[1 + j // 8]
    hashes = mix(hashes)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    reach, have = width - k + 1, 1
    while have < reach:
        step = min(have, reach - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(place, first string, last string, hash) of each anchor; strings lie inside one text.

    Works through blocks of the bytes; an anchor at the edge of two has a row in each.
    """
    k, found = key_bytes(width), []
    for b in range(0, max(0, len(data) - width + 1), _BLOCK):
        at, hashes = _block_anchors(data[b: b + _BLOCK + width - 1], width, k)
        n = len(at)
        steps = np.zeros(n + 1, np.int32)
        low, high = offsets[:-1] - b, offsets[1:] - width + 1 - b
        use = (high > low) & (high > 0) & (low < n)
        np.add.at(steps, np.maximum(low[use], 0), 1)
        np.add.at(steps, np.minimum(high[use], n), -1)
        inside = np.cumsum(steps[:-1]) > 0
        turn = np.ones(n, bool)
        turn[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
        end = np.ones(n, bool)
        end[:-1] = turn[1:] | ~inside[1:]
        first, last = np.flatnonzero(inside & turn), np.flatnonzero(inside & end)
        found.append((at[first] + b, first + b, last + b, hashes[at[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def multikey_order(chars: np.ndarray) -> np.ndarray:
    """Rows in ascending order by multikey quicksort: all segments of one round at once.

    A segment is split by its pivot's character at its depth into smaller, equal and larger
    rows; the equal ones go on with the next character.
    """
    n, m = chars.shape
    order = np.arange(n)
    low, high, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        live = (high - low > 1) & (depth < m)
        low, high, depth = low[live], high[live], depth[live]
        if not len(low):
            return order
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        first = np.cumsum(size) - size
        at = np.arange(len(of)) - first[of] + low[of]
        rows = order[at]
        c = chars[rows, depth[of]]
        three = np.sort(np.stack([c[first], c[first + size // 2], c[first + size - 1]]), axis=0)
        pivot = three[1][of]
        classes = [c < pivot, c == pivot, c > pivot]
        place, start, counts = np.empty(len(of), np.int64), low.copy(), []
        for chosen in classes:
            past = np.cumsum(chosen)
            before = past[first] - chosen[first]
            own = np.flatnonzero(chosen)
            place[own] = start[of[own]] + past[own] - 1 - before[of[own]]
            count = np.bincount(of[own], minlength=len(low))
            counts.append(count)
            start = start + count
        order[place] = rows
        cuts = [low, low + counts[0], low + counts[0] + counts[1], high]
        low, high = np.concatenate(cuts[:3]), np.concatenate(cuts[1:])
        depth = np.concatenate([depth, depth + 1, depth])


def _sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row, common bytes of each sorted row with the one before)."""
    n, width = rows.shape
    wide = -(-max(width, 1) // 8) * 8
    padded = np.zeros((n, wide), np.uint8)
    padded[:, :width] = rows
    order = multikey_order(padded.view(">u8").astype(np.uint64))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.zeros(n, np.int64)
    if n > 1 and width:
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return rank, common


def suffix_type(width: int) -> np.dtype:
    """A suffix on its way: text by order and address, place, its strings, bytes right and left."""
    return np.dtype([("late", "u1"), ("doc", "<i8"), ("tie", "<i8"), ("batch", "<i4"), ("row", "<i4"),
                     ("at", "<i8"), ("least", "<u2"), ("most", "<u2"),
                     ("right", "u1", (width,)), ("left", "u1", (width - key_bytes(width),))])


_FIRST = np.dtype([("h", "<u8"), ("g", "<u8"), ("late", "u1"), ("doc", "<i8"), ("tie", "<i8"),
                   ("start", "<i8"), ("batch", "<i4"), ("row", "<i4")])
_SPAN = np.dtype([("row", "<i4"), ("first", "<i8"), ("past", "<i8")])


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of keys with the positions that have it."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(keys[own[0]]), own


def _blobs(groups: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"batch": pa.array([g[0] for g in groups], pa.int32()),
                     "bucket": pa.array([g[1] for g in groups], pa.int32()),
                     "blob": pa.array([g[2] for g in groups], pa.binary())})


def _joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.zeros(0, kind)])


def _ranks(rows: np.ndarray, names: list[str]) -> np.ndarray:
    """Dense ranks by the columns named, the first one first."""
    order = np.lexsort([rows[n] for n in names[::-1]])
    turn = np.zeros(len(order), np.int64)
    for n in names:
        turn[1:] |= rows[n][order[1:]] != rows[n][order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(turn)
    return out


def _later(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(not the first of its key, stands for its key). Equal ranks are one text: neither is later."""
    order = np.lexsort((ranks, keys))
    head = np.ones(len(order), bool)
    head[1:] = keys[order[1:]] != keys[order[:-1]]
    least = ranks[order][head][np.cumsum(head) - 1]
    late = np.empty(len(order), bool)
    late[order] = ranks[order] > least
    stands = np.zeros(len(order), bool)
    stands[order[head]] = True
    return late, stands


def _digests(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of bytes."""
    n, width = strings.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings
    out = []
    for seed in (0, 32):
        h = np.full(n, seed + 1, np.uint64)
        for j, chars in enumerate(wide.view(np.uint64).T):
            h = mix((h ^ mix(chars + _FACTORS[(seed + j) % 64])) * _FACTORS[(seed + j + 1) % 64])
        out.append(h)
    return out[0], out[1]


def _compare(width: int, n_digests: int):
    """Sorts one part and returns the spans that go, by batch, and, if the bucket is cut, what is first."""
    kind, k = suffix_type(width), key_bytes(width)

    def run(table: pa.Table) -> pa.Table:
        cut = bool(table.column("cut")[0].as_py())
        rows = _joined(table.column("blob"), kind)
        ranks = _ranks(rows, ["late", "doc", "tie", "at"])
        right, right_common = _sorted_rows(rows["right"])
        left, left_common = _sorted_rows(rows["left"])
        least, most = rows["least"].astype(np.int64), rows["most"].astype(np.int64)
        low, high = np.full(len(rows), width, np.int64), np.full(len(rows), -1, np.int64)
        out, firsts = [], []
        for o in range(width - k + 1):
            own = np.flatnonzero((least <= o) & (o <= most))
            if not len(own):
                continue
            to_right = np.cumsum(right_common < width - o)[right[own]]
            to_left = np.cumsum(left_common < o)[left[own]]
            late, stands = _later(to_right * (len(rows) + 1) + to_left, ranks[own])
            gone = own[late]
            low[gone], high[gone] = np.minimum(low[gone], o), o
            if cut:
                of = own[stands]
                whole = np.concatenate([rows["left"][of][:, :o][:, ::-1], rows["right"][of][:, : width - o]], axis=1)
                first = np.zeros(len(of), _FIRST)
                first["h"], first["g"] = _digests(whole)
                first["start"] = rows["at"][of] - o
                for name in ("late", "doc", "tie", "batch", "row"):
                    first[name] = rows[name][of]
                firsts.append(first)
        gone = np.flatnonzero(high >= 0)
        spans = np.zeros(len(gone), _SPAN)
        spans["row"] = rows["row"][gone]
        spans["first"], spans["past"] = rows["at"][gone] - high[gone], rows["at"][gone] - low[gone] + width
        out += [(b, -1, spans[own].tobytes()) for b, own in _grouped(rows["batch"][gone])]
        if firsts:
            first = np.concatenate(firsts)
            out += [(-1, d, first[own].tobytes()) for d, own in _grouped(
                (first["h"] % np.uint64(n_digests)).astype(np.int64))]
        return _blobs(out)
    return run


def _across(width: int):
    """Of equal strings that are first in their parts, all but the first of all."""
    def run(table: pa.Table) -> pa.Table:
        rows = _joined(table.column("blob"), _FIRST)
        late, _ = _later(_ranks(rows, ["h", "g"]), _ranks(rows, ["late", "doc", "tie", "start"]))
        gone = rows[late]
        spans = np.zeros(len(gone), _SPAN)
        spans["row"], spans["first"], spans["past"] = gone["row"], gone["start"], gone["start"] + width
        return _blobs([(b, -1, spans[own].tobytes()) for b, own in _grouped(gone["batch"])])
    return run


def _known(copies: pa.Table) -> set[tuple]:
    return set(zip(copies.column("doc_id").to_pylist(), copies.column("digest").to_pylist()))


def _fresh(left: pa.Table, copies: set[tuple]) -> np.ndarray:
    """Rows whose text does not equal that of an earlier row."""
    pairs = zip(left.column("doc_id").to_pylist(), left.column("digest").to_pylist())
    return np.array([p not in copies for p in pairs], bool)


def _in_order(left: pa.Table) -> pa.Table:
    """A batch in an order of its own, the same whenever it is read."""
    return left.sort_by([("doc_id", "ascending"), ("digest", "ascending")]).combine_chunks()


def _ask(width: int, n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _blobs([])
        batch = left.column("batch")[0].as_py()
        left = left.filter(pa.array(_fresh(left, _known(right)))).combine_chunks()
        data, offsets = buffer(left.column("text"))
        own = np.unique(anchors(data, offsets, width)[3])
        out = [(batch, b, own[at].tobytes()) for b, at in _grouped(bucket_of(own, n_buckets))]
        release()
        return _blobs(out)
    return run


def _answer(table: pa.Table) -> pa.Table:
    """To each batch those of its hashes that another batch has too."""
    blobs = [np.frombuffer(x, np.uint64) for x in table.column("blob").to_pylist()]
    batch = np.repeat(np.asarray(table.column("batch")), [len(x) for x in blobs])
    hashes = np.concatenate(blobs)
    order = np.argsort(hashes, kind="stable")
    hashes, batch = hashes[order], batch[order]
    same = hashes[1:] == hashes[:-1]
    several = np.zeros(len(hashes), bool)
    several[1:] |= same
    several[:-1] |= same
    hashes, batch = hashes[several], batch[several]
    return _blobs([(b, -1, hashes[own].tobytes()) for b, own in _grouped(batch)])


_TEXTS = ("batch int, row int, doc_id bigint, tie bigint, text binary, copied boolean, places binary, "
          "n_places bigint, leads array<binary>")


def _place(width: int):
    """The rows of a batch with the anchors that may repeat."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _in_order(left)
        copies = right.filter(pc.is_valid(right.column("digest")))
        told = [np.frombuffer(x, np.uint64) for x in right.column("blob").to_pylist() if x]
        fresh = _fresh(left, _known(copies))
        at = np.flatnonzero(fresh)
        data, offsets = buffer(left.column("text").filter(pa.array(fresh)) if left.num_rows else left.column("text"))
        place, first, last, hashes = anchors(data, offsets, width)
        order = np.argsort(hashes, kind="stable")
        again = hashes[order][1:] == hashes[order][:-1]
        use = np.zeros(len(hashes), bool)
        use[order[1:][again]] = use[order[:-1][again]] = True
        if told:
            use |= np.isin(hashes, np.concatenate(told))
        place, first, last = place[use], first[use], last[use]
        doc = np.searchsorted(offsets, place, "right") - 1
        # Texts of no bytes share an offset with the next: the last of these holds the place.
        packed = np.stack([place - offsets[doc], place - last, place - first], axis=1).astype(np.int64)
        counts = np.bincount(at[doc], minlength=left.num_rows) if len(at) else np.zeros(left.num_rows, np.int64)
        cuts = np.concatenate(([0], np.cumsum(counts)))
        drawn = mix(hashes[use] ^ (np.arange(len(place), dtype=np.uint64) + np.uint64(1))) % np.uint64(64) == 0
        leads = [[] for _ in range(left.num_rows)]
        for p, d in zip(place[drawn], doc[drawn]):
            leads[at[d]].append(data[p: p + min(LEAD, key_bytes(width))].tobytes())
        digests = left.column("digest").to_pylist()
        out = pa.table({
            "batch": left.column("batch"), "row": pa.array(np.arange(left.num_rows), pa.int32()),
            "doc_id": left.column("doc_id"),
            "tie": pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
            "text": left.column("text"), "copied": pa.array(~fresh, pa.bool_()),
            "places": pa.array([packed[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            "n_places": pa.array(counts, pa.int64()), "leads": pa.array(leads, pa.list_(pa.binary()))})
        release()
        return out
    return run


def splitters(draws: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values in ascending order, how many of the n - 1 splitters each is)."""
    draws = np.sort(np.array(draws, dtype=f"S{LEAD}"))
    cuts = draws[[len(draws) * i // n for i in range(1, n)]] if len(draws) else draws
    return np.unique(cuts, return_counts=True)


def _spread(width: int, values: np.ndarray, times: np.ndarray):
    """Suffixes of the marked anchors by bucket and part."""
    kind, n_lead = suffix_type(width), min(LEAD, key_bytes(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 2 << 20):
                n = np.asarray(part.column("n_places"))
                doc = np.repeat(np.arange(part.num_rows), n)
                packed = _joined(pa.chunked_array([part.column("places")]), np.dtype("<i8")).reshape(-1, 3)
                data, offsets = buffer(part.column("text"))
                for a in range(0, len(packed), 16_384):
                    own, at = doc[a: a + 16_384], packed[a: a + 16_384, 0]
                    rows = np.zeros(len(own), kind)
                    rows["late"] = np.asarray(part.column("doc_id").is_null())[own]
                    rows["doc"] = np.asarray(part.column("doc_id").fill_null(0))[own]
                    rows["at"], rows["least"], rows["most"] = at, packed[a: a + 16_384, 1], packed[a: a + 16_384, 2]
                    for name in ("tie", "batch", "row"):
                        rows[name] = np.asarray(part.column(name))[own]
                    place = at + offsets[own]
                    for name, sign, length in (("right", 1, width - rows["least"].astype(np.int64)),
                                               ("left", -1, rows["most"].astype(np.int64))):
                        step = np.arange(rows[name].shape[1])
                        index = place[:, None] + (step if sign > 0 else -1 - step)
                        held = data[np.clip(index, 0, len(data) - 1)]
                        rows[name] = np.where(step < length[:, None], held, 0)
                    lead = np.ascontiguousarray(rows["right"][:, :n_lead]).view(f"S{n_lead}").reshape(-1)
                    bucket = np.searchsorted(values, lead, "left")
                    hot = np.zeros(len(rows), np.int64)
                    if len(values):
                        near = np.minimum(bucket, len(values) - 1)
                        hot = np.where(values[near] == lead, times[near], 0)
                    cut = hot > 1
                    salt = mix(rows["batch"].astype(np.uint64) << np.uint64(32) | rows["row"].astype(np.uint64))
                    piece = np.where(cut, (salt % np.maximum(hot, 1).astype(np.uint64)).astype(np.int64), 0)
                    groups = list(_grouped((2 * bucket + cut) << 32 | piece))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([g >> 32 for g, _ in groups], pa.int64()),
                        pa.array([g & 0xFFFFFFFF for g, _ in groups], pa.int64()),
                        pa.array([bool(g >> 32 & 1) for g, _ in groups], pa.bool_()),
                        pa.array([rows[x].tobytes() for _, x in groups], pa.binary())],
                        ["bucket", "part", "cut", "blob"])
        release()
    return run


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first: bigint, past: bigint>>, kept binary"


def merged(first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal spans of the given ones; touching ones are one."""
    order = np.argsort(first, kind="stable")
    first, past = first[order], np.maximum.accumulate(past[order])
    head = np.ones(len(first), bool)
    head[1:] = first[1:] > past[:-1]
    return first[head], past[np.append(np.flatnonzero(head)[1:] - 1, len(past) - 1)] if len(first) else past


def _apply(left: pa.Table, right: pa.Table) -> pa.Table:
    spans = _joined(right.column("blob"), _SPAN)
    spans = spans[np.argsort(spans["row"], kind="stable")]
    out = []
    for doc_id, row, text in zip(*(left.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
        a, b = np.searchsorted(spans["row"], [row, row + 1])
        first, past = merged(spans["first"][a:b], spans["past"][a:b])
        starts, ends = [0, *past.tolist()], [*first.tolist(), len(text)]
        out.append((doc_id, len(text), int((past - first).sum()),
                    [{"first": x, "past": y} for x, y in zip(first.tolist(), past.tolist())],
                    b"".join(text[x:y] for x, y in zip(starts, ends))))
    columns = list(zip(*out)) or [[]] * 5
    span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                          batch_bytes: int = BATCH_BYTES, part_suffixes: int = PART_SUFFIXES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans, kept.

    Texts are bytes in UTF-8. A byte goes if a string of `width` bytes covers it that also starts
    earlier: in a document with a smaller id, or before it in the same one. Strings lie inside
    one document and are judged on the input. spans are the maximal removed runs
    [first, past), kept the other bytes in their order.

    A null text is empty; shorter texts than `width` lose nothing; an empty table gives
    an empty result. Rows without an id come after all others; rows that share an id follow
    each other by their text's digest. Rows equal in id and text are one document: each
    of them has that document's result, and one task holds them. Other columns are not read.
    """
    spark, n_parts = docs.sparkSession, parts(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    n_batches = pieces(size["b"] or 0, batch_bytes)
    hashes = 2 * (size["b"] or 0) // (width - key_bytes(width) + 1)
    n_buckets = max(n_parts, pieces(hashes, BUCKET_HASHES))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = keyed.withColumn("batch", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_batches)).cast("int"))

    # Rows whose text an earlier row has.
    marks = keyed.where(F.octet_length("text") >= width).select("doc_id", "digest", "batch")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    several = marks.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    several = several.select("digest", F.col("o.doc_id").alias("first"), "n")
    copies = lookup(marks, several, ["digest"], "n", size["n"], n_parts).where(
        F.col("n").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = stored(copies.select("batch", "doc_id", "digest"), "copies")

    texts = keyed.select("batch", "doc_id", "digest", "text").groupBy("batch")
    shape = "batch int, bucket int, blob binary"
    asked = texts.cogroup(copies.groupBy("batch")).applyInArrow(_ask(width, n_buckets), shape)
    told = asked.groupBy("bucket").applyInArrow(_answer, shape)
    none = F.lit(None)
    replies = told.select("batch", none.cast("long").alias("doc_id"), none.cast("binary").alias("digest"), "blob").unionByName(
        copies.select("batch", "doc_id", "digest", none.cast("binary").alias("blob")))
    placed = stored(texts.cogroup(replies.groupBy("batch")).applyInArrow(_place(width), _TEXTS), "placed")

    # Sample sort of the suffixes of the anchors that are left.
    marked = placed.where("n_places > 0")
    total = marked.agg(F.sum("n_places")).first()[0] or 0
    n = pieces(total, part_suffixes)
    draws = marked.select(F.explode("leads").alias("l")).sample(min(1.0, 64.0 * DRAWS * n / max(total, 1)), 11)
    values, times = splitters([bytes(r["l"]) for r in draws.collect()], n)
    suffixes = marked.select("batch", "row", "doc_id", "tie", "text", "places", "n_places").mapInArrow(
        _spread(width, values, times), "bucket bigint, part bigint, cut boolean, blob binary")
    found = stored(suffixes.groupBy("bucket", "part").applyInArrow(_compare(width, n_buckets), shape), "found")
    across = found.where("bucket >= 0").groupBy("bucket").applyInArrow(_across(width), shape)
    spans = found.where("bucket < 0").unionByName(across).select("batch", "blob")

    changed = marked.select("batch", "doc_id", "row", "text").groupBy("batch").cogroup(
        spans.groupBy("batch")).applyInArrow(_apply, _RESULT)
    length = F.octet_length("text").cast("long")
    span = F.array(F.struct(F.lit(0).cast("long").alias("first"), length.alias("past")))
    whole = placed.where("n_places = 0").select(
        "doc_id", length.alias("n_bytes"), F.when(F.col("copied"), length).otherwise(0).alias("n_removed"),
        F.when(F.col("copied"), span).otherwise(F.slice(span, 1, 0)).alias("spans"),
        F.when(F.col("copied"), F.lit("").cast("binary")).otherwise(F.col("text")).alias("kept"))
    return changed.unionByName(whole)
