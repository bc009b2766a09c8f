"""Suffix deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import suffix_dedup
from treeline.llm.suffix_dedup import anchors, key_bytes, multikey_order, remove_repeated_bytes, splitters


def brute(rows, width):
    """(doc_id, n_bytes, n_removed, spans, kept) of each distinct (doc_id, text)."""
    docs = sorted({(i is None, i or 0, hashlib.sha256((t or "").encode()).digest()[:8]): (i, (t or "").encode())
                   for i, t in rows}.items(), key=lambda x: (x[0][0], x[0][1], int.from_bytes(x[0][2], "little", signed=True)))
    seen, out = set(), {}
    for _, (i, b) in docs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            w = b[p: p + width]
            if w in seen:
                gone[p: p + width] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out[i, b] = (i, len(b), int(gone.sum()), [tuple(map(int, e)) for e in zip(edges[::2], edges[1::2])],
                     bytes(x for x, g in zip(b, gone) if not g))
    return sorted(map(repr, (out[i, (t or "").encode()] for i, t in rows)))


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)))
                  for r in df.collect())


def test_multikey_order():
    draw = np.random.default_rng(4)
    rows = draw.integers(0, 3, (2000, 24)).astype(np.uint8)
    rows[:, :9] = 5
    order = multikey_order(rows.view(">u8").astype(np.uint64))
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)


@pytest.mark.parametrize("width", [16, 60, 100])
def test_equal_strings_have_anchors_at_one_place(width, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 50)
    draw = random.Random(3)
    texts = [bytes(draw.choices(b"ab", k=draw.randint(0, 300))) for _ in range(20)] + [b"", b"a" * 250]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    at = {i: place - i for place, low, high, _ in zip(*anchors(data, offsets, width)) for i in range(low, high + 1)}
    assert set(at) == {int(o) + i for o, t in zip(offsets, texts) for i in range(len(t) - width + 1)}
    assert all(0 <= x <= width - key_bytes(width) for x in at.values())
    places = {}
    for i, x in at.items():
        places.setdefault(data[i: i + width].tobytes(), set()).add(x)
    assert all(len(x) == 1 for x in places.values())


def test_splitters_count_repeats():
    values, times = splitters([b"b"] * 90 + [b"a", b"c"] * 5, 10)
    assert dict(zip(values.tolist(), times.tolist()))[b"b"] >= 8
    assert splitters([], 5)[0].tolist() == []


def _passages(seed, n):
    draw = random.Random(seed)
    common = ["".join(draw.choices("abc de", k=draw.randint(20, 90))) for _ in range(4)]
    out = []
    for i in range(n):
        pieces = [draw.choice(common) if draw.random() < 0.6 else "".join(draw.choices("abcdefgh ", k=draw.randint(1, 60)))
                  for _ in range(draw.randint(0, 6))]
        out.append((draw.choice([None, i, i, i, i % 5]), "".join(pieces)))
    return out + [(3, None), (900, "é" * 60), (901, "é" * 60 + "x"), (902, "q" * 400), (903, "\x00" * 90), (904, "\x00" * 50)]


@pytest.mark.parametrize("seed,part", [(1, 40_000), (2, 12), (3, 3)])
def test_against_brute_force(spark, seed, part):
    """Small parts cut hot buckets, so strings meet across parts too."""
    rows = _passages(seed, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(remove_repeated_bytes(docs, width=20, batch_bytes=1500, part_suffixes=part)) == brute(rows, 20)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    out = remove_repeated_bytes(odd)
    assert rows_of(out) == brute(rows, 100)
    assert out.where("n_removed > 0 and size(spans) = 0").count() == 0
    empty = remove_repeated_bytes(none)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]


def test_text_column_of_another_name(spark):
    docs = spark.createDataFrame([("k" * 150, 2, "x"), ("k" * 150, 1, "y")], "body string, id int, text string")
    out = {r.doc_id: r.n_removed for r in remove_repeated_bytes(docs, "id", "body").collect()}
    assert out == {1: 149, 2: 150}  # all strings of the first but its first one repeat it
    assert remove_repeated_bytes(docs, "id", "body").select(F.sum("n_bytes")).first()[0] == 300
