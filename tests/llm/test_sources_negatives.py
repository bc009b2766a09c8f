"""Divergence of sources and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import divergence, hard_negatives
from treeline.llm.divergence import audit
from treeline.llm.hard_negatives import mine, products

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(docs, min_df, top):
    found = [(a or "", b or "", TERM.findall((t or "").translate(_AZ))) for a, b, t in docs]
    out = []
    for lang in {x[0] for x in found}:
        df = Counter(t for a, _, ws in found if a == lang for t in set(ws))
        kept = sorted(t for t, n in df.items() if n >= min_df)
        counts = {s: Counter() for a, s, _ in found if a == lang}
        for a, s, ws in found:
            if a == lang:
                counts[s].update(w for w in ws if df[w] >= min_df)
        every = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, t) - share(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            words = [(t, share(c, t) - share(every, t)) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, rows, most in (("pair", pairs, None), ("term", words, top)):
                rows = sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(rows)]
    return sorted(out)


def _docs(seed):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "ÄÖ", "straße", "x1y", "中文", "it's", "tail", "\U0001F600", "ALPHA"]
    return [(draw.choice(["en", "de", None, "xx"]), draw.choice(["a", "b", "", None, "é", "zz"]),
             draw.choice([None, "", " ".join(draw.choices(words, k=draw.randint(0, 12)))])) for _ in range(150)] + [
        ("one", "only", "lonely"), ("two", "p", "1 2 3"), ("two", "q", None)]


@pytest.mark.parametrize("slice_terms", [2_000_000, 3])
def test_audit_equals_brute_force(spark, slice_terms):
    docs = _docs(5)
    df = spark.createDataFrame([(*d, "c", 1) for d in docs],
                               "lang string, source string, text string, item string, n int").repartition(3)
    got = sorted(tuple(r) for r in audit(df, min_df=8, top=3, slice_terms=slice_terms).collect())
    assert got == brute_audit(docs, 8, 3)
    assert {r[0] for r in got if r[4] == 0} >= {"two"}


def test_audit_in_blocks_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 4)
    docs = _docs(6)
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(2)
    assert sorted(tuple(r) for r in audit(df, min_df=5, top=50).collect()) == brute_audit(docs, 5, 50)


def test_audit_of_little(spark):
    shape = "lang string, source string, text string"
    empty = audit(spark.createDataFrame([], shape))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    few = audit(spark.createDataFrame([("en", "a", "w"), ("en", "b", None)], shape))
    assert sorted(tuple(r) for r in few.collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_sums_are_sent_when_many(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 1)
    vector = pa.array([{"indices": [0, 2], "values": [1.0, 3.0]}, {"indices": [2], "values": [2.0]},
                       {"indices": [], "values": []}],
                      pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([9, -4, 9]), vector], ["group", "vector"])
    out = [r for b in divergence._sums(iter([batch, batch])) for r in b.to_pylist()]
    assert sorted((r["group"], r["term"], r["n"]) for r in out) == [(-4, 2, 2)] * 2 + [(9, 0, 1)] * 2 + [(9, 2, 3)] * 2


def test_sums_of_several_batches_are_one():
    vector = pa.array([{"indices": [1], "values": [1.0]}] * 2,
                      pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    batches = [pa.RecordBatch.from_arrays([pa.array(g), vector], ["group", "vector"]) for g in ([5, 7], [6, 5], [7, -1])]
    out = [r for b in divergence._sums(iter(batches)) for r in b.to_pylist()]
    assert [(r["group"], r["n"]) for r in out] == [(-1, 1), (5, 2), (6, 1), (7, 2)]


def test_large_counts_are_exact(spark):
    row = spark.range(1).select(*(divergence._share(
        F.lit(n).cast("long"), F.lit(t).cast("long"), F.lit(3).cast("long"), True) for n, t in (
            (4 * 10**12, 10**13), (7, 10**13))))
    assert list(row.first()) == [1 + 10**9 * (n + 5) // (10**13 + 15) for n in (4 * 10**12, 7)]


def brute_mine(rows, is_anchor, low=30, high=90, positives=5, negatives=10):
    whole = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * x) for x in v])
        whole[i] = min(whole.get(i, own), own)
    out = []
    for a, (label, q) in whole.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, other) for i, (other, p) in whole.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, i, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)]
    return sorted(out)


def _vectors(seed, n):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([0.5, -0.25, 0.0, 1.0, draw.gauss(0, 1)]) for _ in range(6)], draw.randint(0, 3))
            for i in range(n)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(n, n + 30)]
    return rows + [(None, [1.0] * 6, 1), (n + 50, None, 1), (n + 51, [1.0] * 6, None), (n + 52, [float("nan")] * 6, 1),
                   (n + 53, [float("inf")] * 6, 1), (n + 54, [None, 1.0], 1), (n + 55, [], 1), (n + 60, [1.0, 1.0], 2),
                   (5, [9.0] * 6, 3), (5, [9.0] * 6, 3)]


@pytest.mark.parametrize("blocks", [(8192, 32768), (17, 4)])
def test_mining_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ROWS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[1])
    rows = _vectors(2, 150)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows],
                               "vec_id int, embedding array<double>, label int, score int, anchor int").repartition(3)
    got = sorted(tuple(r) for r in mine(df, F.col("id") % 10 == 0).collect())
    assert got and got == brute_mine(rows, lambda i: i % 10 == 0)


def test_mining_of_little(spark):
    shape = "vec_id bigint, embedding array<float>, label int"
    empty = mine(spark.createDataFrame([], shape), F.lit(True))
    assert empty.count() == 0 and empty.columns[0] == "anchor_id"
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], shape)
    assert mine(alone, F.lit(True)).count() == 0


def test_products_are_exact_or_held_at_the_ends():
    big = np.array([[1 << 40, 1], [3, 1 << 31]])
    assert products(big, big).tolist() == [[(1 << 63) - 1, 3 * (1 << 40) + (1 << 31)],
                                           [3 * (1 << 40) + (1 << 31), 9 + (1 << 62)]]
