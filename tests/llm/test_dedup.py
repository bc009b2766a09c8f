"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import exact_dedup, near_dedup, stages, substring_dedup
from treeline.llm.exact_dedup import exact_groups
from treeline.llm.graph import components
from treeline.llm.near_dedup import near_groups
from treeline.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_groups(odd):
    rows = pairs_of(odd)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(ids), keep is None or i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_groups(odd, chunk_bytes=64).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_chunks_with_one_identifier_are_told_apart(spark):
    rows = [(1, "s1", [7, 8], [b"a", b"b"]), (2, "s2", [7, 8], [b"c", b"b"]), (3, "s1", [7, 8], [b"a", b"b"])]
    of = spark.createDataFrame(rows, "doc_id bigint, text_sha256 string, chunks array<bigint>, digests array<binary>")
    table = exact_dedup.chunk_table(of)
    assert {r.chunk: r.verified for r in table.collect()} == {7: False, 8: True}
    ids = {r.doc_id: r.ids for r in exact_dedup.identified(of, table).collect()}
    assert ids[1] == ids[3] != ids[2] and ids[1][1] == ids[2][1] == 8


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(odd, width):
    sets = {}
    for i, t in pairs_of(odd):
        w = WORD.findall(lower(t))
        sets[i] = (frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width
                   else frozenset([tuple(w)] if w else []))
    comp = {i: i for i in sets if i is not None}
    moved = True
    while moved:
        moved = False
        for a in comp:
            for b in comp:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    moved = True
    got = near_groups(odd, width=width, block=2).where("doc_id is not null").collect()
    assert len(got) == len([1 for i, _ in pairs_of(odd) if i is not None])
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_near_copies_of_one_text_without_listing_pairs(spark):
    """A large group in which many pairs are just below the threshold."""
    import random

    draw, base = random.Random(5), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(draw.randint(1, 9)):
            w[draw.randrange(120)] = f"e{draw.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    comp = list(range(150))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_groups(docs, width=2, block=16).collect()}
    assert got == {i: root(i) for i in range(150)}


def test_remove_repeats(odd):
    rows = sorted(((i, t) for i, t in pairs_of(odd) if i is not None), key=lambda r: r[0])
    first, want = {}, []
    for width in (50,):
        for i, t in rows:
            w = WORD.findall(t or "")
            for k in range(len(w) - width + 1):
                first.setdefault(tuple(w[k:k + width]), i)
        for i, t in rows:
            w = WORD.findall(t or "")
            gone = set()
            for k in range(len(w) - width + 1):
                if first[tuple(w[k:k + width])] < i:
                    gone.update(range(k, k + width))
            want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for batch_bytes in (1 << 24, 3000):
        out = remove_repeats(odd, batch_bytes=batch_bytes).where("doc_id is not null")
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
        assert sorted(got) == sorted(want)
        assert all(sum(s["past"] - s["first"] for s in r.spans) == r.n_removed for r in out.collect())


def test_empty_tables(none):
    assert exact_groups(none).count() == 0
    assert near_groups(none).count() == 0
    assert remove_repeats(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 4), (6, 5), (7, 6), (8, 7), (9, 9), (20, 30), (30, 40), (40, 10)]
    got = {r.hi: r.lo for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {2: 1, 3: 1, 5: 4, 6: 4, 7: 4, 8: 4, 20: 10, 30: 10, 40: 10}


def test_shingles_of_short_texts_differ_by_length():
    import pyarrow as pa

    hashes, doc = near_dedup.shingles(pa.array(["a", "a b", "A b", None, "b a"]), 5)
    assert doc.tolist() == [0, 1, 2, 4] and len(set(hashes.tolist())) == 3


def test_hot_lookup_equals_join(spark):
    from treeline.llm.store import lookup

    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k <> 3")
    got = lookup(rows, table, ["k"], "n", 2000, 4)
    want = rows.join(table, "k", "left")
    assert sorted(got.select("id", "least").collect()) == sorted(want.select("id", "least").collect())


def test_stages_decide_per_row(spark):
    """Equal and missing ids: one row of each text stays, and no text that differs goes with another."""
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (1, other), (2, long), (None, other), (None, "no id"), (None, "no id"), (3, other + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars int, row string")
    exact = stages.exact_dedup(spark, docs, "")
    assert exact.columns == docs.columns
    key = lambda r: (repr(r[0]), r[1])
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=key) == sorted(
        [(1, long), (1, other), (None, "no id"), (3, other + " more")], key=key)
    near = stages.near_dedup(spark, exact, "")
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=key) == sorted(
        [(1, long), (1, other), (None, "no id")], key=key)
    plain = docs.where("doc_id in (2, 3)")
    assert stages.with_own_ids(plain)[1] == "doc_id" and stages.near_dedup(spark, plain, "").count() == 2


@pytest.mark.parametrize("homes", [0, 256])
def test_homes_one_by_one_or_as_a_row(spark, monkeypatch, homes):
    """Near copies of several texts that share a passage: the same components either way."""
    monkeypatch.setattr(near_dedup, "HOMES", homes)
    draw = random.Random(8)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for g in range(12):
        base = shared + [f"g{g}_{i}" for i in range(20 + 3 * g)]
        for c in range(6):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"x{draw.random()}"
            rows.append((10 * g + c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, width=2, block=3).collect()}
    sets = {i: {tuple(t.split()[k:k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {i: root(i) for i in sets}


def _one_batch(n_texts, n_words, seed=3):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, n_words)) for _ in range(n_texts)]
    for i in range(0, n_texts - 7, 7):
        texts[i + 7] = texts[i][: len(texts[i]) // 2] + " " + texts[i + 7]
    left = pa.table({"doc_id": pa.array(np.arange(n_texts)[::-1].copy(), pa.int64()), "text": texts[::-1]})
    right = pa.table({"batch": pa.array([0], pa.int32()), "hashes": pa.array(
        [substring_dedup._windows(pa.array(texts[3:4]), 50)[0].tobytes()], pa.binary())})
    return left, right


def test_a_batch_of_many_blocks_is_one_batch(monkeypatch):
    left, right = _one_batch(60, 130)
    whole = substring_dedup._apply(50, ["text"])(left, right)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(substring_dedup, "_AT_ONCE", 64)
    assert substring_dedup._apply(50, ["text"])(left, right).to_pylist() == whole.to_pylist()
    removed = dict(zip(whole["doc_id"].to_pylist(), whole["n_removed"].to_pylist()))
    assert removed[3] == 130 and removed[7] > 50 and removed[0] == 0


def test_what_a_batch_holds_is_a_few_times_its_text():
    left, right = _one_batch(2_000, 1_200)
    size = sum(len(x) for x in left["text"].to_pylist())
    tracemalloc.start()
    try:
        substring_dedup._apply(50, [])(left, right)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size > 4_000_000 and held < 10 * size, held / size
