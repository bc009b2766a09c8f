"""The registered queries over whole tables: SQL where it exists, brute force otherwise."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import compare, connect
from treeline.llm import quality_classifier
from treeline.llm.oracle import ORACLE
from treeline.llm.packing import tokenizer_path
from treeline.llm.queries import QUERIES
from treeline.llm.store import remainder

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BY_NAME = {q.__name__: q for q in QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", sorted(set(ORACLE)))
def test_query_equals_sql(spark, name):
    equal, n, difference = compare(spark, connect(FOLDER), BY_NAME[name], ORACLE[name], FOLDER)
    assert equal and n, difference


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in BY_NAME) == list(range(1, 14))
    assert set(BY_NAME) - set(ORACLE) == {
        "op1_quality_classifier", "op2_brown_lm", "op9_best_fit_packing", "op10_bpe_reuse"}


def test_op1_on_held_out_labels(spark):
    """The small table has few labels; the next one is large enough to be held to a number."""
    folder = "/root/testdata/sf0.1"
    out = BY_NAME["op1_quality_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("quality")).alias("right"),
        F.count_if((F.col("quality") == 0) & (F.col("predicted") == 0)).alias("found"),
        F.count_if(F.col("quality") == 0).alias("bad")).first()
    assert held.n > 1000 and held.right >= 0.99 * held.n and held.found >= 0.95 * held.bad


def test_op2_gains_on_held_out_rows(spark):
    out = BY_NAME["op2_brown_lm"](spark, FOLDER)
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def _tokens(library, text):
    return np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")


def _check_packing(rows, want):
    """Pieces cover the documents, sequences have no gaps, and few more than the bound are used."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.length == min(4096, len(want[i]) - at)
            assert r.ids_crc32 == zlib.crc32(want[i][at: at + r.length])
            at += r.length
        assert at == len(want[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    bound = -(-sum(map(len, want.values())) // 4096)
    assert len(sequences) <= bound + 2 + bound // 20


def test_op9(spark, texts, library):
    _check_packing(BY_NAME["op9_best_fit_packing"](spark, FOLDER).collect(),
                   {i: _tokens(library, t) for i, t in texts.items()})


def test_op10(spark, texts, library):
    for r in BY_NAME["op10_bpe_reuse"](spark, FOLDER).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def _near(kept):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, comp = {}, {i: i for i in kept}
    for i, t in kept.items():
        w = WORD.findall(t.translate(low))
        sets[i] = set(zip(*(w[k:] for k in range(5)))) or ({tuple(w)} if w else set())
    moved = True
    while moved:
        moved = False
        for a in kept:
            for b in kept:
                both = len(sets[a] & sets[b]) if a < b else 0
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    moved = True
    return {i: t for i, t in kept.items() if comp[i] == i}


def test_pipeline(spark, texts, library):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(*quality_classifier.sample(docs, labels, remainder("doc_id", 3) != 1))
    good = {r.doc_id for r in quality_classifier.score(docs, model).where("predicted = 1").collect()}
    kept = {i: t for i, t in texts.items() if i in good}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = _near({i: kept[i] for i in first.values()})
    start = {}
    for i in sorted(kept):
        w = WORD.findall(kept[i])
        for k in range(len(w) - 49):
            start.setdefault(tuple(w[k:k + 50]), i)
    for i in sorted(kept):
        w = WORD.findall(kept[i])
        gone = {q for k in range(len(w) - 49) if start[tuple(w[k:k + 50])] < i for q in range(k, k + 50)}
        if gone:
            kept[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    _check_packing(corpus_pipeline.run(spark, FOLDER).collect(),
                   {i: _tokens(library, t) for i, t in kept.items()})


def test_stages_keep_columns_and_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"),
                      F.length("text").cast("long").alias("n_chars"))
    labels = odd.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 7 in left and 9 not in left and 8 not in left and 21 not in left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
