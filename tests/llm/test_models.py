"""The classifier by held-out accuracy, the language model against a plain unigram count."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import brown_lm, quality_classifier
from treeline.llm.store import remainder

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_classifier_on_held_out_rows(spark):
    rows = [(i, prose(i, 60) if i % 3 else " | ".join(prose(i, 60).upper().split()), int(i % 3 > 0))
            for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    texts, labels = quality_classifier.sample(docs, docs, remainder("doc_id", 3) != 1)
    assert set(labels) == {0, 1} and len(texts) < 240
    model = quality_classifier.fit(texts, labels)
    out = quality_classifier.score(docs, model).join(docs, "doc_id").where(remainder("doc_id", 3) == 1)
    assert out.where("predicted <> quality").count() == 0
    assert out.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def test_classifier_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100, i % 2) for i in range(50)], "doc_id bigint, text string, quality int")
    assert len(quality_classifier.sample(docs, docs, F.lit(True), rows=10)[0]) == 10
    assert len(quality_classifier.sample(docs, docs, F.lit(True), most_bytes=700)[0]) == 7


def test_classifier_with_odd_rows_and_one_label(odd, none):
    model = quality_classifier.fit(["a b c", "D | E"] * 20, [1, 0] * 20)
    out = quality_classifier.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.score(none, model).count() == 0
    assert quality_classifier.keep_good(odd, model).columns == odd.columns
    assert quality_classifier.fit(["a"], [1]).bias > 0 > quality_classifier.fit(["a"], [0]).bias
    assert quality_classifier.fit([], []).bias == 0


def _base(rows, of):
    lists = [(i, [w.encode() for w in WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))] + [None])
             for i, t in rows]
    c = Counter()
    for i, w in lists:
        if i is None or zlib.crc32(str(i).encode()) % of:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [(i, len(w), sum(c[x] > 0 for x in w), n,
             sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in lists]


def test_language_model_base_scores(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted(_base(rows, 10), key=repr)
    for batch_bytes in (1 << 24, 3000):
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                      for r in brown_lm.score(odd, batch_bytes=batch_bytes).collect()), key=repr)
        assert [x[:4] for x in got] == [x[:4] for x in want]
        assert np.allclose([x[4] for x in got], [x[4] for x in want])
    assert brown_lm.score(none).count() == 0


def test_language_model_gains_on_held_out_rows(spark):
    """Words of two kinds that follow each other: classes find the order, unigrams cannot."""
    import random

    draw = random.Random(3)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{draw.randrange(30)}" for k in range(80))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = brown_lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    # At best log(30) against log(60) a word, which is 0.83.
    assert held[0] > 0.87 * held[1]


def test_model_probabilities_add_up():
    n = np.array([[0, 5, 1, 0], [4, 0, 0, 2], [1, 0, 0, 0], [1, 1, 0, 0]])
    cls = brown_lm.exchange(n, 2, 5)
    assert cls[-1] == 2
    model = brown_lm._estimate(np.zeros(0, np.uint64), cls, n, np.ones(3), np.ones(3), 10, 3, 1)
    assert np.allclose((10.0 ** model.transition).sum(1), 1)


def test_unseen_words_score_below_rare_known_ones(spark):
    """Held-out texts of words that training has once each, and of junk words with their endings."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 10]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in ids]
    clean = [(i, " ".join(f"w{ids[j * 5 + k % 5]}x{k}" for k in range(40))) for j, i in enumerate(held)]
    junk = [(i, t.replace("w", "zq")) for i, t in clean]
    scores = []
    for texts in (clean, junk):
        docs = spark.createDataFrame(rows + texts, "doc_id bigint, text string")
        scores.append({r.doc_id: r.score for r in brown_lm.score(docs).where("held_out").collect()})
    assert len(scores[0]) == len(held) > 20
    assert all(scores[1][i] < scores[0][i] for i in held)


def test_classifier_sample_skips_only_what_does_not_fit(spark):
    rows = [(i, "x" * (5000 if i < 6 else 100), i % 2) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    for most_bytes in (4400, 1000):
        texts, labels = quality_classifier.sample(docs, docs, F.lit(True), most_bytes=most_bytes)
        assert [len(t) for t in texts] == [100] * (most_bytes // 100)
        assert sum(labels) == most_bytes // 200
    assert quality_classifier.fitting([(1, 9), (1, 4), (0, 20), (1, 5)], 10) == [1, 3]


def _alternating(spark):
    """Words of two kinds that follow each other, with one ending."""
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{draw.integers(30)}zzz" for k in range(80))) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


@pytest.mark.parametrize("bucket_bytes", [1 << 23, 40_000])
def test_every_word_chooses_its_class(spark, monkeypatch, bucket_bytes):
    """Two words move on the driver, the others in one bucket, where none could do better at the end, or in three."""
    found, run = [], brown_lm._exchanged

    def kept(entries, vocabulary, *rest):
        found.append((run(entries, vocabulary, *rest), vocabulary))
        return found[0][0]

    monkeypatch.setattr(brown_lm, "_exchanged", kept)
    monkeypatch.setattr(brown_lm, "PATIENCE", 3)
    docs, rows = _alternating(spark)
    out = brown_lm.score(docs, core=2, n_classes=8, batch_bytes=30_000, bucket_bytes=bucket_bytes)
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.87 * held[1]
    ((value, table, lost), vocabulary), = found
    pairs = [(h, v) for r in value.join(vocabulary, "bucket").collect() for h, v in zip(
        np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.value, np.uint16) & brown_lm._CLASS)]
    assert len(pairs) == 60 and len(value.collect()) == (1 if bucket_bytes > 1 << 20 else 3)
    place = {h: i for i, (h, _) in enumerate(pairs)}
    cls = np.array([int(v) for _, v in pairs])
    n = np.zeros((61, 61))
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            at = [60, *(place[h] for h in brown_lm.tokens(pa.array([text]))[0]), 60]
            np.add.at(n, (at[:-1], at[1:]), 1)
    hot = np.eye(9)[np.append(cls, 8)]
    assert (hot.T @ n @ hot == table).all()
    part = n / n.sum(1, keepdims=True)
    part[60] = 0
    other = n / n.sum(0)
    other[:, 60] = 0
    assert np.allclose(hot.T @ (part + other) @ hot, lost, atol=0.01)
    same = n.diagonal()[:60]
    n[range(60), range(60)] = 0
    gains = brown_lm.gains(cls, (n @ hot)[:60], (n.T @ hot)[:60], same, table)
    assert bucket_bytes < 1 << 20 or (gains.max(1) <= gains[range(60), cls] + 1e-6).all()


def test_gains_equal_those_of_the_whole_table():
    draw = np.random.default_rng(1)
    n_words, k = 30, 4
    seq = np.concatenate([[*(draw.zipf(1.4, draw.integers(0, 30)) % n_words), n_words] for _ in range(40)])
    cls, n = draw.integers(0, k, n_words), np.zeros((n_words + 1, n_words + 1))
    np.add.at(n, (np.concatenate(([n_words], seq[:-1])), seq), 1)

    def bigrams(cls):
        hot = np.eye(k + 1)[np.append(cls, k)]
        return hot.T @ n @ hot

    table, hot, same = bigrams(cls), np.eye(k + 1)[np.append(cls, k)], n.diagonal()[:-1]
    apart = n - np.diag(n.diagonal() * (np.arange(n_words + 1) < n_words))
    got = brown_lm.gains(cls, (apart @ hot)[:-1], (apart.T @ hot)[:-1], same, table)
    assert same.any()
    for w in range(n_words):
        for b in range(k):
            moved = cls.copy()
            moved[w] = b
            change = brown_lm.likelihood(bigrams(moved)) - brown_lm.likelihood(table)
            assert np.isclose(got[w, b] - got[w, cls[w]], change, atol=1e-8)


def test_steps_into_and_out_of_unseen_words_add_up():
    """An unseen word is in the classes by the shares that they have of its suffix group."""
    n = np.array([[3, 5, 1], [4, 0, 2], [2, 1, 0]])
    words_of = np.zeros((3, brown_lm.GROUPS))
    words_of[:2, 7] = 1, 3
    words_of[0, 9] = 4
    model = brown_lm._estimate(None, np.arange(3), n, n.sum(0), words_of, 18, 9, 3)
    step, whole = 10.0 ** model.transition, 10.0 ** brown_lm._with_unseen(model)
    assert np.allclose(whole[:3, :3], step) and np.allclose(whole[:, :3].sum(1), 1)
    emission = brown_lm.UNSEEN / (n.sum(0) + brown_lm.UNSEEN)
    assert np.allclose(whole[1, 3 + 7], step[1, :2] @ (emission[:2] * [0.25, 0.75]))
    assert np.allclose(whole[3 + 9, :3], step[0])
    assert np.allclose(whole[3 + 20, :3], [0.625, 0.375, 0] @ step)
