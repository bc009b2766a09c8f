"""Quality rules and licence scans: built-in functions only, against brute force."""

import re
import time

import pytest
from pyspark.sql import functions as F

from treeline.llm import licenses, quality_rules
from treeline.llm.quality_rules import Rule, cascade, default_rules, in_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plan(df):
    return df._jdf.queryExecution().toString()


def _counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = {}
    for k in range(len(w) - 7):
        windows.setdefault(tuple(w[k:k + 8]), []).append(k)
    covered = {q for at in windows.values() if len(at) > 1 for k in at for q in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, r = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r,
            n < 20 or 100 * r > 30 * n)


def test_counts(odd, none):
    out = cascade(odd)
    got = sorted((repr(r.doc_id), tuple(r[1:7])) for r in out.collect())
    want = sorted((repr(r.doc_id), _counts(r.text)) for r in odd.select("doc_id", "text").collect())
    assert got == want
    assert out.where("kept and base_failed").count() == 0
    assert not re.search("Python|Pandas|Arrow", _plan(out))
    assert cascade(none).count() == 0


@pytest.mark.parametrize("condition", ["kept", "not kept", "base_failed", "rejected_by = 'symbols'", "n_words > 3900",
                                       "word_chars > 9", "n_symbols = 0", "n_dup_lines > 0", "n_repeat_words > 7"])
def test_filters_end(spark, condition):
    """A text of 4,000 words under a filter on each column: seconds, not hours."""
    long = " ".join(f"w{i % 997}" for i in range(4000))
    docs = spark.createDataFrame([(1, long), (2, "w " * 4000), (3, "# " * 50)], "doc_id bigint, text string")
    out = cascade(docs)
    want = [r.doc_id for r in out.withColumn("hit", F.expr(condition)).collect() if r.hit]
    began = time.perf_counter()
    assert sorted(r.doc_id for r in out.where(condition).collect()) == sorted(want)
    assert time.perf_counter() - began < 20


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 9) if i else "x" * 9000) for i in range(300)],
                                 "doc_id bigint, text string").repartition(5)
    sample = quality_rules._sample(docs, "text", 20, 20 * 1000)
    assert sample.count() == 20 and sample.where("length(text) > 1000").count() == 0
    assert "Exchange" not in _plan(sample) and "ExistingRDD" not in _plan(sample)


def test_order_changes_no_verdict(odd):
    rules = default_rules()
    kept = {repr(r) for r in cascade(odd, rules).select("doc_id", "n_words", "kept").collect()}
    assert kept == {repr(r) for r in cascade(odd, rules[::-1]).select("doc_id", "n_words", "kept").collect()}


def test_rules_are_ordered_by_rejection(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    never, null = Rule("never", F.lit(False)), Rule("null", F.lit(None).cast("boolean"))
    always = Rule("always", F.col("n_words") >= 0)
    assert [r.name for r in in_order(docs, [never, null, always])][0] == "always"


def test_license_scan(odd, none):
    out = licenses.scan(odd)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count()
    assert (rows[23].license, rows[23].notices, rows[23].n_notices) == ("MIT", "MIT", 1)
    assert all(r.license is None and r.notices == "" for i, r in rows.items() if i != 23)
    assert not re.search("Python|Pandas|ArrowEval", _plan(out))
    assert licenses.scan(none).count() == 0


def test_equivalent_forms_of_a_license_are_one(spark):
    mit = dict((n, t) for n, t in licenses.KNOWN[:1])["MIT"]
    forms = [mit, mit.upper(), mit.replace("\n\n", "\n\nCopyright (c) 1999 Somebody\nAll rights reserved.\n\n"),
             mit.replace("License", "Licence").replace(",", " ,"), "  ".join(mit.split()), mit + " More."]
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string")
    assert [r.license for r in licenses.scan(docs).orderBy("doc_id").collect()] == ["MIT"] * 5 + [None]
