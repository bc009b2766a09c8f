"""Quality rules as a short-circuit cascade of built-in functions.

Counts that every row reports come first. The rules then stand in one CASE expression, so a
text that one rule rejects is not looked at by the next. Their order is measured: each
rule's cost is the time it takes over a sample beyond that of an empty job, its selectivity the share it rejects there,
and the rule with the highest rejection per cost goes first. The order changes the cost
only, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.store import pieces

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
SAMPLE_ROWS = 500
SAMPLE_BYTES = 8 << 20
TIMED_ROWS = 20_000
FEWEST_WORDS = 20
MOST_REPEATED = 30


@dataclass(frozen=True)
class Rule:
    """A condition on text, words, lines and the counts that rejects a text; null never does."""
    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    worded = F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 60 * F.size("lines")),
        Rule("capitals", 2 * capitals > letters),
        Rule("few_letters", 10 * worded < 6 * F.col("n_words")),
    ]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds words, lines (with a word), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text has no words. Word windows are compared by 64-bit hashes within one text;
    positions are looked up only where some window occurs twice. docs has no columns of these
    names.
    """
    rows = docs.withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumns({
        "words": F.array_remove(F.split("text", SPACE), ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"),
    })
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "_hashes": F.transform("words", lambda w: F.xxhash64(w)),
    })
    last = F.size("_hashes") - WINDOW
    rows = rows.withColumn("_windows", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(twice, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    rows = rows.withColumn("_at", F.sort_array(F.transform(F.filter(
        "_sorted", lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]).eqNullSafe(True)
        | (x["h"] == F.get("_sorted", i + 1)["h"]).eqNullSafe(True)), lambda x: x["at"])))
    steps = F.transform("_at", lambda a, i: F.least(F.lit(WINDOW), F.coalesce(
        F.get("_at", i + 1) - a, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    # A generator ends the plan: a filter on a count stays above it. Pushed below, it would repeat
    # the arrays inside the lambdas that index them, and compute them again for each element.
    counts = F.struct("words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    kept = [c for c in docs.columns if c != "text"]
    return rows.select(*kept, "text", F.explode(F.array(counts)).alias("_counts")).select(
        *kept, "text", "_counts.*")


def _sample(docs: DataFrame, text_col: str, rows: int, most_bytes: int) -> DataFrame:
    """The first texts of at most most_bytes / rows bytes, as literals.

    take() reads as few partitions as hold that many rows, so no task sends texts to another.
    """
    short = docs.select(F.col(text_col).alias("text")).where(
        F.octet_length(F.coalesce(text_col, F.lit(""))) <= most_bytes // max(rows, 1))
    texts = [r["text"] or "" for r in short.take(rows)]
    return docs.sparkSession.range(1 if texts else 0).select(F.explode(F.lit(texts or [""])).alias("text"))


def _seconds(rows: DataFrame, *columns: Column) -> float:
    """The shorter of two runs, so that compiling does not count."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        rows.select(*columns).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return min(took)


def in_order(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
             sample_bytes: int = SAMPLE_BYTES, timed_rows: int = TIMED_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample of at most `sample_rows` rows and `sample_bytes`.

    Each rule runs over about `timed_rows` rows, the sample repeated; the time of a run without rules is
    taken off, so that starting a job does not count. The sample only orders the rules;
    ties and rules that reject nothing keep their order.
    """
    sample = measured(_sample(docs, text_col, sample_rows, sample_bytes)).persist()
    try:
        found = sample.agg(F.count("*").alias("n"), *(
            F.count_if(F.coalesce(r.rejects, F.lit(False))).alias(r.name) for r in rules)).first()
        if not found["n"]:
            return list(rules)
        times = pieces(timed_rows, found["n"])
        many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        empty = _seconds(many, F.col("copy"))
        rates = [(found[r.name] or 0) / max(_seconds(many, F.col("copy"), r.rejects.alias("x")) - empty, 1e-3)
                 for r in rules]
    finally:
        sample.unpersist()
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -rates[i])]


def cascade(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
            text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts of `measured`, base_failed, kept and rejected_by of each row.

    base_failed: fewer than 20 words, or more than 30 of 100 words in repeated windows.
    rejected_by names the first rule, in the order of this run, that rejects a text. A null
    or empty text has no words and fails. Repeated rows get equal rows, an empty table an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = in_order(rows, rules if rules is not None else default_rules(), "text", sample_rows)
    failed = (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = F.when(F.col("base_failed"), "base")
    for rule in ordered:
        verdict = verdict.when(rule.rejects, rule.name)
    out = measured(rows).withColumn("base_failed", failed).withColumn("rejected_by", verdict)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
