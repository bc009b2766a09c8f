"""How the sources of a language differ in their words, in exact integers.

Terms carry the language of their document, so one CountVectorizer with a whole number as
minDF holds the vocabulary of a vectorizer for each language, in one pass however many
languages there are. Its model turns documents into sparse count vectors. Vectors are summed
for each (lang, source) as sparse entries: within a task first, then by Spark. Pairs of
sources are compared in blocks of terms; an entry that is absent counts as zero there.

The vocabulary of a CountVectorizer passes through the driver and goes to every task, so
its size is held to `slice_terms`. A vocabulary that reaches it may be cut; then
the terms are dealt into slices by hash, each with a vectorizer, until no vocabulary reaches it. So
the size never cuts a vocabulary that is used, as the largest integer would not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.store import stored
from treeline.llm.words import buffer, release, slices, words

MIN_DF = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
#: Terms that the vocabulary of one vectorizer may have, some 100 bytes each on the driver.
SLICE_TERMS = 1_000_000
#: Sums that a task holds before it sends them on, and entries of a block of terms and sources.
HELD = 1 << 18
BLOCK_CELLS = 1 << 18
_MARK = "\x00"
#: Terms are runs of A-Z, a-z and all beyond ASCII, A-Z in lower case; other bytes are spaces here.
_TERM_BYTES = np.full(256, 0x20, np.uint8)
_TERM_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM_BYTES[0x80:] = np.arange(0x80, 0x100)


def _terms(once: bool):
    """The terms of each text, every one after its lang and a character that no term has.

    With `once`, each term of a text one time: that is all a vocabulary needs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 1 << 20):
                data, offsets = buffer(part.column("text"))
                data = _TERM_BYTES[data]
                starts, ends, counts = words(data, offsets)
                past = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
                kept = np.ascontiguousarray(data[data != 0x20])
                found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(past), pa.py_buffer(kept))
                doc = np.repeat(np.arange(part.num_rows), np.diff(counts))
                if once:
                    coded = found.dictionary_encode()
                    pair = np.unique(doc * len(coded.dictionary) + np.asarray(coded.indices))
                    doc, term = np.divmod(pair, max(len(coded.dictionary), 1))
                    found = coded.dictionary.take(pa.array(term))
                    counts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows))))
                found = pc.binary_join_element_wise(part.column("lang").take(pa.array(doc)), found, _MARK)
                yield pa.RecordBatch.from_arrays(
                    [part.column("group"), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), found)],
                    ["group", "found"])
        release()
    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sparse vectors by group: rows of group, term number and count."""
    names, keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(names[keys >> 32], pa.int64()), pa.array(keys & 0xFFFFFFFF, pa.int64()),
            pa.array(counts, pa.int64())], ["group", "term", "n"])

    for batch in batches:
        lists = batch.column("vector").field("indices")
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        at = np.asarray(pc.list_flatten(lists)).astype(np.int64)
        n = np.asarray(pc.list_flatten(batch.column("vector").field("values"))).astype(np.int64)
        group = np.asarray(batch.column("group"))
        every = np.union1d(names, group)
        keys = np.searchsorted(every, names)[keys >> 32] << 32 | keys & 0xFFFFFFFF if len(keys) else keys
        names = every
        own = np.repeat(np.searchsorted(names, group), size) << 32 | at
        keys, where = np.unique(np.concatenate([keys, own]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > HELD:
            yield out()
            names, keys, counts = names[:0], keys[:0], counts[:0]
            release()
    if len(keys):
        yield out()


def _in_slice(k: int, n: int):
    return lambda term: F.pmod(F.xxhash64(term), F.lit(n)) == k


def term_counts(docs: DataFrame, min_df: int, slice_terms: int) -> tuple[DataFrame, DataFrame]:
    """(group, term, n), how often a kept term occurs in a group, where it does, and (term, item).

    docs: group, lang, text without nulls. The same term of two langs has two numbers.
    """
    spark = docs.sparkSession
    shape = "group bigint, found array<string>"
    once, every = (docs.mapInArrow(_terms(x), shape) for x in (True, False))
    # Rows of a term that none of the documents has: a vocabulary must not be empty.
    marks = spark.range(min_df).select(F.array(F.lit(_MARK)).alias("found"))
    models, n = [], 1
    while not models:
        for k in range(n):
            known, part = (x if n == 1 else x.withColumn("found", F.filter("found", _in_slice(k, n)))
                           for x in (once, every))
            model = CountVectorizer(inputCol="found", outputCol="vector", minDF=float(min_df),
                                    vocabSize=slice_terms + 1).fit(known.select("found").union(marks))
            models.append((part, model, model.vocabulary))
            if len(models[-1][2]) > slice_terms:
                models, n = [], 2 * n
                break
    counts = spark.createDataFrame([], "group bigint, term bigint, n bigint")
    names = spark.createDataFrame([], "term bigint, item string")
    for k, (part, model, vocabulary) in enumerate(models):
        sums = model.transform(part).select("group", "vector").mapInArrow(_sums, "group bigint, term bigint, n bigint")
        first = k * (slice_terms + 1)
        counts = counts.unionByName(sums.groupBy("group", "term").agg(F.sum("n").alias("n")).withColumn(
            "term", F.col("term") + first))
        names = names.unionByName(spark.createDataFrame(pa.table({
            "term": pa.array(range(first, first + len(vocabulary)), pa.int64()),
            "item": pa.array([t.partition(_MARK)[2] for t in vocabulary], pa.string())})))
    return stored(counts, "term_counts"), stored(names, "terms")


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with `group`, a number of (lang, source), and (group, lang, source) of all groups."""
    seed, found = 0, stored(rows.select("lang", "source").distinct(), "sources")
    while True:
        number = F.xxhash64("lang", "source", F.lit(seed))
        groups = found.withColumn("group", number)
        n = groups.agg(F.count("*").alias("n"), F.count_distinct("group").alias("d")).first()
        if n["n"] == n["d"]:  # else two groups share a number, and another hash is taken
            return rows.withColumn("group", number), groups
        seed += 1


def _share(n: Column, total: Column, kept: Column, large: bool) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * kept)), without rounding."""
    if not large:
        return F.call_function("div", (n + SMOOTH) * UNIT, total + kept * SMOOTH) + 1
    top = (n.cast("decimal(19,0)") + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)")
    below = total.cast("decimal(19,0)") + kept.cast("decimal(19,0)") * SMOOTH
    return F.call_function("div", top.cast("decimal(38,0)"), below.cast("decimal(38,0)")) + 1


def _compared(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of one block, for every pair of sources of one lang."""
    sources = sorted(set(groups.column("source").to_pylist()))
    number = {s: i for i, s in enumerate(sources)}
    lang = groups.column("lang")[0].as_py() if groups.num_rows else None
    zero = np.zeros(len(sources), np.int64)
    zero[[number[s] for s in groups.column("source").to_pylist()]] = np.asarray(
        pc.fill_null(groups.column("p"), 0)).astype(np.int64)
    items = pc.dictionary_encode(entries.column("term")).combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    shares = np.repeat(zero[:, None], len(items.dictionary), axis=1)
    if entries.num_rows:
        rows = [number[s] for s in entries.column("source").to_pylist()]
        shares[rows, np.asarray(items.indices)] = np.asarray(entries.column("p"))
    one, two, total = [], [], []
    for i in range(len(sources) - 1):
        total.append(np.abs(shares[i + 1:] - shares[i]).sum(axis=1))
        one += [sources[i]] * (len(sources) - 1 - i)
        two += sources[i + 1:]
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "a": pa.array(one, pa.string()),
                     "b": pa.array(two, pa.string()),
                     "f": pa.array(np.concatenate(total) if total else [], pa.int64())})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_df: int = MIN_DF, top: int = TOP, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    A lang keeps the terms of at least `min_df` of its documents. A group, each (lang, source)
    that occurs and each lang, gives a kept term the share
    p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N its count of kept terms, V their number.
    Part `pair`: item is another source of the lang, value the sum of |p - q| over all kept
    terms. Part `term`: item is a kept term that the group has more often than its lang
    (p > q), value p - q, the `top` largest. rank counts from 1 by value descending, then
    item ascending in UTF-8.

    Null texts, langs and sources are empty strings. A lang without kept terms has pairs of
    value 0 and no terms; an empty table gives an empty result. Repeated rows are documents
    of their own; other columns are not read.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    rows, groups = _grouped(rows)
    counts, names = term_counts(rows.select("group", "lang", "text"), min_df, slice_terms)
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    # A term has one lang, so its sum over the groups is that of the lang.
    of_lang = counts.groupBy("term").agg(F.sum("n").alias("lang_n"), F.min("group").alias("group"))
    kept = of_lang.join(groups, "group").groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = stored(groups.join(totals, "group", "left").join(kept, "lang", "left").na.fill(
        0, ["total", "kept", "lang_total"]), "groups")
    most = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("lang_total").alias("t")).agg(
        F.max("s").alias("s"), F.max("t").alias("t")).first()
    large = (most["t"] or 0) > 9_000_000_000 - SMOOTH  # beyond it the product leaves the range of a long
    shares = counts.join(groups, "group").withColumn(
        "p", _share(F.col("n"), F.col("total"), F.col("kept"), large))

    # Parts of the result end in the same columns.
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    final = ["lang", "source", "part", "item", "value", "rank"]
    general = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), large)
    more = shares.join(of_lang.drop("group"), "term").withColumn("value", F.col("p") - general).where("value > 0")
    more = more.select("lang", "source", "term", "value").join(names, "term")
    words = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).withColumn(
        "part", F.lit("term")).select(*final)

    each = max(1, BLOCK_CELLS // (most["s"] or 1))
    blocks = F.ceil(F.greatest(F.col("kept"), F.lit(1)) / each).cast("int")
    sides = shares.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "source", "term", "p")
    zero = F.when(F.col("kept") > 0, _share(
        F.lit(0).cast("long"), F.col("total"), F.greatest("kept", F.lit(1)), large))
    # New names of their own: both sides stem from the same tables.
    spread = groups.select(F.col("lang").alias("lang"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                           F.col("source").alias("source"), zero.alias("p"))
    met = sides.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(
        _compared, "lang string, a string, b string, f bigint")
    pairs = met.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pairs = both.select("lang", "x.source", "x.item", "value").withColumn(
        "rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair")).select(*final)
    return pairs.unionByName(words)
