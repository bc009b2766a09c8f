"""The stages of the pipeline: each returns the columns of documents that it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import quality_classifier
from treeline.llm.exact_dedup import exact_groups
from treeline.llm.near_dedup import near_groups
from treeline.llm.packing import pack
from treeline.llm.store import remainder, stored
from treeline.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. It learns as op1 does, from docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(
        *quality_classifier.sample(docs, labels, remainder("doc_id", 3) != 1))
    return quality_classifier.keep_good(docs, model)


def with_own_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, name of a column in which every row has a number of its own).

    That is doc_id where no row lacks or repeats one. Else rows are numbered by id (without one:
    last), then by text, and the numbered table is stored, so a number means one row.
    """
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).collect():
        return docs, "doc_id"
    name = "row"
    while name in docs.columns:
        name += "_"
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), text)
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _kept(docs: DataFrame, own: str, decided: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are not decided against; every decision is for one row."""
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias(own))
    return docs.join(gone, own, "left_anti").select(columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of equal texts.

    Of rows with that id one stays; rows of one id with different texts are judged each for
    itself. A row without an id goes if another one has its text and an id.
    """
    rows, own = with_own_ids(docs)
    return _kept(rows, own, exact_groups(rows, own), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates.

    Shingles have five words, and the similarity is 0.8 or more. Rows that share an id are
    documents of their own, one without an id comes behind all others. Rows without any word stay.
    """
    rows, own = with_own_ids(docs)
    return _kept(rows, own, near_groups(rows, own), docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller id has too.

    A text that loses nothing stays as it is; any other becomes its kept words joined by
    one space, and n_chars its new length. No row goes.
    """
    out = remove_repeats(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return pack(docs)
