"""The registered queries of this folder: op<N>_<name>, and `pipeline`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import brown_lm, divergence, hard_negatives, licenses, quality_classifier, warc
from treeline.llm.bpe_reuse import encode_decode
from treeline.llm.exact_dedup import exact_groups
from treeline.llm.near_dedup import near_groups
from treeline.llm.packing import pack
from treeline.llm.quality_rules import cascade
from treeline.llm.store import remainder
from treeline.llm.substring_dedup import remove_repeats
from treeline.llm.suffix_dedup import remove_repeated_bytes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(
        *quality_classifier.sample(docs, labels, remainder("doc_id", 3) != 1))
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    return quality_classifier.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_documents(spark, sf_dir)).drop("perplexity")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_documents(spark, sf_dir), width=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.archive(pages, "page_id", "html", "url", warc.session_date(spark))
    return warc.read(manifest).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(_documents(spark, sf_dir)).drop("rejected_by")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op10_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(_documents(spark, sf_dir))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, label=label)


QUERIES = [op1_quality_classifier, op2_brown_lm, op3_near_dedup, op4_warc, op5_exact_dedup, op6_quality_rules,
           op7_substring_dedup, op8_license_scan, op9_best_fit_packing, op10_bpe_reuse,
           op11_suffix_dedup, op12_source_divergence, op13_hard_negatives]
