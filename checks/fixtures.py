"""Columns that later phases would have written, derived from the sample inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import duplicates, recovery, triage
from treeline.plans import sample_inventory as sample

EARLIER = "2021-01-01T00:00:00"
COPIED_AT = "2024-05-01T12:00:00"
ASKED_PATH = "D:/Users/DE//src9/b1/new file.txt"


def earlier_paths(inv: DataFrame) -> DataFrame:
    """Paths an earlier scan recorded: rows last modified before a given day."""
    return inv.where(F.col("modified") < F.lit(EARLIER).cast("timestamp_ntz")).select("path").distinct()


def lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hashes of the baseline C: and of the registry of E:."""
    inv = sample.conformed(spark, sf_dir)
    return (duplicates.baseline_hashes(inv.where(F.col("drive_id") == sample.BASELINE_DRIVE)),
            duplicates.registry_hashes(sample.kept_registry(spark, sf_dir), "row_seq"))


def twice(inv: DataFrame) -> DataFrame:
    """Every row two times under one path, as even and odd row numbers."""
    return inv.withColumn("row_seq", F.explode(F.array(2 * F.col("row_seq"), 2 * F.col("row_seq") + 1)))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole inventory with duplicates found against C: and the registry of E:."""
    inv = sample.conformed(spark, sf_dir)
    baseline, registry = lookups(spark, sf_dir)
    return duplicates.classify(inv, baseline, registry, baseline_drive=sample.BASELINE_DRIVE)


def with_summaries(inv: DataFrame) -> DataFrame:
    ext = F.coalesce(F.col("extension"), F.lit(""))
    return inv.withColumn(
        "summary",
        F.when(F.col("is_dir"), None).when(ext == ".exe", "UNREADABLE: no reader")
        .when(ext == ".jpg", "LLM_ERROR: timeout").when(ext == "", " \t ")
        .otherwise(F.concat(F.lit("Summary of "), F.col("filename"))))


def with_targets(inv: DataFrame) -> DataFrame:
    ext = F.coalesce(F.col("extension"), F.lit(""))
    return inv.withColumn(
        "organized_path",
        F.when(F.col("is_dir"), None)
        .when(ext == ".txt", F.concat(F.lit("Text/"), F.col("filename")))
        .when(ext == ".md", None)
        .when(ext == ".pdf", F.concat(F.lit("/abs/"), F.col("filename")))
        .when(ext == ".docx", F.concat(F.lit("Docs/../../"), F.col("filename")))
        .when(ext == ".xlsx", F.concat(
            F.lit("Sheets/"), F.substr("md5_hash", F.lit(1), F.lit(2)), F.lit(".xlsx")))
        .when(ext == ".jpg", " NaN ")
        .when(ext == ".html", F.concat(F.lit("Pages\\"), F.col("filename")))
        .otherwise(F.concat(F.lit("Other/"), F.col("drive_id"), F.lit("/"), F.col("filename")))
    ).withColumn("copy_status", F.when(F.col("review") == "no", "copied "))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = with_targets(sample.conformed(spark, sf_dir))
    return recovery.copy_plan(recovery.copy_eligible(inv), "/recovered/")


def reviewed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy plan as a table, the form in which a copy job takes it."""
    return sample.kept(plan(spark, sf_dir))


def copied_files(planned: DataFrame) -> DataFrame:
    """What a listing of the destination would show, some files damaged or absent."""
    done = planned.where((F.col("plan_status") == "PLANNED") & (F.col("drive_id") != "C:"))
    wrong = F.col("extension") == ".xlsx"
    cut = F.col("size_bytes") > 4000
    return done.select(
        "dest", (F.col("size_bytes") - F.when(cut, 1).otherwise(0)).alias("dest_size"),
        F.when(wrong, F.md5("dest")).otherwise(F.col("md5_hash")).alias("dest_md5"))


def triage_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered rows as a table: the rows of a batch must not change once sent."""
    marked = duplicates.mark_duplicates(classified(spark, sf_dir))
    return sample.kept(triage.triage_rows(marked))


def replies(rows: DataFrame) -> DataFrame:
    """Model replies for the batches, in good and bad forms."""
    escaped = F.replace(F.col("path"), F.lit("\\"), F.lit("\\\\"))
    item = F.concat(
        F.lit('{"path": "'), escaped, F.lit('", "recommendation": "'),
        F.when(F.col("is_dir"), "REVIEW").otherwise("INTERESTING"),
        F.lit('", "confidence": '), F.when(F.col("is_dir"), "0.25").otherwise("0.75"),
        F.lit(', "comment": '), F.when(F.col("is_dir"), "null").otherwise('"looks personal"'),
        F.lit("}"))
    answered = rows.where(F.coalesce(F.col("extension"), F.lit("")) != ".md")
    listed = answered.withColumn("item", item).groupBy("drive_id", "batch_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("batch_pos", "item"))), lambda x: x["item"]), ", "
        ).alias("items"), F.first("item").alias("one"))
    body = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    form = F.pmod("batch_id", F.lit(8))
    return listed.select(
        "drive_id", "batch_id",
        F.when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(body, F.lit(" that is all")))
        .when(form == 3, "not json at all")
        .when(form == 4, F.concat(F.lit("  ```\n"), body, F.lit("```  ")))
        .when(form == 5, '{"path": "x", "recommendation": "SKIP", "confidence": 1, "comment": ""}')
        .when(form == 6, F.concat(
            F.lit("["), F.col("items"), F.lit(', {"path": "x", "recommendation": "SKIP", "confidence": 1}]')))
        .otherwise(body).alias("reply"))


def assignments(eligible: DataFrame) -> DataFrame:
    """Target paths proposed for the documents that are not plain text."""
    chosen = eligible.where(F.col("extension") != ".txt")
    first = chosen.select(
        "drive_id", F.col("path").alias("original_path"),
        F.concat(F.lit("Old/"), F.col("filename")).alias("organized_path"),
        F.lit(0).alias("position"))
    again = chosen.where(F.col("size_bytes") > 2000).select(
        "drive_id", F.col("path").alias("original_path"),
        F.concat(F.lit("Large/"), F.col("filename")).alias("organized_path"),
        F.lit(1).alias("position"))
    return first.unionByName(again)
