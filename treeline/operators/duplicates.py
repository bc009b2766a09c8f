"""Duplicate detection by content hash, and what follows from it.

A hash is looked up in the baseline inventory, then in the registry of kept files,
then among the earlier files of the same drive. All three are combined per distinct
hash first; only hashes that have a match or occur twice go into the row join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import fixed_values as fixed
from treeline.functions.values import is_true, unset
from treeline.operators.skew import HOT_ROWS, lookup_join
from treeline.schema import ensure_columns


def _hashed(df: DataFrame) -> Column:
    return ~unset(F.col("md5_hash"))


def baseline_hashes(df: DataFrame, order: str = "row_seq") -> DataFrame:
    """(md5_hash, baseline_path): the last row of a baseline inventory per hash."""
    return (
        df.where(_hashed(df) & ~unset(F.col("path")))
        .groupBy("md5_hash")
        .agg(F.max_by("path", F.struct(order, "path")).alias("baseline_path"))
    )


def registry_hashes(df: DataFrame, order: str) -> DataFrame:
    """(md5_hash, kept_path, kept_target): the last registry row per hash."""
    last = F.max_by(
        F.struct("original_path", "organized_path"), F.struct(order, "original_path")
    )
    return (
        df.where(_hashed(df)).groupBy("md5_hash").agg(last.alias("_last"))
        .select(
            "md5_hash",
            F.coalesce(F.col("_last.original_path"), F.lit("")).alias("kept_path"),
            F.coalesce(F.col("_last.organized_path"), F.lit("")).alias("kept_target"),
        )
    )


def first_of_hash(
    df: DataFrame, order: str = "row_seq", *, generation: str | None = None, least: int = 1
) -> DataFrame:
    """(drive_id, md5_hash, n, first_path) over the hashed files of each drive.

    First is generation 0 before 1, then order number (rows without one come last),
    then path. Only numbers are aggregated over all rows; paths are fetched for the hashes
    that at least `least` files have, by a join on the number of the first row, which
    spreads the rows of a hot hash. first_path is null for the other hashes.
    """
    number = F.coalesce(F.col(order), F.lit(2 ** 63 - 1)).cast("decimal(38,0)")
    if generation is not None:
        number = F.when(F.col(generation) > 0, number + F.lit(Decimal(10 ** 19))).otherwise(number)
    rows = df.where(_hashed(df)).select(
        "drive_id", "md5_hash", "path", number.cast("decimal(38,0)").alias("_number"))
    counts = rows.groupBy("drive_id", "md5_hash").agg(
        F.count("*").alias("n"), F.min("_number").alias("_number"))
    wanted = counts.where(F.col("n") >= least)
    first = rows.join(wanted.drop("n"), ["drive_id", "md5_hash", "_number"]).groupBy(
        "drive_id", "md5_hash").agg(F.min("path").alias("first_path"))
    return counts.drop("_number").join(first, ["drive_id", "md5_hash"], "left")


def classify(
    scanned: DataFrame,
    baseline: DataFrame,
    registry: DataFrame,
    *,
    earlier: DataFrame | None = None,
    order: str = "row_seq",
    baseline_drive: str | None = None,
    min_dup_bytes: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Set is_duplicate, duplicate_kind, duplicate_source_path and comment.

    `baseline` and `registry` come from baseline_hashes and registry_hashes.
    `earlier` holds rows stored by former scans of the same drives; they precede
    the scanned rows, so a copy of a stored file is a same-drive duplicate.
    A drive is never compared with a baseline made from itself (`baseline_drive`).
    Files below `min_dup_bytes` are never duplicates.
    """
    eligible = _hashed(scanned) & (
        F.coalesce(F.col("size_bytes").try_cast("long"), F.lit(0)) >= min_dup_bytes
    )
    generation = scanned.where(eligible).select(
        "drive_id", "md5_hash", "path", order, F.lit(1).alias("_gen"))
    if earlier is not None:
        generation = generation.unionByName(
            earlier.where(_hashed(earlier))
            .select("drive_id", "md5_hash", "path", order, F.lit(0).alias("_gen")))
    local = first_of_hash(generation, order, generation="_gen", least=2)

    info = local.join(baseline, "md5_hash", "left").join(registry, "md5_hash", "left")
    if baseline_drive is not None:
        info = info.withColumn(
            "baseline_path", F.when(F.col("drive_id") != baseline_drive, F.col("baseline_path")))
    matched = info.where(
        F.col("baseline_path").isNotNull() | F.col("kept_path").isNotNull() | (F.col("n") > 1))

    keyed = scanned.withColumn("_hash", F.when(eligible, F.col("md5_hash")))
    matched = matched.withColumnRenamed("md5_hash", "_hash")
    rows = lookup_join(
        keyed, matched, ["drive_id", "_hash"], ["path", order], "left", hot_rows=hot_rows)

    kind = (
        F.when(F.col("baseline_path").isNotNull(), "baseline_scan")
        .when(F.col("kept_path").isNotNull(), "kept_hashes")
        .when(F.col("first_path") != F.col("path"), "same_drive")
        .otherwise("")
    )
    source = (
        F.when(F.col("duplicate_kind") == "baseline_scan", F.col("baseline_path"))
        .when(F.col("duplicate_kind") == "kept_hashes", F.col("kept_path"))
        .when(F.col("duplicate_kind") == "same_drive", F.col("first_path"))
        .otherwise("")
    )
    out = rows.withColumn("duplicate_kind", kind)
    out = out.withColumns({
        "is_duplicate": F.col("duplicate_kind") != "",
        "duplicate_source_path": source,
    })
    stated = F.col("comment") if "comment" in scanned.columns else F.lit(None).cast("string")
    out = out.withColumn("comment", F.coalesce(duplicate_comment(F.col("kept_target")), stated))
    added = ["is_duplicate", "duplicate_kind", "duplicate_source_path", "comment"]
    return out.select(*[c for c in scanned.columns if c not in added], *added)


def duplicate_comment(kept_target: Column) -> Column:
    kind, source = F.col("duplicate_kind"), F.col("duplicate_source_path")
    return (
        F.when(kind == "baseline_scan", F.concat(F.lit(fixed.COMMENT_BASELINE), source))
        .when(kind == "kept_hashes", F.concat(
            F.lit(fixed.COMMENT_KEPT_FROM), source, F.lit(fixed.COMMENT_KEPT_TO), kept_target))
        .when(kind == "same_drive", F.concat(
            F.lit(fixed.COMMENT_SAME_DRIVE), source, F.lit(fixed.COMMENT_SAME_DRIVE_END)))
    )


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Duplicates become SKIP / 0.99; unset decisions of baseline copies DELETE."""
    text = ["duplicate_kind", "recommendation", "comment", "decision"]
    df = ensure_columns(df, ["is_duplicate", "confidence", *text])
    dup = is_true(F.col("is_duplicate"))
    from_baseline = dup & F.coalesce(F.col("duplicate_kind") == "baseline_scan", F.lit(False))
    sure = F.lit("0.99").cast(df.schema["confidence"].dataType)
    return df.withColumns({
        "recommendation": F.when(dup, "SKIP").otherwise(F.col("recommendation")),
        "confidence": F.when(dup, sure).otherwise(F.col("confidence")),
        "decision": F.when(from_baseline & unset(F.col("decision")), "DELETE")
        .otherwise(F.col("decision")),
        "comment": F.when(dup & unset(F.col("comment")), fixed.COMMENT_MARKED)
        .otherwise(F.col("comment")),
    })


def duplicate_summary(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per kind, automatic deletions, all duplicates and remaining rows."""
    dup = is_true(F.col("is_duplicate"))
    kind = F.coalesce(F.col("duplicate_kind"), F.lit(""))
    deleted = F.coalesce(F.upper("decision") == "DELETE", F.lit(False))
    return marked.groupBy(*(by or [])).agg(
        F.count_if(dup & (kind == "baseline_scan")).alias("baseline_count"),
        F.count_if(dup & (kind == "kept_hashes")).alias("kept_count"),
        F.count_if(dup & (kind == "same_drive")).alias("same_drive_count"),
        F.count_if(dup & (kind == "baseline_scan") & deleted).alias("auto_delete_count"),
        F.count_if(dup).alias("duplicate_count"),
        F.count_if(~dup).alias("remaining_count"),
    )
