"""Report over the files that exist in the baseline too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.values import bytes_to_gb
from treeline.schema import REPORT_COLUMNS


def duplicates_report(df: DataFrame) -> DataFrame:
    """Baseline duplicates that are files; fixed columns, empty text where missing."""
    kind = F.coalesce(F.col("duplicate_kind") == "baseline_scan", F.lit(False))
    rows = df.where(kind & ~F.coalesce(F.col("is_dir"), F.lit(False)))
    return rows.select(*[
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c)
        for c in REPORT_COLUMNS])


def report_totals(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files, bytes (unreadable numbers count as 0) and GB."""
    size = F.sum(F.coalesce(F.col("size_bytes").try_cast("double"), F.lit(0.0)))
    total = F.coalesce(size, F.lit(0.0))
    return report.groupBy(*(by or [])).agg(
        F.count("*").alias("duplicate_files"),
        total.cast("long").alias("total_bytes"),
        bytes_to_gb(total).alias("total_gb"))
