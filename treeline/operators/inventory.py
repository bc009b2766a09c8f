"""Rows of an inventory: directories from file paths, exclusion, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import fixed_values as fixed
from treeline.functions import paths
from treeline.functions.values import unset
from treeline.schema import ensure_columns


def directory_rows(files: DataFrame, order: str = "row_seq") -> DataFrame:
    """One row per distinct directory above the files, the root left out.

    A directory takes the order number of the first file below it, as a scan would
    report it just before that file. Parents are reduced before they are expanded.
    """
    parents = (
        files.select("drive_id", order, paths.parent(F.col("path")).alias("_dir"))
        .where(F.col("_dir").isNotNull())
        .groupBy("drive_id", "_dir").agg(F.min(order).alias(order))
    )
    up = F.explode(paths.self_and_ancestors(F.col("_dir")))
    return (
        parents.select("drive_id", order, up.alias("path"))
        .groupBy("drive_id", "path").agg(F.min(order).alias(order))
        .select(
            "drive_id", order, "path",
            F.lit("").alias("filename"), F.lit("").alias("extension"),
            F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size_bytes"),
        )
    )


def with_directories(files: DataFrame, order: str = "row_seq") -> DataFrame:
    """Files and the directories above them in one table."""
    return files.unionByName(directory_rows(files, order), allowMissingColumns=True)


def drop_excluded_extensions(df: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Leave out files with an excluded extension; directories stay."""
    skip = [e.lower() for e in (fixed.EXCLUDED_EXTENSIONS if extensions is None else extensions)]
    hit = F.lower(F.coalesce(F.col("extension"), F.lit(""))).isin(skip)
    return df.where(F.coalesce(F.col("is_dir"), F.lit(False)) | ~hit)


def names_below(path: Column, root: str | None) -> Column:
    """The parts of a path below the scan root (below the drive when there is none)."""
    names = paths.parts(path)
    if root is None:
        return names
    skip = F.size(paths.parts(F.lit(root)))
    return F.slice(names, skip + 1, F.greatest(F.size(names) - skip, F.lit(0)))


def prune_excluded_dirs(
    df: DataFrame, names: list[str] | None = None, root: str | None = None
) -> DataFrame:
    """Drop everything below an excluded directory and mark the directory itself.

    The name match is exact and case-sensitive. Names above the scan root do not
    count; the root itself is marked when its name is excluded, but not pruned.
    """
    skip = fixed.EXCLUDED_DIRS if names is None else names
    df = ensure_columns(df, ["recommendation", "confidence", "comment"])
    below = names_below(F.col("path"), root)
    above = F.slice(below, F.lit(1), F.greatest(F.size(below) - 1, F.lit(0)))
    inside = F.exists(above, lambda n: n.isin(skip))
    marked = F.coalesce(F.col("is_dir"), F.lit(False)) & paths.base_name(F.col("path")).isin(skip)
    sure = F.lit("0.99").cast(df.schema["confidence"].dataType)
    return df.where(~inside).withColumns({
        "recommendation": F.when(marked, "SKIP").otherwise(F.col("recommendation")),
        "confidence": F.when(marked, sure).otherwise(F.col("confidence")),
        "comment": F.when(marked, fixed.COMMENT_EXCLUDED).otherwise(F.col("comment")),
    })


def seen_paths(df: DataFrame) -> DataFrame:
    """Paths an inventory or a manifest holds, with their drive where it is given, for an anti join.

    A path may occur twice.
    """
    drive = [c for c in ("drive_id",) if c in df.columns]
    return df.where(~unset(F.col("path"))).select(*drive, "path")


def new_rows(df: DataFrame, seen: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows whose path is not recorded yet (exact text)."""
    return df.join(seen, on or ["path"], "left_anti")


def first_row_per_path(df: DataFrame, order: str = "row_seq") -> DataFrame:
    """One row per drive and path, the first in order; later ones are ignored.

    A row without an order number comes last; ties go by hash, then by size.
    """
    whole = F.struct(*df.columns)
    rank = F.struct(F.coalesce(F.col(order), F.lit(2 ** 63 - 1)), F.coalesce("md5_hash", F.lit("")),
                    F.coalesce("size_bytes", F.lit(-1)))
    return df.groupBy("drive_id", "path").agg(F.min_by(whole, rank).alias("_row")).select("_row.*")


def remaining_work(
    df: DataFrame, seen: DataFrame, *, names: list[str] | None = None,
    extensions: list[str] | None = None, root: str | None = None, by: list[str] | None = None,
) -> DataFrame:
    """Items and bytes a scan still has to read: unseen files and excluded directories."""
    visited = drop_excluded_extensions(prune_excluded_dirs(df, names, root), extensions)
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    skip = fixed.EXCLUDED_DIRS if names is None else names
    counted = visited.where(~is_dir | paths.base_name(F.col("path")).isin(skip))
    return new_rows(counted, seen).groupBy(*(by or [])).agg(
        F.count("*").alias("remaining_items"),
        F.coalesce(F.sum(F.when(~is_dir, F.col("size_bytes"))), F.lit(0)).alias("remaining_bytes"),
    )


def review_shortlist(df: DataFrame) -> DataFrame:
    """Non-duplicates in reading order: directories first, INTERESTING first, then by path.

    INTERESTING, REVIEW and SKIP happen to be in alphabetical order.
    """
    fresh = ~F.coalesce(F.col("is_duplicate"), F.lit(False))
    return df.where(fresh).withColumn(
        "sort_dir", F.when(F.col("is_dir"), 0).otherwise(1).cast("long")
    ).orderBy("sort_dir", "recommendation", "path")
