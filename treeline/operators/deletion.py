"""Delete manifest, its check against the inventory, and safe subtree plans.

Nothing here deletes a file; the results are tables for people and later jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.fixed_values import COMMENT_EXCLUDED
from treeline.functions import paths
from treeline.functions.values import bytes_to_gb, digits_to_long, unset, upper_value
from treeline.operators.hierarchy import (
    SCOPE, keys_above, mark_below, resolve,
)
from treeline.operators.skew import HOT_ROWS
from treeline.schema import ensure_columns


def delete_manifest(
    df: DataFrame, *, within: tuple[str, ...] = SCOPE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows with effective DELETE, directories included, and where that comes from."""
    resolved = resolve(df, ["decision"], within=within, hot_rows=hot_rows)
    distance = F.col("decision_distance")
    source = F.when(distance == 0, "EXPLICIT").otherwise(
        F.concat(F.lit("INHERITED from "), paths.ancestor_at(F.col("path"), distance)))
    return resolved.where(upper_value(F.col("effective_decision")) == "DELETE").select(
        *within, "path", F.coalesce("filename", F.lit("")).alias("filename"), "size_bytes",
        source.alias("decision_source"), "is_dir")


def manifest_totals(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, files, bytes (digit texts only), GB, explicit and inherited rows."""
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    explicit = F.col("decision_source") == "EXPLICIT"
    size = F.coalesce(F.sum(digits_to_long(F.col("size_bytes"))), F.lit(0))
    return manifest.groupBy(*(by or [])).agg(
        F.count("*").alias("total_rows"),
        F.count_if(~is_dir).alias("total_files"),
        size.alias("total_bytes"),
        bytes_to_gb(size).alias("total_gb"),
        F.count_if(explicit).alias("explicit_count"),
        F.count_if(~explicit).alias("inherited_count"))


def manifest_name(inventory: Column) -> Column:
    return F.concat(paths.stem(inventory), F.lit("_delete_manifest.csv"))


def manifest_guard(current: DataFrame, manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Compare two sets of paths: counts and smallest example on each side."""
    scope = by or []
    sides = current.select(*scope, "path", F.lit(1).alias("_cur"), F.lit(0).alias("_man")).unionAll(
        manifest.where(~unset(F.col("path"))).select(
            *scope, "path", F.lit(0).alias("_cur"), F.lit(1).alias("_man")))
    per_path = sides.groupBy(*scope, "path").agg(
        F.max("_cur").alias("_cur"), F.max("_man").alias("_man"))
    missing, stale = F.col("_man") == 0, F.col("_cur") == 0
    return per_path.groupBy(*scope).agg(
        F.count_if(missing).alias("missing_count"),
        F.min(F.when(missing, F.col("path"))).alias("missing_example"),
        F.count_if(stale).alias("stale_count"),
        F.min(F.when(stale, F.col("path"))).alias("stale_example"))


def check_manifest(current: DataFrame, manifest: DataFrame) -> None:
    """Raise when the manifest and the current delete set differ."""
    found = manifest_guard(current, manifest).first()
    details = []
    if found["missing_count"]:
        details.append(f"missing {found['missing_count']} current delete path(s), "
                       f"e.g. {found['missing_example']}")
    if found["stale_count"]:
        details.append(f"contains {found['stale_count']} stale path(s), "
                       f"e.g. {found['stale_example']}")
    if details:
        raise ValueError("Manifest does not match the current inventory; regenerate it: "
                         + "; ".join(details))


def protected_rows(df: DataFrame) -> DataFrame:
    """Rows with any stated decision other than DELETE."""
    value = upper_value(F.col("decision"))
    return df.where(F.coalesce(~value.isin("", "NAN", "DELETE"), F.lit(False)))


def subtree_candidates(
    df: DataFrame, manifest: DataFrame, *, existing: DataFrame | None = None,
    within: tuple[str, ...] = SCOPE, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shallowest directories of the manifest that can go as a whole.

    A directory qualifies when no row below it states another decision. A drive root
    is never proposed. `existing` (paths) limits the result to directories still
    present. `has_pruned_descendant` warns that the subtree holds, or is, a directory
    the scan did not enter, so it may contain files nobody has looked at.
    """
    scope = list(within)
    listed = manifest.select(*scope, "path")
    found = df.where(F.coalesce(F.col("is_dir"), F.lit(False))).where(
        ~paths.is_root(F.col("path"))).select(*scope, "path").join(
        listed, [*scope, "path"], "left_semi")
    if existing is not None:
        found = found.join(existing.select("path"), "path", "left_semi")
    found = found.withColumn("_key", paths.compare_key(F.col("path")))
    held = keys_above(protected_rows(df), within)
    clean = found.join(held, [*scope, "_key"], "left_anti")
    keys = clean.select(*scope, "_key").distinct().withColumn("_mark", F.lit(True))
    top = mark_below(clean, keys, "_inside", with_self=False, within=within,
                     hot_rows=hot_rows).where(F.col("_inside").isNull())

    skipped = df.where(F.coalesce(F.col("comment") == COMMENT_EXCLUDED, F.lit(False))) \
        if "comment" in df.columns else df.limit(0)
    pruned = keys_above(skipped, within).unionByName(
        skipped.select(*scope, paths.compare_key(F.col("path")).alias("_key"))
    ).distinct().withColumn("_pruned", F.lit(True))
    return top.join(pruned, [*scope, "_key"], "left").select(
        *scope, "path", paths.separator_count(F.col("path")).alias("separators"),
        F.coalesce("_pruned", F.lit(False)).alias("has_pruned_descendant"))


def _subtree_marks(subtrees: DataFrame, mark: Column, within: tuple[str, ...]) -> DataFrame:
    key = paths.compare_key(F.col("path")).alias("_key")
    return subtrees.select(*within, key, mark.alias("_mark")).groupBy(*within, "_key").agg(
        F.max("_mark").alias("_mark"))


def covered_rows(
    df: DataFrame, candidates: DataFrame, *, within: tuple[str, ...] = SCOPE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `covered`: the row is a planned subtree or lies below one.

    `candidates` is read several times; pass a stored table.
    """
    marks = _subtree_marks(candidates, F.lit(True), within)
    return mark_below(df, marks, "covered", with_self=True, within=within, hot_rows=hot_rows
                      ).withColumn("covered", F.coalesce("covered", F.lit(False)))


def delete_files_plan(
    df: DataFrame, manifest: DataFrame, candidates: DataFrame, *,
    within: tuple[str, ...] = SCOPE, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Files to delete one by one: listed, not yet deleted, outside every subtree."""
    df = ensure_columns(df, ["delete_status"])
    listed = manifest.select(*within, "path")
    done = F.coalesce(upper_value(F.col("delete_status")) == "DELETED", F.lit(False))
    files = df.where(~F.coalesce(F.col("is_dir"), F.lit(False)) & ~done).join(
        listed, [*within, "path"], "left_semi")
    return covered_rows(files, candidates, within=within, hot_rows=hot_rows).where(
        ~F.col("covered")).drop("covered")


def apply_delete_outcomes(
    df: DataFrame, subtrees: DataFrame, files: DataFrame, *, within: tuple[str, ...] = SCOPE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Set delete_status from the outcomes (path, delete_status) of subtrees and files.

    All rows of a subtree take its outcome, a failed one included.
    """
    df = ensure_columns(df, ["delete_status"])
    outcome = F.when(F.col("delete_status") == "DELETED", "DELETED").otherwise("FAILED")
    rows = mark_below(df, _subtree_marks(subtrees, outcome, within), "_tree", with_self=True,
                      within=within, hot_rows=hot_rows)
    single = files.groupBy(*within, "path").agg(F.max("delete_status").alias("_single"))
    return rows.join(single, [*within, "path"], "left").withColumn(
        "delete_status", F.coalesce("_tree", "_single", "delete_status")).select(*df.columns)
