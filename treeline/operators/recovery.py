"""Copying kept files: plan, copy, verification, registry rows."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.functions.values import blank, in_values, lower_value, upper_value
from treeline.operators.hierarchy import resolve
from treeline.operators.skew import HOT_ROWS, lookup_join
from treeline.schema import ensure_columns

CHUNK = 1 << 16


def copy_eligible(
    df: DataFrame, *, within: tuple[str, ...] = ("drive_id",), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Files with effective KEEP or ARCHIVE that are not COPIED; failures are retried."""
    df = ensure_columns(df, ["copy_status", "organized_path"])
    resolved = resolve(df, ["decision"], within=within, hot_rows=hot_rows)
    done = F.coalesce(upper_value(F.col("copy_status")) == "COPIED", F.lit(False))
    return resolved.where(
        in_values(F.col("effective_decision"), ["KEEP", "ARCHIVE"])
        & ~F.coalesce(F.col("is_dir"), F.lit(False)) & ~done)


def _no_target(c: Column) -> Column:
    return blank(c) | (lower_value(c) == "nan")


def _escapes(c: Column) -> Column:
    """Absolute, drive-relative or climbing targets would leave the destination."""
    return (paths.prefix(c) != "") | F.array_contains(paths.parts(c), "..")


def copy_plan(
    eligible: DataFrame, dest_root: str, *, archive_prefix: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `dest` and `plan_status` to eligible rows.

    PLANNED, or SKIPPED without a target, or FAILED when the target lies outside the
    destination or several rows share it (compared like Windows paths).
    """
    target = F.col("organized_path")
    if archive_prefix:
        archived = upper_value(F.col("effective_decision")) == "ARCHIVE"
        target = F.when(archived, F.concat_ws("/", F.lit(archive_prefix), target)).otherwise(target)
    root = dest_root.rstrip("/\\") or dest_root
    rows = eligible.withColumn("_target", target).withColumn(
        "_dest_key",
        F.when(~_no_target(F.col("organized_path")) & ~_escapes(F.col("_target")),
               paths.compare_key(F.col("_target"))))
    taken = rows.where(F.col("_dest_key").isNotNull()).groupBy("_dest_key").agg(
        F.count("*").alias("n")).where(F.col("n") > 1)
    shared = taken.withColumn("_shared", F.lit(True))
    rows = lookup_join(rows, shared, ["_dest_key"], ["path"], "left", hot_rows=hot_rows)
    status = (
        F.when(_no_target(F.col("organized_path")), "SKIPPED")
        .when(F.col("_dest_key").isNull() | F.col("_shared"), "FAILED")
        .otherwise("PLANNED")
    )
    dest = F.concat(F.lit(root + "/"), F.translate(F.col("_target"), "\\", "/"))
    return rows.withColumn("plan_status", status).withColumn(
        "dest", F.when(F.col("plan_status") == "PLANNED", dest)
    ).select(*eligible.columns, "dest", "plan_status")


def file_md5(path: str) -> str:
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _copy_one(source: str, dest: str) -> None:
    """Copy beside the target and rename, so a lost task leaves no partial target."""
    if os.path.exists(dest) and os.path.getsize(source) == os.path.getsize(dest) \
            and file_md5(source) == file_md5(dest):
        return
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    part = f"{dest}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(source, part)
        os.replace(part, dest)
    finally:
        if os.path.exists(part):
            os.remove(part)


def run_copies(plan: DataFrame, tasks: int | None = None) -> DataFrame:
    """Copy planned rows; (path, dest, dest_size, dest_md5, source_size, source_md5, error).

    Rows need `source_uri` (the path as the workers see it) and `dest`. They are
    spread evenly over tasks; repeating a task is harmless. The source is hashed
    only where the inventory has no hash.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, source, dest, known in zip(
                    frame["path"], frame["source_uri"], frame["dest"], frame["md5_hash"]):
                try:
                    _copy_one(source, dest)
                    own = None if isinstance(known, str) and known.strip() else file_md5(source)
                    out.append((path, dest, os.path.getsize(dest), file_md5(dest),
                                os.path.getsize(source), own, None))
                except OSError as e:
                    out.append((path, dest, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[
                "path", "dest", "dest_size", "dest_md5", "source_size", "source_md5", "error",
            ]).astype({"dest_size": "Int64", "source_size": "Int64"})

    work = plan.where(F.col("plan_status") == "PLANNED").select(
        "path", "source_uri", "dest", "md5_hash")
    n = tasks or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(n, "path").mapInPandas(
        run, "path string, dest string, dest_size long, dest_md5 string, "
             "source_size long, source_md5 string, error string")


def verify_copies(plan: DataFrame, copied: DataFrame) -> DataFrame:
    """Add copy_status: COPIED when size and hash at the target match the source.

    `copied` holds (dest, dest_size, dest_md5) and may give the present source_size
    and source_md5. The scanned hash decides; without one the present source hash.
    """
    extra = [c for c in ("source_size", "source_md5") if c in copied.columns]
    facts = copied.select(F.col("dest").alias("_dest"), "dest_size", "dest_md5", *extra)
    facts = facts.groupBy("_dest").agg(F.min(F.struct(*facts.columns[1:])).alias("_f")).select("_dest", "_f.*")
    # Rows without a target get a key of their own, so they do not pile up on null.
    keyed = plan.withColumn("_dest", F.coalesce("dest", F.concat(F.lit("\u0000"), "path")))
    rows = keyed.join(facts, "_dest", "left")
    size = F.coalesce(F.col("source_size"), F.col("size_bytes")) \
        if "source_size" in extra else F.col("size_bytes")
    present = F.col("source_md5") if "source_md5" in extra else F.lit(None).cast("string")
    expected = F.when(_no_target(F.col("md5_hash")), present).otherwise(F.col("md5_hash"))
    same = (size == F.col("dest_size")) & (expected == F.col("dest_md5"))
    status = F.when(F.col("plan_status") != "PLANNED", F.col("plan_status")).when(
        same, "COPIED").otherwise("FAILED")
    columns = [c for c in plan.columns if c != "copy_status"]
    return rows.select(*columns, status.alias("copy_status"))


def registry_rows(verified: DataFrame, copied_at: Column) -> DataFrame:
    """Registry entries of the successful copies; a missing hash stays null."""
    return verified.where(F.col("copy_status") == "COPIED").select(
        F.when(~_no_target(F.col("md5_hash")), F.col("md5_hash")).alias("md5_hash"),
        F.col("path").alias("original_path"),
        "organized_path",
        paths.drive_letter(F.col("path")).alias("drive"),
        copied_at.cast("string").alias("date_copied"))


def copy_counts(verified: DataFrame, by: list[str] | None = None) -> DataFrame:
    status = F.col("copy_status")
    return verified.groupBy(*(by or [])).agg(
        F.count("*").alias("eligible_count"),
        F.count_if(status == "COPIED").alias("copied_count"),
        F.count_if(status == "FAILED").alias("failed_count"),
        F.count_if(status == "SKIPPED").alias("skipped_count"))
