"""Listing and hashing directory trees that the executors can see.

Listing goes in rounds. A task walks until it has reported a fixed number of
entries and hands back the directories it did not reach; the next round spreads
those over all tasks. So a subtree with most of the files is shared out however
deep it lies. Hashing is a separate step with its own even spread.
"""

from __future__ import annotations

import errno
import hashlib
import os
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import fixed_values as fixed
from treeline.functions import paths

# Entries a task reports before it hands on the rest; the first round is short.
WALK_BUDGET = 50_000
FIRST_BUDGET = 1_000
FRAME_ROWS = 5_000
CHUNK = 1 << 16

_LISTING = "kind string, uri string, name string, size_bytes long, modified string, note string"


def _iso(seconds: float) -> str:
    return datetime.fromtimestamp(seconds).isoformat()


def _facts(path: str) -> tuple[int, str | None]:
    try:
        st = os.stat(path)
        return st.st_size, _iso(st.st_mtime)
    except OSError:
        return 0, None


def _visit(directory: str, skip_dirs: set[str], skip_exts: set[str]) -> Iterator[tuple]:
    """Rows of one directory; sub-directories to enter come as kind "pending"."""
    def unreadable(e: OSError) -> tuple:
        return ("error", directory, "", 0, None, fixed.COMMENT_INACCESSIBLE + (e.strerror or str(e)))

    try:
        entries = os.scandir(directory)
    except OSError as e:
        yield unreadable(e)
        return
    own = os.path.basename(directory.rstrip("/")) or directory
    note = fixed.COMMENT_EXCLUDED if own in skip_dirs else None
    yield ("dir", directory, "", 0, _facts(directory)[1], note)
    with entries:
        while True:
            try:
                entry = next(entries, None)
            except OSError as e:  # what was listed so far stays
                yield unreadable(e)
                return
            if entry is None:
                return
            try:
                is_dir, is_link = entry.is_dir(), entry.is_symlink()
            except OSError:
                is_dir = is_link = False
            if is_dir:
                if entry.name in skip_dirs:
                    yield ("dir", entry.path, "", 0, _facts(entry.path)[1], fixed.COMMENT_EXCLUDED)
                elif not is_link:
                    yield ("pending", entry.path, "", 0, None, None)
            elif os.path.splitext(entry.name)[1].lower() not in skip_exts:
                yield ("file", entry.path, entry.name, *_facts(entry.path), None)


def _walk(directories: Iterator[str], budget: int, skip_dirs: set[str], skip_exts: set[str]):
    seen = 0
    for start in directories:
        stack = [start]
        while stack:
            current = stack.pop()
            if seen >= budget:
                yield ("pending", current, "", 0, None, None)
                continue
            for row in _visit(current, skip_dirs, skip_exts):
                if row[0] == "pending":
                    stack.append(row[1])
                else:
                    seen += 1
                    yield row


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _LISTING.split(", ")]
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= FRAME_ROWS:
            yield pd.DataFrame(block, columns=names)
            block = []
    if block:
        yield pd.DataFrame(block, columns=names)


def list_tree(
    spark: SparkSession, root: str, folder: str, *, exclude_dirs: list[str] | None = None,
    exclude_extensions: list[str] | None = None, tasks: int | None = None,
    budget: int = WALK_BUDGET, first_budget: int = FIRST_BUDGET,
) -> DataFrame:
    """Inventory rows (without hashes) of everything below `root`.

    Excluded directories get a marker row and are not entered, files with excluded
    extensions are left out, unreadable directories become REVIEW rows. `source_uri`
    is the name the workers use, `path` its Windows form. A root that does not exist is
    refused. Each round is written to
    `folder`, a new folder on shared storage.
    """
    skip_dirs = set(fixed.EXCLUDED_DIRS if exclude_dirs is None else exclude_dirs)
    skip_exts = {e.lower() for e in (
        fixed.EXCLUDED_EXTENSIONS if exclude_extensions is None else exclude_extensions)}
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walker(limit: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            starts = (uri for frame in frames for uri in frame["uri"])
            yield from _frames(_walk(starts, limit, skip_dirs, skip_exts))
        return run

    frontier = spark.createDataFrame([(root,)], "uri string")
    step = 0
    while True:
        found = frontier.mapInPandas(walker(first_budget if step == 0 else budget), _LISTING)
        target = f"{folder}/round={step}"
        found.write.mode("overwrite").parquet(target)
        if step == 0:
            gone = fixed.COMMENT_INACCESSIBLE + os.strerror(errno.ENOENT)
            missing = (F.col("kind") == "error") & (F.col("uri") == root) & (F.col("note") == gone)
            if not spark.read.parquet(target).where(missing).isEmpty():
                raise FileNotFoundError(root)
        pending = spark.read.parquet(target).where(F.col("kind") == "pending").select("uri")
        if pending.isEmpty():
            break
        frontier = pending.repartition(n, "uri")
        step += 1

    rows = spark.read.parquet(folder).where(F.col("kind") != "pending")
    failed, marked = F.col("kind") == "error", F.col("note") == fixed.COMMENT_EXCLUDED
    is_dir = F.col("kind") != "file"
    return rows.select(
        paths.normalize(F.col("uri")).alias("path"), F.col("uri").alias("source_uri"),
        F.col("name").alias("filename"),
        F.when(is_dir, "").otherwise(paths.extension(F.col("name"))).alias("extension"),
        is_dir.alias("is_dir"), "size_bytes", "modified",
        F.when(failed, "REVIEW").when(marked, "SKIP").alias("recommendation"),
        F.when(failed, "0.0").when(marked, "0.99").alias("confidence"),
        F.col("note").alias("comment"))


def _hash(path: str) -> tuple[str | None, int | None]:
    digest = hashlib.md5()
    try:
        with open(path, "rb") as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
        return digest.hexdigest(), None
    except OSError as e:
        return None, e.errno


def hash_files(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add md5_hash by reading the files in chunks; directories have none.

    A file that cannot be read has a null hash; a cloud placeholder gets a comment.
    """
    n = tasks or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 64):
                part = frame.iloc[start:start + 64]
                found = [_hash(u) for u in part["source_uri"]]
                yield pd.DataFrame({
                    "source_uri": part["source_uri"].to_list(),
                    "md5_hash": [f[0] for f in found],
                    "errno": pd.array([f[1] for f in found], dtype="Int32")})

    files = listing.where(~F.col("is_dir")).select("source_uri").repartition(n, "source_uri")
    hashes = files.mapInPandas(run, "source_uri string, md5_hash string, errno int")
    stub = F.col("errno") == errno.EINVAL
    return listing.join(hashes, "source_uri", "left").withColumn(
        "comment", F.when(stub, fixed.COMMENT_CLOUD_STUB).otherwise(F.col("comment"))).drop("errno")


def number_rows(listing: DataFrame, first: int = 0) -> DataFrame:
    """Add row_seq in path order. The numbers have gaps; store the result at once."""
    ordered = listing.repartitionByRange("path").sortWithinPartitions("path")
    return ordered.withColumn("row_seq", F.monotonically_increasing_id() + first)
