"""Inventories that arrive in pieces: Structured Streaming over a folder of drops.

Each micro-batch adds the paths not stored yet (the first row of a path counts, a
later one is ignored even if the file changed) and finds their duplicates among
everything stored before and within the batch.

Beside the rows, the state has two narrow indexes, of paths and of hashes, in folders by a prefix of
the key's hash. A micro-batch opens only the folders of the prefixes that its own keys
have, so an arrival costs what it touches, not what is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.operators import duplicates, inventory
from treeline.schema import INVENTORY, conform

STATE_FOLDER = "inventory"
#: Folders of an index; a micro-batch adds one file to each that it touches.
PREFIXES = 256

PATHS = T.StructType([INVENTORY["drive_id"], INVENTORY["path"]])
HASHES = T.StructType([INVENTORY[c] for c in ("drive_id", "md5_hash", "path", "row_seq")])
#: Index name, its columns, and the key whose hash gives the prefix.
INDEXES = (("by_path", PATHS, ["drive_id", "path"]), ("by_hash", HASHES, ["drive_id", "md5_hash"]))


def _nothing(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def _prefix(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PREFIXES)).cast("int")


def add_arrivals(
    arrived: DataFrame, known: DataFrame, same: DataFrame, baseline: DataFrame, registry: DataFrame,
    baseline_drive: str | None = None,
) -> DataFrame:
    """The rows of one arrival that are new, with their duplicate columns.

    Paths are reduced to one row per drive before they meet the stored ones. `known` holds
    stored (drive_id, path), `same` stored rows by hash; both may hold more than the arrival needs
    and are cut by semi joins before anything is grouped.
    """
    key = ["drive_id", "path"]
    first = inventory.first_row_per_path(conform(arrived))
    known = known.select(*key).join(first.select(*key), key, "left_semi")
    fresh = inventory.new_rows(first, known, key)
    same = same.join(first.select("drive_id", "md5_hash"), ["drive_id", "md5_hash"], "left_semi")
    return duplicates.classify(
        fresh, baseline, registry, earlier=same, baseline_drive=baseline_drive)


def touched_prefixes(arrived: DataFrame) -> dict[str, list[int]]:
    """For each index the prefixes of an arrival's keys: at most PREFIXES small numbers."""
    rows = conform(arrived)
    found = rows.agg(*(F.collect_set(_prefix(key)).alias(name) for name, _, key in INDEXES)).first()
    return {name: sorted(found[name]) for name, _, _ in INDEXES}


def read_index(spark: SparkSession, state: str, name: str, prefixes: list[int], before: int) -> DataFrame:
    """The entries of some prefixes that batches before this one made; other folders are not opened."""
    schema = {n: s for n, s, _ in INDEXES}[name]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(state).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [f"{state}/{name}/prefix={p}" for p in prefixes]
    folders = [f for f in folders if fs.exists(path(f))]
    if not folders:
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField("prefix", T.IntegerType()), T.StructField("batch_id", T.LongType())])
    found = spark.read.schema(wide).option("basePath", f"{state}/{name}").parquet(*folders)
    return found.where(F.col("batch_id") < before).select(*schema.names)


def _write_indexes(added: DataFrame, state: str, batch_id: int) -> None:
    """One file for each prefix of the rows; a repeated batch overwrites its own ones."""
    for name, schema, key in INDEXES:
        rows = added.select(*schema.names, F.lit(batch_id).alias("batch_id"), _prefix(key).alias("prefix"))
        rows.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "prefix", "batch_id").parquet(f"{state}/{name}")


def arrival_writer(
    state: str, baseline: DataFrame | None = None, registry: DataFrame | None = None,
    baseline_drive: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function; a repeated batch overwrites its own folders only."""
    target = f"{state}/{STATE_FOLDER}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        baselines = baseline if baseline is not None else _nothing(
            spark, "md5_hash string, baseline_path string")
        kept = registry if registry is not None else _nothing(
            spark, "md5_hash string, kept_path string, kept_target string")
        touched = touched_prefixes(batch)
        known, same = (read_index(spark, state, name, touched[name], batch_id) for name, _, _ in INDEXES)
        added = add_arrivals(batch, known, same, baselines, kept, baseline_drive)
        folder = f"{target}/batch_id={batch_id}"
        added.write.mode("overwrite").parquet(folder)
        _write_indexes(spark.read.schema(added.schema).parquet(folder), state, batch_id)

    return write


def read_state(spark: SparkSession, state: str) -> DataFrame:
    columns = T.StructType([*INVENTORY.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(columns).parquet(f"{state}/{STATE_FOLDER}")


def run_available(
    spark: SparkSession, drops: str, state: str, *, files_per_batch: int | None = None,
    baseline: DataFrame | None = None, registry: DataFrame | None = None,
    baseline_drive: str | None = None,
) -> DataFrame:
    """Take in all drops present now and return the stored inventory.

    `drops` and `state` are folders on storage all executors share.
    """
    reader = spark.readStream.schema(INVENTORY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(drops).writeStream
        .foreachBatch(arrival_writer(state, baseline, registry, baseline_drive))
        .option("checkpointLocation", f"{state}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_state(spark, state)
