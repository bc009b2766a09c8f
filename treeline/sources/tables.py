"""Inventories, registries, manifests and reports as tables and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import paths
from treeline.operators.deletion import manifest_name
from treeline.schema import (
    INVENTORY, MANIFEST_COLUMNS, REGISTRY, REPORT_COLUMNS, conform, text_schema,
)
from treeline.sources import records, snapshots

# Quotes are doubled, values keep their spaces, and empty text stays empty.
CSV = {
    "header": "true", "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, files: str | list[str], columns: list[str]) -> DataFrame:
    """The named columns of CSV files as text, with source_csv and row_seq.

    Columns are matched by the header of each file; one that a file lacks is null. Cells may
    hold line breaks. Large files are read in as many tasks as they have blocks, and many
    files in the same few jobs; row_seq numbers the rows in the order of the files.
    """
    sources = [files] if isinstance(files, str) else list(files)
    if not sources:
        raise ValueError("At least one CSV path is required")
    return records.cells(spark, sources, columns, CSV)


def read_inventory_csv(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """CSV inventories in canonical form; the drive is taken from the path."""
    names = [f.name for f in text_schema()]
    raw = read_csv(spark, files, names)
    return conform(raw.where(F.col("path").isNotNull()).withColumn(
        "drive_id", paths.drive(F.col("path"))), from_csv=True)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV files with a header; an empty table still gives a file with the header."""
    df.write.options(**CSV, emptyValue="").mode("errorifexists").csv(folder)


def write_inventory_csv(df: DataFrame, folder: str) -> None:
    """An inventory for a spreadsheet: flags as True/False, times in ISO form."""
    columns = []
    for field in INVENTORY:
        if field.name in ("drive_id", "row_seq") or field.name not in df.columns:
            continue
        kind = field.dataType.simpleString()
        c = F.col(field.name)
        if kind == "boolean":
            c = F.when(c, "True").when(~c, "False")
        elif kind == "timestamp_ntz":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        columns.append(c.cast("string").alias(field.name))
    write_csv(df.select(*columns), folder)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    write_csv(manifest.select(*MANIFEST_COLUMNS), folder)


def write_manifests_per_drive(manifest: DataFrame, inventory_name: str, folder: str) -> None:
    """One job for all drives: a sub-folder `manifest=<stem>_delete_manifest.csv` each.

    `inventory_name` is the column with the name of the inventory a row came from.
    """
    named = manifest.select(
        *MANIFEST_COLUMNS, manifest_name(F.col(inventory_name)).alias("manifest"))
    named.write.options(**CSV, emptyValue="").partitionBy("manifest").csv(folder)


def write_empty_manifests(spark: SparkSession, inventories: list[str], folder: str) -> None:
    """A manifest with a header only for each inventory that has nothing to delete, in one job."""
    header = spark.createDataFrame([(i, ",".join(MANIFEST_COLUMNS)) for i in inventories],
                                   "inventory string, value string")
    named = header.select(manifest_name(F.col("inventory")).alias("manifest"), "value").distinct()
    named.write.mode("append").partitionBy("manifest").text(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.options(**CSV, multiLine=True).schema(
        text_schema(MANIFEST_COLUMNS)).csv(folder)


def write_report(report: DataFrame, folder: str) -> None:
    write_csv(report.select(*REPORT_COLUMNS), folder)


def read_report_input(spark: SparkSession, files: list[str]) -> DataFrame:
    """Only the columns the duplicates report needs, from several CSV inventories."""
    needed = [c for c in REPORT_COLUMNS if c != "source_csv"] + ["duplicate_kind", "is_dir"]
    rows = read_csv(spark, files, needed)
    return rows.withColumn("is_dir", F.lower("is_dir") == "true")


# Inventory tables: a phase reads the last version and writes the next, see sources.snapshots.

def read_table(
    spark: SparkSession, folder: str, drives: list[str] | None = None, with_key: bool = False
) -> DataFrame:
    """The last version of an inventory table, or some drives of it; empty when there is none."""
    found = snapshots.read(spark, folder, drives, with_key)
    return spark.createDataFrame([], INVENTORY) if found is None else found


def write_table(df: DataFrame, folder: str, drives: list[str] | None = None) -> int:
    """Write the next version, or only these drives of it, and return its number."""
    return snapshots.write(df, folder, drives)


def append_rows(df: DataFrame, folder: str) -> int:
    """Add rows to an inventory table as its next version."""
    return snapshots.append(df, folder)


def last_version(spark: SparkSession, folder: str) -> int | None:
    found = snapshots.last(spark, folder)
    return None if found is None else found.number


# The registry: a folder with one sub-folder per append. Only complete ones are read.
_APPENDS = T.StructType([
    *REGISTRY.fields, T.StructField("run", T.StringType()), T.StructField("row_no", T.LongType())])


def _appends(spark: SparkSession, folder: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = hadoop(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [e.getPath() for e in fs.listStatus(place) if e.getPath().getName().startswith("append_no=")]
    return sorted(int(p.getName()[10:]) for p in names if fs.exists(hadoop(p, "_SUCCESS")))


def append_registry(rows: DataFrame, folder: str, run: str = "") -> None:
    """Add rows to the registry as one append, seen as a whole or not at all.

    With the name of a `run`, what an earlier attempt of it added is not added again. One
    writer at a time.
    """
    spark = rows.sparkSession
    new = rows.select(*[f.name for f in REGISTRY])
    if run:
        known = read_registry(spark, folder).where(F.col("run") == run).select(
            F.col("original_path").alias("_path"), F.col("drive").alias("_drive"))
        same = F.col("original_path").eqNullSafe(F.col("_path")) & F.col("drive").eqNullSafe(F.col("_drive"))
        new = new.join(known, same, "left_anti")
    earlier = _appends(spark, folder)
    numbered = new.withColumns({"run": F.lit(run), "row_no": F.monotonically_increasing_id()})
    numbered.write.mode("overwrite").parquet(f"{folder}/append_no={earlier[-1] + 1 if earlier else 1}")


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The registry of kept files with append_no and row_no; one that does not exist is empty."""
    schema = T.StructType([*_APPENDS.fields, T.StructField("append_no", T.IntegerType())])
    numbers = _appends(spark, folder)
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(
        *[f"{folder}/append_no={n}" for n in numbers])
