"""Versions of an inventory table that share the files of what did not change.

Data lies in `data/<write>/drive_part=<drive>` folders that nothing changes any more. A version
is one small file in `commits` with the schema and, for each drive, the folders that hold
it. A write that breaks off leaves a folder that no version names. A version is named by the
first writer that creates its file; a second one with the same number fails.

Rows lie in ranges of `path_key`, the form of a path in which it is compared, so a filter on
it reads few row groups. Readers get the schema from the version and look into no footer for it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import paths

KEY = "path_key"
_PART = "drive_part"


@dataclass
class Version:
    number: int
    schema: T.StructType
    #: Folders, relative to the table, by drive.
    parts: dict[str, list[str]]


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, file) -> str:
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _fs(spark, folder)
    place = path(f"{folder}/commits")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def last(spark: SparkSession, folder: str) -> Version | None:
    """The last whole version; a file that its writer did not finish is passed over."""
    path, _ = _fs(spark, folder)
    for number in reversed(_numbers(spark, folder)):
        try:
            told = json.loads(_read_text(spark, path(f"{folder}/commits/{number:09d}.json")))
        except ValueError:
            continue
        return Version(number, T.StructType.fromJson(told["schema"]), told["parts"])
    return None


def read(
    spark: SparkSession, folder: str, drives: list[str] | None = None, with_key: bool = False
) -> DataFrame | None:
    """The rows of the last version, of all drives or of some; None when there is none.

    `with_key` adds `path_key`, by which the files are ordered.
    """
    version = last(spark, folder)
    if version is None:
        return None
    wanted = [p for d, own in version.parts.items() if drives is None or d in drives for p in own]
    schema = T.StructType([*version.schema.fields, T.StructField(KEY, T.StringType())])
    shown = [f.name for f in (schema if with_key else version.schema).fields]
    if not wanted:
        return spark.createDataFrame([], T.StructType([schema[n] for n in shown]))
    return spark.read.schema(schema).parquet(*[f"{folder}/{p}" for p in wanted]).select(*shown)


def _written(df: DataFrame, folder: str) -> dict[str, list[str]]:
    """Write rows to folders of their own; returns these by drive."""
    spark, place = df.sparkSession, f"data/{uuid.uuid4().hex}"
    # A letter in front: an empty name is no name for a folder.
    named = df.withColumns({KEY: paths.compare_key(F.col("path")),
                            _PART: F.concat(F.lit("d"), F.coalesce("drive_id", F.lit("")))})
    ordered = named.repartitionByRange(_PART, KEY).sortWithinPartitions(_PART, KEY)
    ordered.write.partitionBy(_PART).parquet(f"{folder}/{place}")
    path, fs = _fs(spark, folder)
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{folder}/{place}")) if s.isDirectory()]
    return {unescape(n.partition("=")[2])[1:]: [f"{place}/{n}"] for n in names if n.startswith(f"{_PART}=")}


def _commit(spark: SparkSession, folder: str, number: int, schema: T.StructType, parts: dict) -> int:
    path, fs = _fs(spark, folder)
    told = json.dumps({"schema": schema.jsonValue(), "parts": parts})
    out = fs.create(path(f"{folder}/commits/{number:09d}.json"), False)
    try:
        out.write(bytearray(told.encode()))
    finally:
        out.close()
    return number


def _plain(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields if f.name != KEY])


def write(df: DataFrame, folder: str, drives: list[str] | None = None) -> int:
    """Make df the next version, or the next rows of these drives only; returns its number.

    With `drives` the files of all others stay as they are, and df has rows of these only.
    """
    spark, df = df.sparkSession, df.drop(KEY)
    before, schema = last(spark, folder), _plain(df.schema)
    parts = _written(df, folder)
    if drives is not None:
        other = set(parts) - set(drives)
        if other:
            raise ValueError(f"Rows of other drives than {drives}: {sorted(other)}")
        if before is not None:
            parts = {d: p for d, p in before.parts.items() if d not in drives} | parts
            schema = _merged(before.schema, schema)
    return _commit(spark, folder, _next(spark, folder), schema, parts)


def append(df: DataFrame, folder: str) -> int:
    """Add rows: the next version has the files of the last one and new ones."""
    spark, df = df.sparkSession, df.drop(KEY)
    before, schema = last(spark, folder), _plain(df.schema)
    parts = _written(df, folder)
    if before is not None:
        for drive, own in before.parts.items():
            parts[drive] = own + parts.get(drive, [])
        schema = _merged(before.schema, schema)
    return _commit(spark, folder, _next(spark, folder), schema, parts)


def _next(spark: SparkSession, folder: str) -> int:
    numbers = _numbers(spark, folder)
    return numbers[-1] + 1 if numbers else 0


def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; files that lack one give nulls. A type cannot change for some files only."""
    for field in new.fields:
        if field.name in old.names and old[field.name].dataType != field.dataType:
            raise ValueError(f"Column {field.name} is {old[field.name].dataType.simpleString()} in other files, "
                             f"{field.dataType.simpleString()} in these")
    return T.StructType([*old.fields, *(f for f in new.fields if f.name not in old.names)])
