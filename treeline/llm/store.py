"""Stored tables that end a lineage, and small lookups that survive hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    Where it is unset and the session is a local one, a folder of this machine is set and
    used. On a cluster an unset folder is an error: executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % of


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str,
           total: int, n_parts: int) -> DataFrame:
    """Left join of rows with a table that is unique by `keys`.

    `weight` is a column of the table: how many rows have the key. A key is hot when it
    has more than total / n_parts rows, so at most n_parts keys are hot. Their table rows
    are broadcast, which is bounded by n_parts narrow rows; the others are shuffled.
    """
    hot = table.where(F.col(weight) * n_parts > total)
    values = [c for c in table.columns if c not in keys]
    packed = F.struct(*values)
    marked = rows.join(F.broadcast(hot.select(*keys, packed.alias("_hot"))), keys, "left")
    seldom = table.where(F.col(weight) * n_parts <= total).select(*keys, packed.alias("_seldom"))
    spread = marked.withColumn("_cold", F.when(F.col("_hot").isNull(), keys_struct(keys)))
    seldom = seldom.withColumn("_cold", keys_struct(keys)).drop(*keys)
    # A null key joins nothing; the salt only spreads the rows that are answered already.
    spread = spread.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.rand(7) * 1e9)
                               .otherwise(0).cast("long"))
    joined = spread.join(seldom.withColumn("_salt", F.lit(0).cast("long")),
                         ["_cold", "_salt"], "left")
    found = F.coalesce("_hot", "_seldom")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])


def keys_struct(keys: list[str]) -> Column:
    return F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
