"""Where intermediate tables of jobs go: folders that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else one in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else (
        spark.conf.get("spark.sql.warehouse.dir", "").rstrip("/") + "/treeline_work")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own for one run; the writer creates it."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def work_folder(target: str) -> str:
    """Beside what a job writes, so on the same storage: the place of its intermediate tables."""
    return target.rstrip("/") + "_work"


def calls_folder(table: str) -> str:
    """Beside a table: the record of the model calls made for it, see sources.ledger."""
    return table.rstrip("/") + "_calls"


class Work:
    """The intermediate tables of one run of a job."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark = spark
        self.folder = f"{work_folder(target)}/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back, which ends its lineage."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def clear_work(spark: SparkSession, target: str) -> bool:
    """Remove the intermediate tables of finished jobs on a table or a manifest folder.

    What such a job returned can no longer be read afterwards. False if there were none.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_folder(target))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(place, True))
