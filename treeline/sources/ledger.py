"""A lasting record of model calls: what has been answered once is not asked again.

A call is known by a digest of the model's name and everything it is sent. The open calls are
dealt to small tasks, each of which writes its replies where they stay as soon as it has them; all
tasks that run at once have about one wave of calls, so a job that dies loses one wave at most. Every row of
the table is a true reply or the error of one attempt; it stays right whichever other rows are there,
so a job that is written in part needs no repair.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "digest string, reply string, error string, run string, wave int"
#: Calls that may be made and not yet written.
WAVE = 1000
#: Tasks of one Spark job.
TASKS = 10_000

#: (reply, None) or (None, error) for the values of one call.
Answer = Callable[..., tuple[str | None, str | None]]


def call_digest(inputs: list[str], model: str = "") -> Column:
    """Lengths stand before the values, so no two lists of values run together alike."""
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in
             (F.lit(model), *(F.coalesce(F.col(i), F.lit("")) for i in inputs))]
    return F.sha2(F.concat(*parts), 256)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts so far; a folder that does not exist yet is empty."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def open_calls(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Calls (with `digest`) without a reply, one of each digest."""
    return calls.dropDuplicates(["digest"]).join(
        ledger.where(F.col("reply").isNotNull()).select("digest"), "digest", "left_anti")


def _asked(calls: DataFrame, answer: Answer, inputs: list[str], tasks: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [answer(*values) for values in zip(*(frame[c] for c in inputs))]
            yield pd.DataFrame({"digest": frame["digest"].to_list(), "reply": [f[0] for f in found],
                                "error": [f[1] for f in found]})

    return calls.select("digest", *inputs).repartition(tasks, "digest").mapInPandas(
        run, "digest string, reply string, error string")


def ask_all(
    calls: DataFrame, folder: str, answer: Answer, inputs: list[str], *, model: str = "", run: str = "",
    wave: int = WAVE, concurrency: int | None = None,
) -> DataFrame:
    """Make the open calls and return all calls with `reply` and `error`.

    `calls` is a stored table whose columns `inputs` are what is sent; equal calls are made once. Only
    replies are final: a call that failed is made again by the next run, and its error
    stands until then. `concurrency` caps the number of parallel callers, which else is that of
    Spark's task slots. Each has about wave / callers calls, one at least, between two
    writes. A task that is repeated asks again, so the model has to allow repeats.
    """
    spark = calls.sparkSession
    named = calls.withColumn("digest", call_digest(inputs, model))
    left = open_calls(named, read_ledger(spark, folder)).select("digest", *inputs)
    callers = concurrency or spark.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(left.count() / max(1, wave // callers)))
    # With a cap, a job has no more tasks than may run at once.
    per_job = min(tasks, concurrency or TASKS)
    jobs = math.ceil(tasks / per_job)
    opened = left.withColumn("job", F.pmod(F.xxhash64("digest"), F.lit(jobs)).cast("int"))
    name = uuid.uuid4().hex
    if jobs > 1:
        # Each job reads its own calls only. To readers of the ledger a name with a leading underscore is hidden.
        opened.repartition("job").write.partitionBy("job").parquet(f"{folder}/_open/{name}")
        opened = spark.read.schema(opened.schema).parquet(f"{folder}/_open/{name}")
    for k in range(jobs):
        done = _asked(opened.where(F.col("job") == k), answer, inputs, per_job)
        number = F.lit(k * per_job) + F.spark_partition_id()
        # Version 2 of the committer: what a task has written stays, whatever becomes of its job.
        done.withColumns({"run": F.lit(run), "wave": number}).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    if jobs > 1:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_open/{name}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return outcomes(named, read_ledger(spark, folder)).drop("digest")


def outcomes(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Calls with their reply, or the error of an attempt where there is no reply."""
    known = ledger.groupBy("digest").agg(F.min("reply").alias("reply"), F.max("error").alias("error"))
    return calls.join(known.withColumn("error", F.when(F.col("reply").isNull(), F.col("error"))), "digest", "left")
