"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.store import stored

MOST_ROUNDS = 60


def _print_of(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(hi, lo): each node that is not the smallest of its component, and that smallest.

    Every step is an aggregation and a join; a round ends in a stored table. Without edges
    the result is empty.
    """
    now = stored(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                 .where("hi > lo").distinct(), "edges")
    seen = _print_of(now)
    if not seen[0]:
        return now
    for _ in range(MOST_ROUNDS):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        now = stored(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        last, seen = seen, _print_of(now)
        if seen == last:
            return now
    raise RuntimeError("components did not settle")
