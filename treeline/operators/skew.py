"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with at least this many rows is spread over buckets of about so many rows. The
# routing table of hot keys has at most rows / HOT_ROWS entries, so it is broadcast.
HOT_ROWS = 1_000_000
# Rows without a key never match; they are spread over this many buckets.
NULL_SALTS = 4096


def _buckets(hot_rows: int) -> Column:
    """Buckets of a key with n rows; at least two once it is hot."""
    return F.when(F.col("n") >= hot_rows, F.greatest(F.ceil(F.col("n") / hot_rows), F.lit(2))
                  ).otherwise(F.lit(1)).cast("int")


def hot_keys(counts: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The heavy keys of a table of (key columns, n) and their number of buckets."""
    return counts.where(F.col("n") >= hot_rows).select(*on, _buckets(hot_rows).alias("_buckets"))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "left",
    *,
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join rows to a lookup that is unique on `on` and whose `n` counts their rows.

    Rows of hot keys get a salt from the `spread` columns (so a recomputed task draws
    the same one) and the lookup rows of such keys are repeated once per salt; all
    other keys join as usual. `counts` (keys, n) may name hot keys that the lookup
    lacks. Which keys are hot decides where a row travels, never what it is joined to.
    """
    hot = hot_keys(lookup if counts is None else counts, on, hot_rows)
    bucket = F.xxhash64(*spread)
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    left = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.when(keyless, F.pmod(bucket, F.lit(NULL_SALTS)))
        .when(F.col("_buckets").isNotNull(), F.pmod(bucket, F.col("_buckets")))
        .otherwise(F.lit(0)).cast("int"),
    ).drop("_buckets")
    last = _buckets(hot_rows) - 1
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("n")
    return left.join(right, on + ["_salt"], how).drop("_salt")
