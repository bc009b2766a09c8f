"""Consecutive batches of N rows in row order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from treeline.fixed_values import DEFAULT_BATCH_SIZE

# Order numbers per block; blocks per group of blocks.
BLOCK = 10_000
# Rows without an order number are dealt over so many numbers below zero.
NO_ORDER = 10 ** 12


def _running(counts: DataFrame, scope: list[str], by: str) -> DataFrame:
    before = Window.partitionBy(*scope).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def number_batches(
    df: DataFrame,
    size: int = DEFAULT_BATCH_SIZE,
    *,
    scope: tuple[str, ...] = ("drive_id",),
    order: str = "row_seq",
    then: list[Column] | None = None,
) -> DataFrame:
    """Add batch_id = position // size and batch_pos within each scope.

    Positions follow `order`, a whole number, then the `then` expressions. Rows without an
    order number come first, by a hash of `then`, so they spread over blocks too. The rank
    of a row is its rank within a block of order numbers plus the rows of all
    earlier blocks; those are summed in two levels, so that no window partition
    grows with the table.
    """
    keys = list(scope)
    tie = then or [F.col("path")]
    unnumbered = -1 - F.pmod(F.xxhash64(*tie), F.lit(NO_ORDER))
    rows = df.withColumn("_order", F.coalesce(F.col(order).cast("long"), unnumbered)).withColumns({
        "_block": F.floor(F.col("_order") / BLOCK),
        "_group": F.floor(F.col("_order") / (BLOCK * BLOCK)),
    })
    counts = rows.groupBy(*keys, "_group", "_block").agg(F.count("*").alias("n"))
    groups = _running(
        counts.groupBy(*keys, "_group").agg(F.sum("n").alias("n")), keys, "_group"
    ).select(*keys, "_group", F.col("_before").alias("_group_start"))
    blocks = _running(counts, [*keys, "_group"], "_block").join(
        groups, [*keys, "_group"]
    ).select(*keys, "_group", "_block", (F.col("_group_start") + F.col("_before")).alias("_start"))

    in_block = Window.partitionBy(*keys, "_group", "_block").orderBy("_order", *tie)
    placed = rows.withColumn("_rank", F.row_number().over(in_block)).join(
        blocks, [*keys, "_group", "_block"])
    position = F.col("_start") + F.col("_rank") - 1
    return placed.select(
        *[F.col(c) for c in df.columns],
        F.floor(position / size).alias("batch_id"),
        F.pmod(position, F.lit(size)).alias("batch_pos"),
    )


def assemble(
    numbered: DataFrame, fields: list[str], *, scope: tuple[str, ...] = ("drive_id",)
) -> DataFrame:
    """One row per batch: its items in order as JSON text. A batch holds `size` rows."""
    items = F.array_sort(F.collect_list(F.struct("batch_pos", F.struct(*fields).alias("item"))))
    plain = F.transform(items, lambda x: x["item"])
    return numbered.groupBy(*scope, "batch_id").agg(
        F.count("*").alias("n_rows"),
        F.to_json(plain, {"ignoreNullFields": "false"}).alias("items"),
    )
