"""Values and marks that flow down the path hierarchy.

A row takes its own value if it has one, else that of the nearest directory above
it, the root excluded. The work is done once per directory, not once per row: the
distinct parent directories are expanded into their ancestors, matched with the
stated values and reduced to one row per directory, which the rows then look up.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.functions.values import blank, upper_value
from treeline.operators.skew import HOT_ROWS, lookup_join

SCOPE = ("drive_id",)


def with_keys(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumns({
        "_key": paths.compare_key(F.col(path)),
        "_parent": paths.parent_key(F.col(path)),
    })


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def _directories(keyed: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct parent directories with the number of rows directly in them."""
    return (
        keyed.where(F.col("_parent").isNotNull())
        .groupBy(*scope, "_parent").agg(F.count("*").alias("n"))
    )


def _chain(directories: DataFrame, scope: list[str]) -> DataFrame:
    """One row per directory and directory on its way up; step 1 is itself."""
    return directories.select(
        *scope, "_parent",
        F.posexplode(paths.self_and_ancestor_keys(F.col("_parent"))).alias("_pos", "_key"),
    ).withColumn("_step", F.col("_pos") + 1).drop("_pos")


def _match_chain(
    directories: DataFrame, marks: DataFrame, scope: list[str], hot_rows: int
) -> DataFrame:
    """(directory, step, mark columns) for every marked directory on the way up.

    `marks` is unique per key. Counting the directories below each key first leaves
    only marks that have any, usually few enough for a broadcast at run time, and
    tells which of them are hot.
    """
    chain = _chain(directories, scope)
    on = [*scope, "_key"]
    below = chain.groupBy(*on).agg(F.count("*").alias("n"))
    return lookup_join(chain, marks.join(below, on), on, ["_parent"], "inner", hot_rows=hot_rows)


def _lookup_parent(
    keyed: DataFrame, found: DataFrame, directories: DataFrame, scope: list[str],
    spread: list[str], hot_rows: int,
) -> DataFrame:
    """Give every row what was found for the directory that holds it."""
    on = [*scope, "_parent"]
    return lookup_join(
        keyed, found.join(directories, on), on, spread, "left",
        counts=directories, hot_rows=hot_rows)


def resolve(
    df: DataFrame,
    columns: list[str],
    *,
    within: tuple[str, ...] = SCOPE,
    order: str = "row_seq",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `effective_<column>` and `<column>_distance` for each column.

    Distance 0 is a value stated for the path itself, n > 0 a value from the n-th
    directory up, null no value. Rows that name the same path share one value, the
    last one stated in `order`. A column the input lacks resolves to nulls.
    """
    scope = list(within)
    present = [c for c in columns if c in df.columns]
    absent = {}
    for c in columns:
        if c not in present:
            absent[f"effective_{c}"] = F.lit(None).cast("string")
            absent[f"{c}_distance"] = F.lit(None).cast("int")
    if not present:
        return df.withColumns(absent)

    keyed = with_keys(df)
    stated = {c: ~blank(F.col(c)) for c in present}
    position = F.struct(order, "path")

    # Only rows that state something are grouped; they are few next to all rows.
    by_key = keyed.where(_any(list(stated.values()))).groupBy(*scope, "_key").agg(
        F.count("*").alias("n"),
        *[F.max_by(F.col(c), F.when(stated[c], position)).alias(f"_own_{c}") for c in present])

    directories = _directories(keyed, scope)
    above = _match_chain(directories, by_key.drop("n"), scope, hot_rows).groupBy(
        *scope, "_parent"
    ).agg(*[
        F.min_by(
            F.struct(F.col(f"_own_{c}").alias("value"), F.col("_step").alias("step")),
            F.when(F.col(f"_own_{c}").isNotNull(), F.col("_step")),
        ).alias(f"_up_{c}")
        for c in present
    ])
    rows = _lookup_parent(keyed, above, directories, scope, ["path", order], hot_rows)

    # A row finds its own value here, and what another row of the same path states.
    rows = lookup_join(
        rows, by_key, [*scope, "_key"], ["path", order], "left", hot_rows=hot_rows)

    out = {}
    for c in present:
        own = F.coalesce(F.col(f"_own_{c}"), F.when(stated[c], F.col(c)))
        up = F.col(f"_up_{c}")
        out[f"effective_{c}"] = F.coalesce(own, up["value"])
        out[f"{c}_distance"] = F.when(own.isNotNull(), 0).otherwise(up["step"]).cast("int")
    keep = [F.col(c) for c in df.columns]
    return rows.select(*keep, *[e.alias(n) for n, e in {**out, **absent}.items()])


def source_text(column: str, path: str = "path") -> Column:
    """explicit / inherited from <directory> / unset, for a resolved column."""
    distance = F.col(f"{column}_distance")
    return (
        F.when(distance == 0, "explicit")
        .when(distance > 0, F.concat(F.lit("inherited from "),
                                     paths.ancestor_at(F.col(path), distance)))
        .otherwise("unset")
    )


def resolve_path(
    df: DataFrame, path: str, columns: list[str], *, order: str = "row_seq"
) -> DataFrame:
    """Effective values of one path, which need not be a row, with their origin.

    Result: one row per column with path, column_name, value and source. Only the
    rows on the way up are read; for each distance the last stated value counts. Where df
    has `path_key`, the keys on the way up go into the scan as a filter on it.
    """
    spark = df.sparkSession
    asked = spark.range(1).select(F.lit(path).alias("path"))
    steps = asked.select(
        "path", F.posexplode(paths.self_and_ancestor_keys(F.col("path"))).alias("_step", "_key")
    )
    present = [c for c in columns if c in df.columns]
    found = None
    if present:
        # The way up has as many rows as the path has parts.
        if "path_key" in df.columns:
            up = [r["_key"] for r in steps.select("_key").collect()]
            df = df.where(F.col("path_key").isin(up))
        on_the_way = df.withColumn("_key", paths.compare_key(F.col("path"))).select(
            "_key", F.struct(order, "path").alias("_at"), *present
        ).join(F.broadcast(steps), "_key")
        found = on_the_way.unpivot(
            ["_step", "_at"], present, "column_name", "value"
        ).where(~blank(F.col("value"))).groupBy("column_name").agg(
            F.min_by(
                F.struct("value", "_step"), F.struct(F.col("_step"), _newest_first(order))
            ).alias("hit")
        )
    names = asked.select("path", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    if found is None:
        hit = names.withColumn("hit", F.lit(None).cast("struct<value:string,_step:int>"))
    else:
        hit = names.join(found, "column_name", "left")
    step = F.col("hit._step")
    return hit.select(
        "path", "column_name", F.col("hit.value").alias("value"),
        F.when(step == 0, "explicit")
        .when(step > 0, F.concat(F.lit("inherited from "), paths.ancestor_at(F.col("path"), step)))
        .otherwise("unset").alias("source"),
    )


def _newest_first(order: str) -> Column:
    return -F.col(f"_at.{order}")


def paths_with_value(
    df: DataFrame, column: str, target: str, *, within: tuple[str, ...] = SCOPE,
    order: str = "row_seq", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Distinct paths whose effective value equals the target (trimmed, any case)."""
    resolved = resolve(df, [column], within=within, order=order, hot_rows=hot_rows)
    hit = upper_value(F.col(f"effective_{column}")) == target.strip().upper()
    return resolved.where(hit).select(*within, "path").distinct()


def keys_above(df: DataFrame, within: tuple[str, ...] = SCOPE) -> DataFrame:
    """Distinct keys of all directories above the given rows."""
    scope = list(within)
    directories = with_keys(df).select(*scope, "_parent").where(
        F.col("_parent").isNotNull()
    ).distinct()
    return _chain(directories, scope).select(*scope, "_key").distinct()


def mark_below(
    df: DataFrame, marked: DataFrame, name: str, *, with_self: bool,
    within: tuple[str, ...] = SCOPE, spread: str = "path", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the mark of a directory above the row (or of the row itself), else null.

    `marked` holds (scope columns, _key, _mark), one row per key; where marked
    directories lie inside each other the greatest mark counts. Pass a stored table:
    it is read several times.
    """
    scope = list(within)
    keyed = with_keys(df)
    directories = _directories(keyed, scope)
    under = _match_chain(directories, marked, scope, hot_rows).groupBy(*scope, "_parent").agg(
        F.max("_mark").alias("_above"))
    rows = _lookup_parent(keyed, under, directories, scope, [spread], hot_rows)
    mark = F.col("_above")
    if with_self:
        counts = keyed.groupBy(*scope, "_key").agg(F.count("*").alias("n"))
        rows = lookup_join(
            rows, marked.join(counts, [*scope, "_key"]), [*scope, "_key"], [spread], "left",
            hot_rows=hot_rows)
        mark = F.greatest(mark, F.col("_mark"))
    return rows.select(*[F.col(c) for c in df.columns], mark.alias(name))
