"""Run the registered queries against DuckDB on one data folder and compare rows.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}


def _value(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return f"{type(v).__name__}:{v}"


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str | None, folder: str):
    """(equal, number of rows, text for a difference)."""
    df = query(spark, folder)
    names = df.columns
    mine = rows_of(names, df.collect())
    if sql is None:
        return True, len(mine), "rows only"
    cur = con.execute(sql)
    other = [c[0] for c in cur.description]
    theirs = rows_of(other, cur.fetchall())
    if sorted(names) != sorted(other):
        return False, len(mine), f"columns {sorted(names)} / {sorted(other)}"
    kinds = {c[0]: TYPES.get(str(c[1]).upper(), str(c[1])) for c in cur.description}
    if kinds != dict(df.dtypes):
        return False, len(mine), f"types {sorted(set(kinds.items()) ^ set(df.dtypes))}"
    if mine == theirs:
        return True, len(mine), ""
    left, right = Counter(mine), Counter(theirs)
    a, b = next(iter(left - right), None), next(iter(right - left), None)
    return False, len(mine), f"{len(mine)}/{len(theirs)} rows, first\n    {a}\n    {b}"


def main() -> None:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from checks.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = set(sys.argv[2:])
    spark, con = local_session(), connect(folder)
    bad = 0
    for q in QUERIES:
        if chosen and q.__name__ not in chosen:
            continue
        start = time.time()
        try:
            ok, n, text = compare(spark, con, q, ORACLE.get(q.__name__), folder)
        except Exception as e:
            ok, n, text = False, -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {q.__name__:32s} {n:7d} rows {time.time() - start:6.2f} s {text}",
              flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
