"""The shape of the plans that has to hold at any size."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks import queries as q
from checks.queries import QUERIES
from treeline.operators import hierarchy
from treeline.operators.skew import HOT_ROWS, hot_keys, lookup_join
from treeline.plans import sample_inventory as sample
from treeline.schema import INVENTORY

FOLDER = "/root/testdata/sf0.001"
STREAMED = {"incremental_inventory"}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("query", [x for x in QUERIES if x.__name__ not in STREAMED],
                         ids=lambda x: x.__name__)
def test_no_cross_join_and_no_row_python(spark, query):
    text = plan(query(spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_inheritance_reads_only_its_columns(spark):
    table = spark.read.schema(INVENTORY).parquet(sample.ingest(spark, FOLDER))
    df = hierarchy.resolve(table, ["decision"]).select("path", "effective_decision")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))
    names = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert schemas and names == {"drive_id", "row_seq", "path", "decision"}


def test_only_bounded_tables_are_broadcast_without_statistics(spark):
    """With automatic broadcasts off, only the tables of hot keys are still broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = hierarchy.resolve(sample.conformed(spark, FOLDER), ["decision"])
        tree = plan(df).split("\n\n\n")[0]
        assert "SortMergeJoin" in tree
        found = df._jdf.queryExecution().executedPlan().toString()
        below = [found[m.start():].split("\n")[1:4] for m in re.finditer("BroadcastExchange", found)]
        assert below and all(any(f">= {HOT_ROWS}" in line for line in lines) for lines in below)
        want = sorted(map(tuple, df.select("path", "effective_decision").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    again = hierarchy.resolve(sample.conformed(spark, FOLDER), ["decision"])
    assert want == sorted(map(tuple, again.select("path", "effective_decision").collect()), key=repr)


def test_texts_are_not_read_for_names(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(q.content_route(spark, FOLDER)))
    names = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert schemas and not names & {"text", "html"}


def test_hot_keys_are_the_heaviest(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 50), ("c", 7)], "k string, n long")
    assert sorted((r.k, r["_buckets"]) for r in hot_keys(counts, ["k"], 6).collect()) == [("b", 9), ("c", 2)]


def test_no_number_of_hot_keys_is_cut(spark):
    """Far more hot keys than any routing table used to hold, and one key of many thresholds."""
    rows = spark.range(9000).selectExpr("id", "if(id < 3000, -1, id div 2) as k")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = lookup_join(rows, table, ["k"], ["id"], hot_rows=2)
    assert hot_keys(table, ["k"], 2).count() == 3001
    assert out.count() == 9000 and out.where("least is null or least > id").count() == 0
