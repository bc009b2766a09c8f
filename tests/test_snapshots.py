"""Versions of a table: what a write leaves alone, what readers see, what a lookup reads."""

import os

import pytest
from pyspark.sql import functions as F

from treeline.operators import hierarchy
from treeline.plans import jobs
from treeline.schema import conform
from treeline.sources import snapshots, tables


def rows(spark, *found, more=""):
    return conform(spark.createDataFrame(
        list(found), "drive_id string, row_seq bigint, path string, decision string" + more))


def files(folder):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(folder)
            for n in names if n.endswith(".parquet")}


def read(spark, folder, *names):
    return sorted(tuple(r[n] for n in names) for r in tables.read_table(spark, folder).collect())


def test_a_phase_on_one_drive_leaves_the_files_of_others(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert tables.read_table(spark, folder).count() == 0 and tables.last_version(spark, folder) is None
    tables.write_table(rows(spark, ("C:", 1, "C:\\a", None), ("D: é/=%", 2, "D:\\b", None), ("", 3, "\\m", None)), folder)
    before = files(folder)
    part = tables.read_table(spark, folder, ["C:"]).withColumn("extra", F.lit(7))
    assert part.count() == 1
    tables.write_table(part.withColumn("decision", F.lit("KEEP")), folder, ["C:"])
    assert read(spark, folder, "drive_id", "decision", "extra") == sorted(
        [("C:", "KEEP", 7), ("D: é/=%", None, None), ("", None, None)], key=lambda r: r[0])
    assert {f: t for f, t in files(folder).items() if f in before} == before
    named = {p for own in snapshots.last(spark, folder).parts.values() for p in own}
    assert len([f for f in files(folder) if any(p + "/" in f for p in named)]) == 3
    with pytest.raises(ValueError, match="other drives"):
        tables.write_table(tables.read_table(spark, folder), folder, ["C:"])
    with pytest.raises(ValueError, match="extra is int"):
        tables.append_rows(rows(spark, ("C:", 9, "C:\\z", None, "x"), more=", extra string"), folder)


def test_jobs_on_some_drives(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.write_table(rows(spark, ("C:", 1, "C:\\a", None), ("D:", 2, "D:\\b", None)), folder)
    before = files(folder)
    jobs.rate(spark, folder, lambda p: "[]", jobs.Options(drives=["D:"]))
    assert read(spark, folder, "drive_id", "recommendation") == [("C:", None), ("D:", "REVIEW")]
    assert len(set(files(folder)) - set(before)) == 1


def test_appended_rows_join_the_files_there_are(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.append_rows(rows(spark, ("C:", 1, "C:\\a", None)), folder)
    tables.append_rows(rows(spark, ("C:", 2, "C:\\b", None), ("D:", 3, "D:\\c", None)), folder)
    assert read(spark, folder, "row_seq") == [(1,), (2,), (3,)]
    assert tables.last_version(spark, folder) == 1 and len(files(folder)) == 3


def test_a_write_that_breaks_off_is_never_seen(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.write_table(rows(spark, ("C:", 1, "C:\\a", None)), folder)
    broken = rows(spark, ("C:", 2, "C:\\b", None)).withColumn("boom", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        tables.write_table(broken, folder)
    assert read(spark, folder, "row_seq") == [(1,)]
    (tmp_path / "t" / "commits" / "000000001.json").write_text('{"schema": {"fie')
    assert read(spark, folder, "row_seq") == [(1,)]
    assert tables.write_table(rows(spark, ("C:", 3, "C:\\c", None)), folder) == 2
    assert read(spark, folder, "row_seq") == [(3,)]


def test_two_writers_cannot_name_one_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    tables.write_table(rows(spark, ("C:", 1, "C:\\a", None)), folder)
    monkeypatch.setattr(snapshots, "_next", lambda *a: 0)
    with pytest.raises(Exception, match="exists"):
        tables.write_table(rows(spark, ("C:", 2, "C:\\b", None)), folder)
    assert read(spark, folder, "row_seq") == [(1,)]


def test_a_point_lookup_filters_the_scan_by_key(spark, tmp_path):
    folder = str(tmp_path / "t")
    many = spark.range(20_000).select(
        F.lit("D:").alias("drive_id"), F.col("id").alias("row_seq"), F.format_string("D:\\Dir%03d\\f%d.txt", F.col("id") % 200, "id").alias("path"),
        F.when(F.col("id") == 77, "KEEP").alias("decision"))
    tables.write_table(conform(many.unionByName(rows(spark, ("D:", -1, "D:\\Dir042", "DELETE")).select(many.columns))), folder)
    found = {r.column_name: (r.value, r.source) for r in jobs.resolve(spark, folder, "d:/dir042/new.bin").collect()}
    assert found["decision"] == ("DELETE", "inherited from d:\\dir042") and found["review"] == (None, "unset")
    out = hierarchy.resolve_path(tables.read_table(spark, folder, with_key=True), "D:\\Dir042\\x", ["decision"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(path_key, [d:\\dir042,d:\\dir042\\x])]" in plan
    # Files are ranges of the key: few of them can hold one directory.
    holding = tables.read_table(spark, folder, with_key=True).where("path_key = 'd:\\\\dir042'").select(F.input_file_name()).distinct()
    assert holding.count() == 1
