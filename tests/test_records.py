"""CSV records over splits, headers, line breaks and quotes."""

import csv
import random

import pytest

from treeline.sources import records, tables


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 200 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def write(path, header, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        out.writerows([[r[c] for c in header] for r in rows])
    return str(path)


def test_cells_with_breaks_and_quotes_over_blocks(spark, tmp_path, small_blocks):
    draw, want, files = random.Random(7), [], []
    texts = ["", "a,b", 'say "hi"\nthen\n\n"x" ', "l1\r\nl2", " sp ", '"', '""\n', "é\n" * 90, "plain", "w " * 200]
    (tmp_path / "a b+c").mkdir()
    for k in range(4):
        header = ["x", "other", "comment", "path"] if k % 2 else ["path", "comment", "x"]
        rows = [{"path": f"p{k}_{i}", "comment": draw.choice(texts), "x": str(i), "other": "\n"} for i in range(40)]
        files.append(write(tmp_path / "a b+c" / f"f{k}%20.csv", header, rows, "\r\n" if k == 2 else "\n"))
        want += [(r["path"], r["comment"] or None, r["x"], None, files[-1]) for r in rows]
    blocks = records.block_table(spark, files)
    assert blocks.count() > 20 and blocks.where("starts_odd = 1").count() > 3
    got = tables.read_csv(spark, files, ["path", "comment", "x", "missing"])
    rows = got.orderBy("row_seq").collect()
    assert [tuple(r)[:5] for r in rows] == want
    assert [r.row_seq for r in rows] == list(range(len(want)))
    assert {r.row_seq: r.path for r in got.collect()} == {r.row_seq: r.path for r in rows}


def test_a_header_longer_than_its_block(spark, tmp_path, small_blocks):
    header = [f"column {i}\nof many" for i in range(60)] + ["path"]
    file = write(tmp_path / "h.csv", header, [dict.fromkeys(header, "v\n")])
    row = tables.read_csv(spark, file, ["path", "column 41\nof many"]).first()
    assert tuple(row)[:2] == ("v\n", "v\n")


def test_short_rows_empty_lines_marks_and_repeated_names(spark, tmp_path):
    file = tmp_path / "odd.csv"
    file.write_bytes('﻿path,comment,path\r\na,1\r\n\r\nb\r\nc,"",z,too,many\r\nlast,"x"'.encode())
    rows = tables.read_csv(spark, str(file), ["path", "comment"]).orderBy("row_seq").collect()
    assert [(r.path, r.comment) for r in rows] == [("a", "1"), ("b", None), ("c", None), ("last", "x")]


def test_folders_patterns_and_empty_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("1", "2"):
        write(tmp_path / "d" / f"p{n}.csv", ["path"], [{"path": n}])
    write(tmp_path / "none.csv", ["path"], [])
    (tmp_path / "void.csv").write_text("")
    sources = [str(tmp_path / "none.csv"), str(tmp_path / "void.csv"), str(tmp_path / "d")]
    rows = tables.read_csv(spark, sources, ["path"]).orderBy("row_seq").collect()
    assert [(r.path, r.source_csv) for r in rows] == [("1", sources[2]), ("2", sources[2])]
    assert tables.read_csv(spark, str(tmp_path / "d" / "p*.csv"), ["path"]).count() == 2
    assert tables.read_csv(spark, sources[:2], ["path"]).count() == 0


def test_a_quote_left_open_is_an_error(spark, tmp_path):
    file = tmp_path / "open.csv"
    file.write_text('path\n"a\nb\n')
    with pytest.raises(ValueError, match="open.csv"):
        tables.read_csv(spark, str(file), ["path"])


def test_many_files_are_no_many_jobs(spark, tmp_path):
    files = [write(tmp_path / f"{i}.csv", ["path"], [{"path": str(i)}]) for i in range(30)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("csv", "csv")
    try:
        assert tables.read_csv(spark, files, ["path"]).count() == 30
        assert len(tracker.getJobIdsForGroup("csv")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
