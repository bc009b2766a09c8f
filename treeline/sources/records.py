"""CSV files of any size as records, in as many tasks as they have blocks.

A record ends at a line break outside of quotes, and a block of a file cannot know whether it
begins inside of quotes. Blocks are therefore read under both assumptions: for every
line the quotes before it in its block are counted, and the record ends under either. A first pass
keeps one row per block; running sums over the blocks of each file then tell how
each one really begins and how many records precede it. The second pass gives every line the
number of its record. Records of one line, nearly all, stay where they are; only lines of longer
records are brought together.

Quotes stand around whole cells and are doubled inside, as writers leave them.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.sources.workspace import new_folder

_LINE = "file string, block bigint, at bigint, value string, odd_before int, odd_after int, ends_even bigint, ends_odd bigint"
_BLOCK = "file string, block bigint, odd int, ends_even bigint, ends_odd bigint, head string, head_whole boolean"


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    # Only the line feed splits, so a carriage return inside of a cell stays what it is.
    raw = spark.read.option("lineSep", "\n").text(files)
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"), "value")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], dict[str, np.ndarray]]]:
    """Each batch with where its blocks begin, and per line the counts since its block began."""
    last, carried = None, {"at": 0, "quotes": 0, "even": 0, "odd": 0}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column("file"), np.asarray(batch.column("block"))
        turn = np.ones(n, bool)
        turn[1:] = (block[1:] != block[:-1]) | np.asarray(pc.not_equal(file[1:], file[:-1]))
        turn[0] = (file[0].as_py(), int(block[0])) != last
        begin = np.flatnonzero(turn)
        of = np.cumsum(turn) - 1  # -1: goes on from the batch before
        first = np.where(of < 0, 0, begin[of] if len(begin) else 0)

        def since(values: np.ndarray, name: str) -> np.ndarray:
            past = np.cumsum(values)
            out = past - past[first] + values[first]
            out[of < 0] += carried[name]
            carried[name] = int(out[-1])
            return out

        quotes = np.asarray(pc.fill_null(pc.count_substring(batch.column("value"), '"'), 0)).astype(np.int64)
        after = since(quotes, "quotes")
        counts = {"odd_before": (after - quotes) % 2, "odd_after": after % 2}
        ones = np.ones(n, np.int64)
        counts["at"] = since(ones, "at") - 1
        for name, odd in (("even", 0), ("odd", 1)):
            ends = (counts["odd_after"] == odd).astype(np.int64)
            counts[name] = since(ends, name) - ends
            counts[name + "_all"] = counts[name] + ends
        last = (file[n - 1].as_py(), int(block[n - 1]))
        yield batch, begin.tolist(), counts


def _per_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, c in _counted(batches):
        yield pa.RecordBatch.from_arrays([
            batch.column("file"), batch.column("block"), pa.array(c["at"], pa.int64()), batch.column("value"),
            pa.array(c["odd_before"], pa.int32()), pa.array(c["odd_after"], pa.int32()),
            pa.array(c["even"], pa.int64()), pa.array(c["odd"], pa.int64())],
            ["file", "block", "at", "value", "odd_before", "odd_after", "ends_even", "ends_odd"])


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block, sent on when the next one begins; `head` is the first record of a file."""
    now: list | None = None

    def out(row: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                          ["file", "block", "odd", "ends_even", "ends_odd", "head", "head_whole"])

    for batch, begin, c in _counted(batches):
        cuts = [*begin, batch.num_rows]
        if not begin or begin[0]:
            cuts = [0, *cuts]
        for a, b in zip(cuts, cuts[1:]):
            file, block = batch.column("file")[a].as_py(), batch.column("block")[a].as_py()
            if now is not None and now[:2] != [file, block]:
                yield out(now)
                now = None
            if now is None:
                now = [file, block, 0, 0, 0, None if block else "", bool(block)]
            now[2], now[3], now[4] = int(c["odd_after"][b - 1]), int(c["even_all"][b - 1]), int(c["odd_all"][b - 1])
            if not now[6]:
                ends = np.flatnonzero(c["odd_after"][a:b] == 0)
                past = a + int(ends[0]) + 1 if len(ends) else b
                more = [v or "" for v in batch.column("value")[a:past].to_pylist()]
                now[5] = "\n".join(([now[5]] if now[5] else []) + more)
                now[6] = bool(len(ends))
    if now is not None:
        yield out(now)


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def block_table(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, starts_odd, base, head, head_whole), stored: how each block begins, records before it.

    Raises if a file ends inside of quotes: what follows its last lone quote has no defined records.
    """
    found = _stored(_lines(spark, files).mapInArrow(_per_block, _BLOCK), "csv_blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = found.withColumn("starts_odd", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    ends = F.when(F.col("starts_odd") == 0, F.col("ends_even")).otherwise(F.col("ends_odd"))
    out = parity.withColumn("ends", ends).withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    open_files = found.groupBy("file").agg(F.sum("odd").alias("s")).where("s % 2 = 1").limit(5).collect()
    if open_files:
        raise ValueError("Files end inside of quotes: " + ", ".join(r["file"] for r in open_files))
    return _stored(out.select("file", "block", "starts_odd", "base", "ends", "head", "head_whole"), "csv_starts")


def records(spark: SparkSession, files: list[str], blocks: DataFrame) -> DataFrame:
    """(file, record, text): every record with its number in its file; the header is number 0.

    A carriage return at the end of a record belongs to the line break and goes.
    """
    placed = _lines(spark, files).mapInArrow(_per_line, _LINE).join(
        blocks.select("file", "block", "starts_odd", "base"), ["file", "block"])
    odd = F.col("starts_odd")
    number = F.col("base") + F.when(odd == 0, F.col("ends_even")).otherwise(F.col("ends_odd"))
    starts, ends = F.col("odd_before") == odd, F.col("odd_after") == odd
    rows = placed.select("file", "block", "at", "value", number.alias("record"),
                         (starts & ends).alias("whole"))
    several = rows.where(~F.col("whole")).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("v"))
    joined = F.array_join(F.transform("v", lambda x: F.coalesce(x["value"], F.lit(""))), "\n")
    every = rows.where("whole").select("file", "record", F.col("value").alias("text")).unionByName(
        several.select("file", "record", joined.alias("text")))
    return every.withColumn("text", F.regexp_replace("text", "\r$", ""))


def header_names(line: str) -> list[str]:
    """Column names of a header record; a byte order mark in front goes."""
    return next(csv.reader([line.removeprefix("﻿").removesuffix("\r")], strict=False), [])


def _headers(spark: SparkSession, files: list[str], blocks: DataFrame) -> DataFrame:
    """(file, head) of all files."""
    first = blocks.where("block = 0").select("file", "head", "head_whole")
    if first.where("not head_whole").limit(1).collect():
        # A header longer than its block: taken from the records.
        return records(spark, files, blocks).where("record = 0").select("file", F.col("text").alias("head"))
    return first.select("file", "head")


def sources_of(spark: SparkSession, sources: list[str]) -> list[tuple[str, str, int]]:
    """(file or folder, source, position of the source) of paths, folders and patterns."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for i, source in enumerate(sources):
        place = path(source)
        fs = place.getFileSystem(conf)
        found = fs.globStatus(place)
        if not found:
            raise FileNotFoundError(source)
        out += [(fs.makeQualified(s.getPath()).toUri().getPath(), source, i) for s in found]
    return out


def _plain(file: Column) -> Column:
    """The path of a file without scheme and authority, as the listing of the sources has it."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(file, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B"))


def cells(spark: SparkSession, sources: list[str], columns: list[str], options: dict[str, str]) -> DataFrame:
    """The named columns of all records as text, with source_csv and row_seq.

    Columns are found by the header of each file; of two with one name the first counts, one that a
    file lacks is null. Empty records are left out. row_seq ascends by source, file and record
    and is the same whenever the files are read.
    """
    blocks = block_table(spark, sources)
    heads = _headers(spark, sources, blocks).withColumn("plain", _plain(F.col("file")))
    listed = spark.createDataFrame(sources_of(spark, sources), "place string, source_csv string, source_no int")
    listed = listed.groupBy("place").agg(F.min(F.struct("source_no", "source_csv")).alias("s"))
    place = F.explode(F.array("plain", F.regexp_replace("plain", "/[^/]*$", "")))
    files = heads.withColumn("place", place).join(listed, "place").select(
        "file", "head", "s.source_csv", "s.source_no")
    sizes = blocks.groupBy("file").agg((F.sum("ends") - 1).alias("n"))  # without the header
    earlier = Window.orderBy("source_no", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.join(sizes, "file").withColumn("first_row", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # One small row per distinct header comes to the driver, and gives each column's place.
    known = [r["head"] for r in files.select("head").distinct().collect()]
    width = max((len(header_names(h)) for h in known), default=0)
    places = [(h, [names.index(c) if c in names else -1 for c in columns])
              for h, names in ((h, header_names(h)) for h in known)]
    shapes = spark.createDataFrame(places, "head string, places array<int>")
    files = _stored(files.join(shapes, "head").drop("head"), "csv_files")

    parsed = F.from_csv("text", ", ".join(f"_{i} string" for i in range(max(width, 1))),
                        {**{k: v for k, v in options.items() if k not in ("header", "encoding")},
                         "maxCharsPerColumn": "-1", "maxColumns": str(max(width, 1) + 1024)})
    rows = records(spark, sources, blocks).where("record > 0 and text <> ''").join(files, "file")
    rows = rows.withColumn("cell", parsed)
    cell = F.array(*(F.col(f"cell._{i}") for i in range(max(width, 1))))
    rows = rows.withColumn("cell", cell)
    return rows.select(
        *(F.get("cell", F.when(F.get("places", F.lit(i)) >= 0, F.get("places", F.lit(i)))).alias(c)
          for i, c in enumerate(columns)),
        "source_csv", (F.col("first_row") + F.col("record") - 1).alias("row_seq"))
