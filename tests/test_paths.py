import ntpath
import random
from pathlib import PureWindowsPath

from pyspark.sql import functions as F

from treeline.functions import paths

PATHS = [
    "D:\\", "D:/a//b/", "D:\\a\\.\\b\\..\\c", "/mnt/d/x.txt", "\\\\srv\\share\\a\\b", "a/b",
    "D:a\\b", "D:\\\\f.txt", "D:", "a", ".", "./a", "D:\\a", "/a", "/", "\\\\srv\\share",
    "\\\\srv\\share\\", "\\\\srv\\share\\a", "D:/a/b.c/d e/", "D:.\\a", "D:\\a\\.", "a/./././b",
    "D:\\.hidden\\x", "..\\up", "C:\\a.b\\..", "d:\\x\\y:z\\", "D:\\ä\\Ö.TXT", "//srv/share/a/b",
]


def above(p):
    out, drive = [], PureWindowsPath(p).drive
    for a in PureWindowsPath(p).parents:
        if str(a) in (drive, drive + "\\"):
            break
        out.append(str(a))
    return out


def check(spark, values):
    c = F.col("p")
    rows = spark.createDataFrame([(v,) for v in values], "p string").select(
        "p", paths.normalize(c).alias("norm"), paths.drive(c).alias("drive"),
        paths.ancestors(c).alias("up"), paths.base_name(c).alias("name"),
        paths.parent(c).alias("parent"), paths.compare_key(c).alias("key"),
        paths.self_and_ancestor_keys(c).alias("keys"),
        paths.ancestor_at(c, F.lit(2)).alias("second"), paths.depth(c).alias("depth")).collect()
    for r in rows:
        want = PureWindowsPath(r.p)
        assert r.norm == str(want), r
        assert r.drive == want.drive, r
        assert r.up == above(r.p), r
        assert r.name == want.name, r
        assert r.parent == (above(r.p) or [None])[0], r
        assert r.second == (above(r.p) + [None, None])[1], r
        assert r.key == str(want).lower(), r
        assert r["keys"] == [str(want).lower()] + [a.lower() for a in above(r.p)], r
        assert r.depth == len(want.parts) - (1 if want.anchor else 0), r


def test_path_table(spark):
    check(spark, PATHS)


def test_random_paths(spark):
    rng = random.Random(7)
    pieces = ["a", "B c", ".", "..", ".x", "y.", "ü"]
    leads = ["", "D:", "D:\\", "/", "\\\\srv\\share\\", "c:/"]
    values = [
        rng.choice(leads) + rng.choice(["/", "\\", "\\\\"]).join(
            rng.choice(pieces) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "\\"])
        for _ in range(300)]
    # A lead of two separators followed by names is a share of its own; keep to the six leads.
    check(spark, [v for v in values if not v.startswith(("//", "\\\\")) or v.startswith("\\\\srv")])


def test_extension(spark):
    names = [".bashrc", "a.tar.gz", "x.", "A.PDF", "..a", ".a.b", "noext", "a.b.", "...", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", paths.extension(F.col("n")).alias("e")).collect()
    assert [r.e for r in rows] == [ntpath.splitext(n)[1].lower() for n in names]


def test_drive_letter_and_stem(spark):
    row = spark.range(1).select(
        paths.drive_letter(F.lit("D:\\x")).alias("a"), paths.drive_letter(F.lit("/mnt/d")).alias("b"),
        paths.stem(F.lit("reports/drive_d.csv")).alias("c"), paths.stem(F.lit("x/.csv")).alias("d"),
        paths.join_path(F.lit("D:\\"), F.lit("f.txt")).alias("e")).first()
    assert tuple(row) == ("D:", "", "drive_d", ".csv", "D:\\f.txt")
