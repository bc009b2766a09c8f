import random
from pathlib import PureWindowsPath

from pyspark.sql import functions as F

from treeline.functions.values import blank, unset
from treeline.operators import deletion, hierarchy
from treeline.operators.skew import lookup_join
from treeline.schema import conform

TREE = [
    (r"D:\Users\Stephen\Documents", True, None, "KEEP"),
    (r"D:\Users\Stephen\Documents\resume.docx", False, "True", None),
    (r"D:\Users\Stephen\Documents\old\letter.pdf", False, None, "DELETE"),
    (r"D:\Users\Stephen\Documents\old", True, None, ""),
    (r"D:\Windows", True, None, "DELETE"),
    (r"D:\Windows\notepad.exe", False, None, "  "),
    (r"D:\Unreviewed\file.txt", False, None, None),
]
WANT = ["KEEP", "KEEP", "DELETE", "KEEP", "DELETE", "DELETE", None]


def frame(spark, rows):
    data = [("D", i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "drive_id string, row_seq long, path string, is_dir boolean, review string, decision string")


def test_literal_tree(spark):
    out = hierarchy.resolve(frame(spark, TREE), ["decision", "owner"]).withColumn(
        "source", hierarchy.source_text("decision")).orderBy("row_seq").collect()
    assert [r.effective_decision for r in out] == WANT
    assert [r.source.split()[0] for r in out] == [
        "explicit", "inherited", "explicit", "inherited", "explicit", "inherited", "unset"]
    assert out[5].source == r"inherited from D:\Windows"
    assert all(r.effective_owner is None and r.owner_distance is None for r in out)


def test_root_value_does_not_inherit(spark):
    rows = [("D:\\", True, None, "DELETE"), (r"D:\x.txt", False, None, None), (r"D:\a\y", False, None, None)]
    out = hierarchy.resolve(frame(spark, rows), ["decision"]).orderBy("row_seq").collect()
    assert [r.effective_decision for r in out] == ["DELETE", None, None]


def test_twin_rows_share_the_last_value(spark):
    rows = [(r"D:\a\x", False, None, "KEEP"), (r"d:/A/X", False, None, None),
            (r"D:\a\X", False, None, "DELETE"), (r"D:\a", True, None, "ARCHIVE")]
    out = hierarchy.resolve(frame(spark, rows), ["decision"]).orderBy("row_seq").collect()
    assert [r.effective_decision for r in out] == ["DELETE", "DELETE", "DELETE", "ARCHIVE"]


def test_point_lookup(spark):
    df = frame(spark, TREE)
    got = {r.column_name: (r.value, r.source) for r in hierarchy.resolve_path(
        df, r"d:\windows\notepad.exe", ["decision", "review", "missing"]).collect()}
    assert got == {"decision": ("DELETE", r"inherited from d:\windows"),
                   "review": (None, "unset"), "missing": (None, "unset")}
    own = hierarchy.resolve_path(df, r"D:\Windows", ["decision"]).first()
    assert (own.value, own.source) == ("DELETE", "explicit")


def tree_rows(seed, n=300):
    rng = random.Random(seed)
    places = {}
    while len(places) < n:
        depth = rng.randint(1, 6)
        p = rng.choice(["D:\\", "d:\\"]) + "\\".join(rng.choice(["a", "B", "c", "dd"]) for _ in range(depth))
        places[p] = (p, rng.random() < 0.6, rng.choice([None, " ", "True", "no"]),
                     rng.choice([None, None, None, "", "KEEP", " delete", "DELETE", "archive"]))
        if len(places) > 350:
            break
    return list(places.values())


def blank_text(v):
    return v is None or not v.strip()


def key(p):
    return str(PureWindowsPath(p)).lower()


def ups(p):
    out = []
    for a in PureWindowsPath(p).parents:
        if str(a) in ("D:\\", "d:\\"):
            break
        out.append(str(a))
    return out


def brute(rows, column):
    index = {key(r[0]): r[column] for r in rows if not blank_text(r[column])}
    result = []
    for r in rows:
        chain = [key(r[0])] + [a.lower() for a in ups(r[0])]
        hit = next(((i, index[k]) for i, k in enumerate(chain) if k in index), (None, None))
        result.append(hit)
    return result


def test_random_trees_match_brute_force_also_when_keys_are_hot(spark):
    for seed, hot in ((1, 1_000_000), (2, 3)):
        rows = tree_rows(seed)
        out = hierarchy.resolve(
            frame(spark, rows), ["review", "decision"], hot_rows=hot).orderBy("row_seq").collect()
        assert [(r.review_distance, r.effective_review) for r in out] == brute(rows, 2)
        assert [(r.decision_distance, r.effective_decision) for r in out] == brute(rows, 3)


def test_subtree_plan_matches_brute_force(spark):
    rows = tree_rows(5)
    df = conform(frame(spark, rows))
    manifest = deletion.delete_manifest(df, hot_rows=3).persist()
    trees = deletion.subtree_candidates(df, manifest, hot_rows=3).persist()
    got = {r.path for r in trees.collect()}

    values = brute(rows, 3)
    listed = {r[0] for r, v in zip(rows, values) if v[1] and v[1].strip().upper() == "DELETE"}
    held = {key(r[0]) for r in rows
            if not blank_text(r[3]) and r[3].strip().upper() != "DELETE"}
    clean = [r[0] for r in rows if r[1] and r[0] in listed
             and not any(h.startswith(key(r[0]) + "\\") for h in held)]
    want = {c for c in clean if not any(key(c).startswith(key(o) + "\\") for o in clean)}
    assert got == want and want

    covered = {r.path for r in deletion.covered_rows(df, trees, hot_rows=3).where("covered").collect()}
    assert covered == {r[0] for r in rows if any(
        key(r[0]) == key(t) or key(r[0]).startswith(key(t) + "\\") for t in want)}
    single = {r.path for r in deletion.delete_files_plan(df, manifest, trees).collect()}
    assert single == {r[0] for r in rows if not r[1] and r[0] in listed and r[0] not in covered}


def test_drive_root_is_never_a_subtree(spark):
    rows = [("D:\\", True, None, "DELETE"), (r"D:\keep", False, None, "KEEP")]
    df = conform(frame(spark, rows))
    assert deletion.subtree_candidates(df, deletion.delete_manifest(df)).count() == 0


def test_lookup_join_with_hot_and_missing_keys(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string"))
        .when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    lookup = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn(
        "v", F.upper("k"))
    for hot in (10, 1_000_000):
        out = lookup_join(rows, lookup, ["k"], ["id"], hot_rows=hot)
        assert out.count() == 900
        assert out.where("k is not null and v = upper(k)").count() == 600
        assert out.where("k is null and v is null").count() == 300


def test_blank_and_unset(spark):
    cells = [None, "", " ", "\t\n", "\u00a0", "KEEP", "0", "False"]
    out = spark.createDataFrame([(c,) for c in cells], "c string").select(
        blank(F.col("c")).alias("b"), unset(F.col("c")).alias("u")).collect()
    assert [r.b for r in out] == [True] * 5 + [False] * 3
    assert [r.u for r in out] == [True] * 2 + [False] * 6
    tokens = ["NA", "None", "null", "n/a", "nan", "-nan", "False", "0", "KEEP"]
    out = conform(spark.createDataFrame([("p", t) for t in tokens], "path string, decision string"))
    assert [r.decision for r in out.collect()] == [None] * 6 + ["False", "0", "KEEP"]
