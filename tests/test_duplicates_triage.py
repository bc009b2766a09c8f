import json

from pyspark.sql import functions as F

from treeline.functions.replies import normalised, parse_items
from treeline.operators import batches, duplicates, triage
from treeline.sources import ledger
from treeline.schema import conform


def test_marking(spark):
    rows = [("a.txt", "True", "kept_hashes", None, None), ("b.txt", "False", "", None, None),
            ("d.txt", "true", "baseline_scan", "", None), ("e.txt", "True", "same_drive", None, "seen"),
            ("f.txt", "TRUE", "baseline_scan", "KEEP", "x"), ("g.txt", "True", "baseline_scan", " ", "x")]
    df = spark.createDataFrame(
        rows, "path string, is_duplicate string, duplicate_kind string, decision string, comment string")
    out = {r.path: r for r in duplicates.mark_duplicates(df).collect()}
    assert out["a.txt"].recommendation == "SKIP" and out["a.txt"].confidence == "0.99"
    assert out["a.txt"].comment == "Duplicate — already in kept_hashes registry"
    assert out["b.txt"].recommendation is None and out["b.txt"].decision is None
    assert out["d.txt"].decision == "DELETE" and out["f.txt"].decision == "KEEP"
    assert out["g.txt"].decision == " " and out["e.txt"].comment == "seen"
    total = duplicates.duplicate_summary(duplicates.mark_duplicates(df)).first()
    assert tuple(total) == (3, 1, 1, 1, 5, 1)


def classified(spark, rows, base=(), kept=(), **more):
    df = spark.createDataFrame(
        [("D:", i, *r) for i, r in enumerate(rows)],
        "drive_id string, row_seq long, path string, md5_hash string, size_bytes long")
    baseline = duplicates.baseline_hashes(spark.createDataFrame(
        [(i, *b) for i, b in enumerate(base)], "row_seq long, path string, md5_hash string"))
    registry = duplicates.registry_hashes(spark.createDataFrame(
        [(i, *k) for i, k in enumerate(kept)],
        "row_seq long, md5_hash string, original_path string, organized_path string"), "row_seq")
    out = duplicates.classify(df, baseline, registry, **more)
    return {r.path: r for r in out.collect()}


def test_priority_last_baseline_row_and_comments(spark):
    rows = [("x1", "h1", 1), ("x2", "h2", 1), ("x3", "h3", 1), ("x4", "h3", 1), ("x5", None, 1), ("x6", "", 0)]
    out = classified(spark, rows, base=[("c1", "h1"), ("c2", "h1"), (None, "h3")],
                     kept=[("h1", "k1", "t1"), ("h2", "k2", "t2")])
    assert (out["x1"].duplicate_kind, out["x1"].duplicate_source_path) == ("baseline_scan", "c2")
    assert out["x1"].comment == "Duplicate of baseline scan file c2"
    assert out["x2"].comment == "Already kept from k2 → t2"
    assert out["x3"].duplicate_kind == "" and not out["x3"].is_duplicate
    assert out["x4"].comment == "Duplicate of x3 (same drive)"
    assert out["x5"].duplicate_kind == "" and out["x6"].duplicate_kind == ""


def test_one_hash_with_a_third_of_all_rows(spark):
    rows = [(f"p{i:04d}", "hot" if i % 3 == 0 else f"h{i}", 5) for i in range(300)]
    out = classified(spark, rows, hot_rows=20)
    same = [p for p, r in out.items() if r.duplicate_kind == "same_drive"]
    assert len(out) == 300 and len(same) == 99
    assert {out[p].duplicate_source_path for p in same} == {"p0000"}


def test_stored_rows_come_first_and_small_files_can_be_left_out(spark):
    earlier = spark.createDataFrame(
        [("D:", 9, "old", "h1")], "drive_id string, row_seq long, path string, md5_hash string")
    out = classified(spark, [("new", "h1", 0), ("z1", "h0", 0), ("z2", "h0", 0)], earlier=earlier)
    assert out["new"].duplicate_source_path == "old" and out["z2"].duplicate_kind == "same_drive"
    out = classified(spark, [("z1", "h0", 0), ("z2", "h0", 0)], min_dup_bytes=1)
    assert out["z2"].duplicate_kind == ""


ITEM = {"path": "a", "recommendation": "SKIP", "confidence": 0.9, "comment": "c"}
GOOD = json.dumps([ITEM])
REPLIES = [
    (GOOD, 1), (f"```json\n{GOOD}\n```", 1), (f"```\n{GOOD}```", 1), (f"  ```JSON {GOOD} ```  ", 1),
    ("not json at all", None), (json.dumps(ITEM), None), (json.dumps([{"path": "a"}]), None),
    (GOOD + " tail", None), (GOOD[:-3], None), ("[1,2]", None), ("[]", 0), (GOOD + " x ]", None),
    (GOOD + "," + GOOD, None), (json.dumps([dict(ITEM, comment=None)]), 1), ("", None), ("[null]", None),
    (json.dumps([ITEM, {"path": "b"}]), None), (json.dumps([dict(ITEM, more=[1, {"x": 2}])]), 1),
    (f"[{GOOD}]", None),
]


def test_reply_parsing(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, t string")
    out = df.select("i", F.size(parse_items(F.col("t"), triage.REPLY_KEYS)).alias("n")).orderBy("i").collect()
    got = [None if r.n is None or r.n < 0 else r.n for r in out]
    assert got == [n for _, n in REPLIES]
    assert [normalised(t, triage.REPLY_KEYS) is not None for t, _ in REPLIES] == [n is not None for _, n in REPLIES]


def test_the_plan_reads_what_the_worker_has_parsed(spark):
    """Repeated keys, numbers beyond a double, lone surrogates: one reading; NaN is refused by both."""
    item = '{"path": "first", "path": "last", "recommendation": "SKIP", "confidence": %s, "comment": "\\ud800 \u00e9"}'
    for number, want in (("0.70", "0.70"), ("1e999", "1e999"), ("12345678901234567890", "12345678901234567890")):
        reply = normalised(f"```json\n[{item % number}]\n```", triage.REPLY_KEYS)
        row = spark.createDataFrame([(reply,)], "reply string").select(
            parse_items(F.col("reply"), triage.REPLY_KEYS).alias("i")).first()
        assert (row.i[0]["path"], row.i[0]["confidence"]) == ("last", want)
    assert normalised(f"[{item % 'NaN'}]", triage.REPLY_KEYS) is None


def numbers(n):
    return [("D:" if i % 4 else "C:", 7 * i, f"f{i:05d}", i % 3 == 0) for i in range(n)]


def test_batches_are_consecutive_slices_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(batches, "BLOCK", 10)
    df = spark.createDataFrame(numbers(500), "drive_id string, row_seq long, path string, is_dir boolean")
    out = batches.number_batches(df, 13).collect()
    for drive in ("C:", "D:"):
        mine = sorted((r.row_seq, r.batch_id, r.batch_pos) for r in out if r.drive_id == drive)
        assert [(b, p) for _, b, p in mine] == [(i // 13, i % 13) for i in range(len(mine))]


def inventory(spark, n=25):
    return conform(spark.createDataFrame(
        [("D:", i, f"D:\\d\\f{i}.txt", f"f{i}.txt", ".txt", False, 10 * i) for i in range(n)],
        "drive_id string, row_seq long, path string, filename string, extension string,"
        " is_dir boolean, size_bytes long"))


def test_scoring_with_retry_fallback_and_missing_items(spark, tmp_path):
    def scorer(prompt):
        items = json.loads(prompt.split("Items:\n")[1].split("\n\n")[0])
        first = items[0]["path"]
        if first.endswith("f10.txt"):
            raise RuntimeError("down")
        if first.endswith("f5.txt") and "not a valid JSON" not in prompt:
            return "sorry"
        out = [{"path": i["path"], "recommendation": "INTERESTING", "confidence": 0.7, "comment": "ok"}
               for i in items if not i["path"].endswith("f3.txt")]
        out += [dict(out[0], comment="again"), dict(out[0], path="unknown")]
        return json.dumps(out)

    rows = triage.triage_rows(inventory(spark), 5)
    prompts = triage.with_prompt(batches.assemble(rows, triage.ITEM_FIELDS))
    replies = ledger.ask_all(prompts, str(tmp_path / "calls"), triage.triage_answer(scorer), ["prompt"], concurrency=2)
    replies = replies.select("drive_id", "batch_id", "reply", "error")
    out = {r.filename: r for r in triage.apply_replies(rows, replies).collect()}
    assert len(out) == 25
    assert out["f0.txt"].comment == "again" and out["f1.txt"].recommendation == "INTERESTING"
    assert (out["f3.txt"].recommendation, out["f3.txt"].confidence) == ("REVIEW", 0.5)
    assert out["f3.txt"].comment == "LLM did not return a result for this item"
    assert out["f7.txt"].comment == "ok"
    assert {out[f"f{i}.txt"].comment for i in range(10, 15)} == {"LLM parse error — manual review needed"}
    assert out["f1.txt"].recommendation_valid


def test_needs_triage(spark):
    df = spark.createDataFrame(
        [("a", None, None), ("b", "", "False"), ("c", " ", None), ("d", "SKIP", None), ("e", None, "True")],
        "path string, recommendation string, is_duplicate string")
    assert {r.path for r in triage.needs_triage(df).collect()} == {"a", "b"}
