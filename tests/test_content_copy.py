import base64
import os

import pytest
from pyspark.sql import functions as F

from treeline.operators import content, organize, recovery, reports
from treeline.schema import REPORT_COLUMNS, conform
from treeline.sources import ledger


def test_pdf_rule(spark):
    rows = [("a", 0, "x" * 1000, 0), ("b", 0, "x" * 1000, 1), ("c", 0, "x" * 9, 0), ("c", 1, "x" * 9, 0),
            ("d", 0, "y" * 300, 0), ("d", 1, "y" * 300, 0), ("d", 2, "y" * 300, 0), ("e", None, None, None)]
    pages = spark.createDataFrame(rows, "path string, page_no long, text string, n_images long")
    out = {r.path: r.is_complex for r in content.pdf_complexity(pages).collect()}
    assert out == {"a": False, "b": True, "c": True, "d": False, "e": False}
    known = spark.createDataFrame(
        [("a", "complex"), ("b", " Simple"), ("c", "simple")], "path string, pdf_complexity string")
    out = {r.path: r.is_complex for r in content.pdf_complexity(pages, known).collect()}
    assert out == {"a": True, "b": False, "c": True, "d": False, "e": False}


def test_truncation(spark):
    texts = ["one two three", " a  b\tc\nd ", "", "a\u00a0b c d"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(
        content.truncate_words(F.col("t"), 3).alias("t")).collect()
    assert [r.t for r in out] == ["one two three", "a b c", "", "a b c"]


def test_pieces_join_in_order_over_sections(spark, monkeypatch):
    monkeypatch.setattr(content, "SECTION", 4)
    rows = [("f", i, f"line {i}") for i in range(30)] + [("g", 0, "only")]
    df = spark.createDataFrame(rows, "path string, n long, t string").repartition(5)
    out = {r.path: r.content for r in content.join_pieces(df, ["path"], "n", "t").collect()}
    assert out == {"f": "\n".join(f"line {i}" for i in range(30)), "g": "only"}


def test_sheet_text(spark):
    rows = [("w", 0, "One", i, " \t" if i % 2 else f"r{i}") for i in range(60)] + [("w", 1, "Two", 0, "")]
    df = spark.createDataFrame(rows, "path string, sheet_no long, sheet string, row_no long, line string")
    text = content.sheet_content(df).first().content
    assert text == "\n".join(["Sheet: One"] + [f"r{2 * i}" for i in range(20)] + ["Sheet: Two"])


def test_base64_is_one_line(spark):
    df = spark.createDataFrame([(bytearray(range(200)),)], "content binary")
    assert df.select(content.image_base64(F.col("content"))).first()[0] == base64.b64encode(bytes(range(200))).decode()


def test_bad_bytes_become_text(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff!"),)], "content binary")
    assert df.select(content.utf8_text(F.col("content"))).first()[0] == "ok\ufffd!"


def test_summaries_and_errors(spark, tmp_path):
    def summarizer(kind, text):
        if text == "boom":
            raise ValueError("no model")
        return f" {kind}: {len(text.split())} words "

    rows = [("a", "text", "w " * 50), ("b", "error", "locked"), ("c", "text", "boom"),
            ("d", "image_b64", "w " * 50)]
    df = content.cut_content(spark.createDataFrame(rows, "path string, kind string, content string"), 10)
    asked = ledger.ask_all(df, str(tmp_path / "calls"), content.summary_answer(summarizer), ["kind", "content"])
    text = content.summary_text(*(F.col(c) for c in ("kind", "content", "reply", "error")))
    out = {r.path: r.s for r in asked.select("path", text.alias("s")).collect()}
    assert out == {"a": "text: 10 words", "b": "UNREADABLE: locked", "c": "LLM_ERROR: no model",
                   "d": "image_b64: 50 words"}


def _files(spark, tmp_path, routes):
    rows = []
    for i, (name, route) in enumerate(routes.items()):
        (tmp_path / name).write_bytes(b"raw " + name.encode())
        rows.append(("D:", f"D:\\{name}", route, str(tmp_path / name), None))
    return spark.createDataFrame(
        rows, "drive_id string, path string, route string, uri string, pdf_complexity string").repartition(3)


def test_pieces_of_a_decoder(spark, tmp_path):
    """PDFs with text, images, little text, no pages and a break halfway; sheets, paragraphs, images."""
    P = content.Piece

    def decoder(route, uri):
        name = os.path.basename(uri)
        if name == "missing.docx":
            raise ValueError("no such part")
        yield from {
            "text.pdf": [P("page", i, "x " * 150) for i in range(3)],
            "chart.pdf": [P("page", 0, "word " * 200, n_images=1)],
            "sparse.pdf": [P("page", i, "a b c d e") for i in range(2)],
            "empty.pdf": [], "broken.pdf": [P("page", 0, "x" * 500)],
            "known.pdf": [P("page", 0, "x" * 500, n_images=2)],
            "book.xlsx": [P("row", i, f"r{i}" if i % 2 else " ", sheet_no=0, sheet="One") for i in range(60)]
            + [P("row", 0, "z", sheet_no=1, sheet="Two")],
            "doc.docx": [P("paragraph", 1, "second"), P("paragraph", 0, "first"), P("paragraph", 2, " ")],
            "pic.jpg": [P("image", data=b"\x01\x02")],
        }[name]
        if name == "broken.pdf":
            raise OSError("page 2 is damaged")

    routes = {"text.pdf": "pdf", "chart.pdf": "pdf", "sparse.pdf": "pdf", "empty.pdf": "pdf", "broken.pdf": "pdf",
              "known.pdf": "pdf", "book.xlsx": "xlsx", "doc.docx": "docx", "missing.docx": "docx", "pic.jpg": "image",
              "a.txt": "text", "b.odd": "text_attempt"}
    files = _files(spark, tmp_path, routes).withColumn(
        "pdf_complexity", F.when(F.col("path").endswith("known.pdf"), " Simple"))
    os.remove(tmp_path / "b.odd")
    pieces = content.decode_pieces(files, decoder, frame_bytes=700)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and plan.count("MapInArrow") == 1
    facts = content.pdf_facts(files, pieces)
    name = F.substring_index("path", "\\", -1)
    known = {r.n: (r.n_pages, r.is_complex) for r in facts.select(name.alias("n"), "*").collect()}
    assert known == {"text.pdf": (3, False), "chart.pdf": (1, True), "sparse.pdf": (2, True), "empty.pdf": (0, False),
                     "known.pdf": (1, False)}
    out = {r.n: (r.kind, r.content) for r in content.file_contents(files, pieces, facts).select(
        name.alias("n"), "kind", "content").collect()}
    assert out["text.pdf"] == ("text", "\n".join(["x " * 150] * 3)) and out["chart.pdf"][0] == "complex_pdf"
    assert out["sparse.pdf"] == ("complex_pdf", "a b c d e\na b c d e") and out["empty.pdf"] == ("text", "")
    assert out["broken.pdf"] == ("error", "page 2 is damaged") and out["missing.docx"] == ("error", "no such part")
    assert out["book.xlsx"][1].split("\n")[:3] == ["Sheet: One", "r1", "r3"] and out["book.xlsx"][1].endswith("Sheet: Two\nz")
    assert out["doc.docx"] == ("text", "first\nsecond") and out["pic.jpg"] == ("image_b64", "AQI=")
    assert out["a.txt"] == ("text", "raw a.txt") and out["b.odd"][0] == "error" and "No such file" in out["b.odd"][1]
    assert len(out) == len(routes)


def test_taxonomy_merges_in_rounds(spark, tmp_path):
    batches = spark.createDataFrame(
        [("D:", i, 1, f"[{i}]") for i in range(45)], "drive_id string, batch_id long, n_rows long, items string")
    text = organize.draft_taxonomy(
        batches, lambda p: "t" + p.strip("[]"), lambda p: " ".join(sorted(p.split())), str(tmp_path))
    assert sorted(text.split()) == sorted(f"t{i}" for i in range(45))


def test_failed_taxonomy_calls_are_repeated_and_named(spark, tmp_path):
    batches = spark.createDataFrame(
        [("D:", i, 1, f"[{i}]") for i in range(3)], "drive_id string, batch_id long, n_rows long, items string")
    asked = []

    def once(prompt):
        if not asked:
            asked.append(prompt)
            raise OSError("busy")
        return prompt

    out = organize.ask_each(batches.coalesce(1).withColumn("prompt", batches["items"]), once, ["batch_id"])
    assert sorted(r.reply for r in out.collect()) == ["[0]", "[1]", "[2]"]

    def never(prompt):
        if prompt == "[1]":
            raise OSError("gone")
        return prompt

    with pytest.raises(RuntimeError, match="D:/1.*gone"):
        organize.draft_taxonomy(batches, never, never, str(tmp_path))


def test_the_last_batch_decides_between_two_that_name_a_path(spark):
    df = spark.createDataFrame([("a", None)], "path string, organized_path string")
    proposed = spark.createDataFrame(
        [("a", "first", 0, 9), ("a", "last", 1, 0)],
        "original_path string, organized_path string, batch_id int, position int")
    assert organize.apply_assignments(df, df, proposed).first().organized_path == "last"


def test_assignments_of_two_drives_with_one_path(spark):
    df = spark.createDataFrame([("D:", "a", None), ("E:", "a", "kept")], "drive_id string, path string, organized_path string")
    proposed = spark.createDataFrame(
        [("D:", "a", "new", 0)], "drive_id string, original_path string, organized_path string, position int")
    out = {r.drive_id: (r.organized_path, r.assigned) for r in organize.apply_assignments(df, df, proposed).collect()}
    assert out == {"D:": ("new", True), "E:": ("kept", False)}


def test_assignments(spark):
    df = spark.createDataFrame([("a", "old"), ("b", None), ("c", "x")], "path string, organized_path string")
    proposed = spark.createDataFrame(
        [("a", "new1", 0), ("a", "new2", 1), ("c", "no", 0)],
        "original_path string, organized_path string, position int")
    out = {r.path: (r.organized_path, r.assigned) for r in organize.apply_assignments(
        df, df.where("path <> 'c'"), proposed).collect()}
    assert out == {"a": ("new2", True), "b": (None, False), "c": ("x", False)}


def test_copy_verify_and_registry(spark, tmp_path):
    src, dest = tmp_path / "src", tmp_path / "dest"
    src.mkdir()
    rows = []
    for i, target in enumerate(["Docs/a.txt", "Docs/A.TXT", "b/c.txt", None, "../x", "/abs", "ok.txt", "bad.txt"]):
        f = src / f"f{i}.txt"
        f.write_text(f"content {i}")
        known = {6: "", 7: "0" * 32}.get(i, recovery.file_md5(str(f)))
        rows.append(("D:", i, f"D:\\f{i}.txt", str(f), False, f.stat().st_size, known, "KEEP", target))
    rows.append(("D:", 99, "D:\\gone.txt", str(src / "gone"), False, 1, "1" * 32, "keep ", "gone.txt"))
    df = conform(spark.createDataFrame(
        rows, "drive_id string, row_seq long, path string, source_uri string, is_dir boolean,"
              " size_bytes long, md5_hash string, decision string, organized_path string"))
    plan = recovery.copy_plan(recovery.copy_eligible(df), str(dest))
    status = {r.row_seq: r.plan_status for r in plan.collect()}
    assert status == {0: "FAILED", 1: "FAILED", 2: "PLANNED", 3: "SKIPPED", 4: "FAILED", 5: "FAILED",
                      6: "PLANNED", 7: "PLANNED", 99: "PLANNED"}
    for _ in range(2):  # a repeated task changes nothing
        copied = recovery.run_copies(plan, 2)
        done = recovery.verify_copies(plan, copied)
        got = {r.row_seq: r.copy_status for r in done.collect()}
        assert got == {0: "FAILED", 1: "FAILED", 2: "COPIED", 3: "SKIPPED", 4: "FAILED", 5: "FAILED",
                       6: "COPIED", 7: "FAILED", 99: "FAILED"}
    assert (dest / "b" / "c.txt").read_text() == "content 2"
    assert not [f for _, _, names in os.walk(dest) for f in names if f.endswith(".part")]
    kept = recovery.registry_rows(done, F.lit("now")).collect()
    assert {(r.original_path, r.md5_hash is None, r.drive) for r in kept} == {
        ("D:\\f2.txt", False, "D:"), ("D:\\f6.txt", True, "D:")}


def test_copied_rows_are_not_copied_again(spark):
    df = conform(spark.createDataFrame(
        [("a", "KEEP", "copied"), ("b", "KEEP", "FAILED"), ("c", "KEEP", None), ("d", "DELETE", None)],
        "path string, decision string, copy_status string"))
    assert {r.path for r in recovery.copy_eligible(df).collect()} == {"b", "c"}


def test_report_columns_and_bad_sizes(spark):
    df = spark.createDataFrame(
        [("p", "10", "baseline_scan"), ("q", "x", "baseline_scan"), ("r", "5", "same_drive")],
        "path string, size_bytes string, duplicate_kind string").withColumn("is_dir", F.lit(None).cast("boolean"))
    report = reports.duplicates_report(df)
    assert report.columns == REPORT_COLUMNS
    assert tuple(reports.report_totals(report).first()) == (2, 10, 0.0)
    assert reports.report_totals(report.limit(0)).first().total_bytes == 0
