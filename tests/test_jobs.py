import csv
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from treeline.operators import content, duplicates, inventory
from treeline.operators.batches import number_batches
from treeline.plans import jobs
from treeline.schema import conform
from treeline.sources import ledger, tables, tree
from treeline.sources.workspace import Work, clear_work, new_folder

OPTIONS = jobs.Options(exclude_dirs=["AppData", "$RECYCLE.BIN"], exclude_extensions=[".exe", ".DLL"])


def make_tree(root):
    for name, text in {
        "docs/note.txt": "hello", "docs/setup.exe": "x", "AppData/file.dat": "x", "a.txt": "same",
        "b.txt": "same", ".hidden": "h", "_under/x.md": "m", "docs/deep/er/y.dll": "d", "empty.log": "",
    }.items():
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    os.symlink(root / "docs", root / "link")


def by_name(df):
    return {os.path.basename(r.source_uri): r for r in df.collect()}


def test_scan_resume_and_table(spark, tmp_path):
    root, table = tmp_path / "drive", str(tmp_path / "table")
    make_tree(root)
    first = by_name(jobs.scan(spark, str(root), table, OPTIONS))
    assert set(first) == {"drive", "docs", "note.txt", "AppData", "a.txt", "b.txt", ".hidden", "_under",
                          "x.md", "deep", "er", "empty.log"}
    assert first["AppData"].recommendation == "SKIP" and first["AppData"].comment == "Excluded by config"
    assert first["docs"].is_dir and first["docs"].md5_hash is None
    assert first["b.txt"].duplicate_kind == "same_drive" and not first["a.txt"].is_duplicate
    assert first["b.txt"].duplicate_source_path == first["a.txt"].path
    assert first["note.txt"].path == str(root / "docs" / "note.txt").replace("/", "\\")
    assert first["note.txt"].extension == ".txt" and first["note.txt"].modified is not None

    (root / "c.txt").write_text("same")
    (root / "AppData" / "new").write_text("same")
    left = jobs.estimate(spark, str(root), table, OPTIONS).first()
    assert tuple(left) == (1, 4)
    second = by_name(jobs.scan(spark, str(root), table, OPTIONS))
    assert set(second) == {"c.txt"}
    assert second["c.txt"].duplicate_source_path == first["a.txt"].path
    assert second["c.txt"].row_seq > max(r.row_seq for r in first.values())
    assert tables.read_table(spark, table).count() == 13


def test_baseline_and_registry_in_a_scan(spark, tmp_path):
    for drive in ("c", "d"):
        (tmp_path / drive).mkdir()
    (tmp_path / "c" / "x.txt").write_text("one")
    (tmp_path / "d" / "y.txt").write_text("one")
    (tmp_path / "d" / "z.txt").write_text("two")
    base, table, registry = (str(tmp_path / n) for n in ("base", "table", "registry"))
    jobs.scan(spark, str(tmp_path / "c"), base, OPTIONS)
    md5 = tree._hash(str(tmp_path / "d" / "z.txt"))[0]
    tables.append_registry(spark.createDataFrame(
        [(md5, "E:\\old", "Kept/z.txt", "E:", "2024")], tables.REGISTRY), registry)
    out = by_name(jobs.scan(spark, str(tmp_path / "d"), table,
                            jobs.Options(baseline=base, registry=registry)))
    assert out["y.txt"].duplicate_kind == "baseline_scan" and out["y.txt"].comment.endswith("x.txt")
    assert out["z.txt"].comment == "Already kept from E:\\old → Kept/z.txt"
    summary = jobs.mark_duplicates(spark, table).first()
    assert (summary.baseline_count, summary.kept_count, summary.auto_delete_count) == (1, 1, 1)


def test_walk_shares_out_a_large_subtree(spark, tmp_path):
    want = set()
    for i in range(12):
        for j in range(6):
            f = tmp_path / "root" / "one" / "deep" / f"d{i}" / f"e{j}" / "f.txt"
            f.parent.mkdir(parents=True)
            f.write_text("x")
            want.add(str(f))
    folder = str(tmp_path / "rounds")
    out = tree.list_tree(spark, str(tmp_path / "root"), folder, budget=9, first_budget=5, tasks=4)
    assert {r.source_uri for r in out.where("not is_dir").collect()} == want
    assert out.where("is_dir").count() == 1 + 2 + 12 + 72
    assert len(os.listdir(folder)) > 2


def test_unreadable_directory_and_file(spark, tmp_path, monkeypatch):
    rows = list(tree._visit(str(tmp_path / "missing"), set(), set()))
    assert rows[0][0] == "error" and rows[0][5].startswith("INACCESSIBLE: ")
    listing = spark.createDataFrame(
        [("p", str(tmp_path / "gone"), False, None)], "path string, source_uri string, is_dir boolean, comment string")
    row = tree.hash_files(listing).first()
    assert row.md5_hash is None and row.comment is None


def full_row(path, **values):
    row = dict.fromkeys(["path", "filename", "extension", "is_dir", "size_bytes", "modified", "md5_hash",
                         "is_duplicate", "duplicate_kind", "recommendation", "confidence", "comment", "review",
                         "decision"], "")
    row.update(path=path, filename=path.split("\\")[-1], is_dir="False", size_bytes="5", **values)
    return row


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, fieldnames=list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def test_csv_round_trip_keeps_quotes_spaces_and_breaks(spark, tmp_path):
    rows = [full_row("D:\\a.txt", comment='say "hi",\nthen stop', decision=" delete ", review="None",
                     confidence="0.99"),
            full_row("D:\\b.txt", is_duplicate="True", size_bytes_note="x")]
    del rows[1]["size_bytes_note"]
    df = tables.read_inventory_csv(spark, write(tmp_path / "in.csv", rows))
    a, b = df.orderBy("row_seq").collect()
    assert a.comment == 'say "hi",\nthen stop' and a.decision == " delete " and a.review is None
    assert a.confidence == 0.99 and a.size_bytes == 5 and b.is_duplicate and a.drive_id == "D:"
    tables.write_inventory_csv(df, str(tmp_path / "out"))
    again = tables.read_inventory_csv(spark, str(tmp_path / "out")).orderBy("path").first()
    assert (again.comment, again.decision, again.is_dir) == (a.comment, " delete ", False)


def csv_of(folder):
    rows, head = [], None
    for name in sorted(os.listdir(folder)):
        if name.endswith(".csv"):
            with open(os.path.join(folder, name), newline="", encoding="utf-8") as f:
                reader = csv.DictReader(f)
                rows += list(reader)
                head = reader.fieldnames
    return rows, head


def test_manifest_guard_and_plan(spark, tmp_path):
    source = write(tmp_path / "drive_d.csv", [
        full_row("D:\\Windows", decision="DELETE"), full_row("D:\\Windows\\notepad.exe"),
        full_row("D:\\x.txt", decision="delete"), full_row("D:\\keep.txt", decision="KEEP")])
    table, folder = str(tmp_path / "table"), str(tmp_path / "manifest")
    jobs.ingest_csv(spark, source, table)
    edits = spark.createDataFrame([("D:\\keep.txt", "True", None)], "path string, review string, decision string")
    assert jobs.apply_edits(tables.read_table(spark, table), edits).where("review = 'True'").count() == 1
    totals = jobs.manifest(spark, table, folder).first()
    assert (totals.total_rows, totals.total_bytes, totals.explicit_count, totals.inherited_count) == (3, 15, 2, 1)
    rows, head = csv_of(folder)
    assert head == ["path", "filename", "size_bytes", "decision_source"]
    assert {r["path"]: r["decision_source"] for r in rows} == {
        "D:\\Windows": "EXPLICIT", "D:\\x.txt": "EXPLICIT",
        "D:\\Windows\\notepad.exe": "INHERITED from D:\\Windows"}

    subtrees, single = jobs.delete_plan(spark, table, folder)
    assert subtrees.count() == 0 and {r.path for r in single.collect()} == {r["path"] for r in rows}
    changed = tables.read_table(spark, table).withColumn(
        "decision", F.when(F.col("path") == "D:\\x.txt", "KEEP").otherwise(F.col("decision")))
    tables.write_table(changed, table)
    with pytest.raises(ValueError, match="contains 1 stale path"):
        jobs.delete_plan(spark, table, folder)


def test_empty_manifest_and_report_have_headers(spark, tmp_path):
    source = write(tmp_path / "drive_d.csv", [full_row("D:\\x.txt")])
    jobs.ingest_csv(spark, source, str(tmp_path / "table"))
    jobs.manifest(spark, str(tmp_path / "table"), str(tmp_path / "m"))
    assert csv_of(tmp_path / "m") == ([], ["path", "filename", "size_bytes", "decision_source"])
    jobs.duplicates_report(spark, [source], str(tmp_path / "r"))
    assert csv_of(tmp_path / "r") == ([], tables.REPORT_COLUMNS)
    with pytest.raises(ValueError):
        jobs.duplicates_report(spark, [], str(tmp_path / "none"))


def test_manifests_of_two_drives_and_report(spark, tmp_path):
    d = write(tmp_path / "drive_d.csv", [full_row("D:\\x", decision="DELETE", duplicate_kind="baseline_scan")])
    e = write(tmp_path / "drive_e.csv", [
        full_row("E:\\y", decision="DELETE", duplicate_kind="same_drive"), full_row("D:\\x", decision="KEEP")])
    totals = jobs.manifest_all(spark, [d, e], str(tmp_path / "m")).collect()
    assert {r.source_csv: r.total_rows for r in totals} == {d: 1, e: 1}
    parts = {p for p in os.listdir(tmp_path / "m") if p.startswith("manifest=")}
    assert parts == {"manifest=drive_d_delete_manifest.csv", "manifest=drive_e_delete_manifest.csv"}
    assert jobs.duplicates_report(spark, [d, e], str(tmp_path / "r")).first().duplicate_files == 1
    rows, _ = csv_of(tmp_path / "r")
    assert [(r["source_csv"], r["path"]) for r in rows] == [(d, "D:\\x")]


def test_rate_summarise_organise_copy(spark, tmp_path):
    root, table = tmp_path / "drive", str(tmp_path / "table")
    make_tree(root)
    (root / "scan.pdf").write_bytes(b"pdf")
    (root / "bad.docx").write_bytes(b"doc")
    jobs.scan(spark, str(root), table, OPTIONS)

    def scorer(prompt):
        items = json.loads(prompt.split("Items:\n")[1])
        return json.dumps([dict(path=i["path"], recommendation="REVIEW", confidence=0.4, comment="ok") for i in items])

    jobs.rate(spark, table, scorer, jobs.Options(batch_size=4))
    rated = by_name(tables.read_table(spark, table))
    assert rated["note.txt"].confidence == 0.4 and rated["b.txt"].recommendation == "SKIP"
    assert rated["AppData"].comment == "Excluded by config"

    edits = spark.createDataFrame(
        [(str(root).replace("/", "\\"), "True", "KEEP"), (str(root / "a.txt").replace("/", "\\"), None, "DELETE")],
        "path string, review string, decision string")
    tables.write_table(jobs.apply_edits(tables.read_table(spark, table), edits), table)

    def decoder(route, uri):
        if route == "docx":
            raise ValueError("broken file")
        return [content.Piece("page", 0, "page one"), content.Piece("page", 1, "page two")]

    jobs.summarize(spark, table, decoder, lambda kind, text: f"{kind}|{text}", OPTIONS)
    got = by_name(tables.read_table(spark, table))
    assert got["note.txt"].summary == "text|hello" and got["a.txt"].summary is None
    assert got["bad.docx"].summary == "UNREADABLE: broken file"
    assert got["scan.pdf"].summary.startswith("complex_pdf|page one\npage two")
    assert got["scan.pdf"].pdf_complexity == "complex" and got["docs"].summary is None

    organised = jobs.organise(
        spark, table, lambda p: "Stuff", lambda p: "Stuff",
        lambda p: json.dumps([dict(original_path=i["path"], organized_path="Stuff/" + i["filename"])
                              for i in json.loads(p.split("Files:\n")[1])]))
    assert organised.taxonomy == "Stuff" and organised.assigned > 3
    registry = str(tmp_path / "registry")
    counts = jobs.copy(spark, table, str(tmp_path / "out"), jobs.Options(registry=registry)).first()
    names = {r for r in os.listdir(tmp_path / "out" / "Stuff")}
    assert {"note.txt", "scan.pdf", "x.md"} <= names and "bad.docx" not in names and "a.txt" not in names
    assert counts.copied_count == len(names) == tables.read_registry(spark, registry).count()
    again = jobs.copy(spark, table, str(tmp_path / "out"), jobs.Options(registry=registry)).first()
    assert again.copied_count == 0
    found = {r.column_name: r.value for r in jobs.resolve(
        spark, table, str(root / "docs" / "new.bin")).collect()}
    assert found == {"review": "True", "decision": "KEEP"}


def test_a_job_that_dies_asks_again_only_what_is_open(spark, tmp_path):
    """The scorer dies in the middle; the rerun makes no call whose reply is there."""
    table, log = str(tmp_path / "t"), tmp_path / "log"
    log.mkdir()
    rows = [("D:", i, f"D:\\f{i}.txt", f"f{i}.txt", None, None) for i in range(40)]
    tables.write_table(_rows(spark, rows), table)

    def scorer(prompt):
        items = json.loads(prompt.split("Items:\n")[1])
        (log / f"{items[0]['filename']}_{len(os.listdir(log))}_{os.getpid()}").write_text("")
        if (tmp_path / "down").exists() and items[0]["path"].endswith(("f16.txt", "f32.txt")):
            os._exit(3)  # the worker dies, and so does the job
        return json.dumps([dict(path=i["path"], recommendation="SKIP", confidence=1, comment="") for i in items])

    options = jobs.Options(batch_size=4, wave=3)
    (tmp_path / "down").write_text("")
    with pytest.raises(Exception):
        jobs.rate(spark, table, scorer, options)
    known = ledger.read_ledger(spark, table + "_calls").where("reply is not null").count()
    assert 0 < known < 10 and tables.read_table(spark, table).where("recommendation = 'SKIP'").count() == 0
    (tmp_path / "down").unlink()
    before = len(os.listdir(log))
    jobs.rate(spark, table, scorer, options)
    assert len(os.listdir(log)) - before == 10 - known
    assert tables.read_table(spark, table).where("recommendation = 'SKIP'").count() == 40


def test_many_waves_are_no_many_jobs(spark, tmp_path):
    calls = spark.range(300).select(F.concat(F.lit("p"), F.col("id") % 200).alias("prompt"))
    calls.write.parquet(str(tmp_path / "calls"))
    calls, folder = spark.read.parquet(str(tmp_path / "calls")), str(tmp_path / "ledger")
    seen = tmp_path / "seen"
    seen.mkdir()

    def first(prompt):
        return (None, "busy") if prompt.endswith("7") else ("one " + prompt, None)

    def second(prompt):
        (seen / f"{prompt}_{os.getpid()}").write_text("")
        return "two " + prompt, None

    context = spark.sparkContext
    context.setJobGroup("waves", "")
    try:
        ledger.ask_all(calls, folder, first, ["prompt"], wave=2)
        asked = ledger.ask_all(calls, folder, second, ["prompt"], wave=2).collect()
        assert len(context.statusTracker().getJobIdsForGroup("waves")) < 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(asked) == 300 and all(r.error is None for r in asked)
    assert all(r.reply == ("two " if r.prompt.endswith("7") else "one ") + r.prompt for r in asked)
    attempts = ledger.read_ledger(spark, folder).groupBy("digest").count().collect()
    assert sorted(r["count"] for r in attempts) == [1] * 180 + [2] * 20 and len(os.listdir(seen)) == 20


def test_a_cap_on_callers_holds_over_many_waves(spark, tmp_path):
    calls, folder = spark.range(40).select(F.col("id").cast("string").alias("prompt")), str(tmp_path / "ledger")
    busy = tmp_path / "busy"
    busy.mkdir()

    def answer(prompt):
        mark = busy / prompt
        mark.write_text("")
        time.sleep(0.02)
        n = len(os.listdir(busy))
        mark.unlink()
        return str(n), None

    asked = ledger.ask_all(calls, folder, answer, ["prompt"], wave=8, concurrency=2).collect()
    assert len(asked) == 40 and {r.reply for r in asked} <= {"1", "2"}
    assert ledger.read_ledger(spark, folder).count() == 40 and not os.listdir(f"{folder}/_open")


def test_two_drives_with_one_path_keep_their_own(spark, tmp_path):
    table = str(tmp_path / "t")
    for name, text in (("d", "of d"), ("e", "of e")):
        (tmp_path / name).write_text(text)
    rows = [("D:", 1, "\\x.txt", ".txt", str(tmp_path / "d"), "True"), ("E:", 2, "\\x.txt", ".txt", str(tmp_path / "e"), "True"),
            ("E:", 3, "\\x.txt", ".pdf", str(tmp_path / "none"), "True")]
    tables.write_table(conform(spark.createDataFrame(
        rows, "drive_id string, row_seq bigint, path string, extension string, source_uri string, review string")), table)
    edits = spark.createDataFrame([("E:", "\\x.txt", None, "KEEP", 1), ("E:", "\\x.txt", None, "ARCHIVE", 2)],
                                  "drive_id string, path string, review string, decision string, at int")
    edited = jobs.apply_edits(tables.read_table(spark, table), edits, "at")
    assert sorted((r.drive_id, r.decision) for r in edited.collect()) == [("D:", None), ("E:", "ARCHIVE"), ("E:", "ARCHIVE")]
    jobs.summarize(spark, table, lambda r, u: [], lambda kind, text: text)
    assert {(r.drive_id, r.summary) for r in tables.read_table(spark, table).collect()} == {("D:", "of d"), ("E:", "of e")}


def test_the_registry_takes_a_run_once_and_knows_the_last(spark, tmp_path):
    folder, day = str(tmp_path / "registry"), "2024-01-01T00:00:00"
    names = "md5_hash string, original_path string, organized_path string, drive string, date_copied string"

    def rows(*found):
        return spark.createDataFrame([(h, p, f"to/{p}", None, day) for h, p in found], names)

    tables.append_registry(rows(("h", "z"), ("g", "y")), folder, "one")
    tables.append_registry(rows(("h", "a")), folder, "two")
    tables.append_registry(rows(("h", "a"), ("k", "new")), folder, "two")  # an attempt that got further
    tables.append_registry(rows(("h", "a"), ("k", "new")), folder, "two")
    (tmp_path / "registry" / "append_no=9").mkdir()  # broke off
    read = tables.read_registry(spark, folder)
    assert sorted((r.append_no, r.md5_hash, r.original_path) for r in read.collect()) == [
        (1, "g", "y"), (1, "h", "z"), (2, "h", "a"), (3, "k", "new")]
    last = duplicates.registry_hashes(read.withColumn("at", F.struct("append_no", "row_no")), "at")
    assert {r.md5_hash: r.kept_path for r in last.collect()} == {"h": "a", "g": "y", "k": "new"}


def test_a_copy_that_died_before_its_status_was_written_is_repeated_once(spark, tmp_path, monkeypatch):
    root, table, registry = tmp_path / "drive", str(tmp_path / "t"), str(tmp_path / "registry")
    make_tree(root)
    jobs.scan(spark, str(root), table, jobs.Options(drive="M:"))
    df = tables.read_table(spark, table)
    assert {r.drive_id for r in df.collect()} == {"M:"}
    tables.write_table(df.withColumns({"decision": F.lit("KEEP"), "organized_path": F.col("filename")}), table)
    write_table = tables.write_table
    monkeypatch.setattr(tables, "write_table", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        jobs.copy(spark, table, str(tmp_path / "out"), jobs.Options(registry=registry))
    n = tables.read_registry(spark, registry).count()
    monkeypatch.setattr(tables, "write_table", write_table)
    jobs.copy(spark, table, str(tmp_path / "out"), jobs.Options(registry=registry))
    assert n == tables.read_registry(spark, registry).count() > 3


def test_workspace_follows_the_session(spark):
    class Conf:
        @staticmethod
        def get(key, default):
            return {"spark.checkpoint.dir": "hdfs://shared/"}.get(key, default)

    class Session:
        conf = Conf

    assert new_folder(spark, "x") != new_folder(spark, "x")
    assert new_folder(Session, "x").startswith("hdfs://shared/x_")


def test_work_is_kept_beside_the_table_and_cleared(spark, tmp_path):
    table = str(tmp_path / "t")
    work = Work(spark, table)
    assert work.stored(spark.range(3), "x").count() == 3
    assert os.listdir(tmp_path) == ["t_work"]
    assert clear_work(spark, table) and not clear_work(spark, table)


def _rows(spark, rows):
    return conform(spark.createDataFrame(
        rows, "drive_id string, row_seq bigint, path string, filename string, recommendation string, summary string"))


def test_no_job_step_loses_or_adds_rows_with_equal_paths(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = [("D:", 1, "D:\\a", "null", "SKIP", None), ("D:", 2, "D:\\a", "NA", None, None),
            ("D:", None, "D:\\a", "None", None, None), ("D:", None, "D:\\b", None, None, "kept")]
    tables.write_table(_rows(spark, rows), table)
    jobs.rate(spark, table, lambda prompt: "[]")
    out = tables.read_table(spark, table)
    assert out.count() == 4 and out.where("recommendation is null").count() == 0
    assert {r.filename for r in out.collect()} == {"null", "NA", "None", None}
    edited = jobs.apply_edits(out, spark.createDataFrame(
        [("D:\\a", None, "KEEP"), ("D:\\a", "yes", None)], "path string, review string, decision string"))
    assert edited.count() == 4 and edited.where("decision = 'KEEP' and review = 'yes'").count() == 3
    done = spark.createDataFrame([("D:\\a", "x"), ("D:\\a", "y"), ("D:\\b", "z")], "path string, summary string")
    folded = content.fold_outcomes(edited, done, "summary", only_blank=True)
    assert sorted(r.summary for r in folded.collect()) == ["kept", "y", "y", "y"]


def test_batches_hold_rows_without_an_order_number(spark):
    rows = _rows(spark, [("D:", None, f"D:\\f{i}", "f", None, None) for i in range(50)])
    out = number_batches(rows, 8)
    assert out.count() == 50 and out.groupBy("batch_id").count().where("count > 8").count() == 0
    first = inventory.first_row_per_path(rows.unionByName(rows))
    assert first.count() == 50 and first.where("path is null").count() == 0


def test_csv_files_are_numbered_in_one_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("path,decision\n" + "".join(f"D:\\{name}{i},\n" for i in range(3)))
    files = [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]
    rows = tables.read_csv(spark, files, ["path"]).orderBy("row_seq").collect()
    assert [r.path[-2:] for r in rows] == ["b0", "b1", "b2", "a0", "a1", "a2"]
    assert len({r.row_seq for r in rows}) == 6


def test_an_inventory_without_deletes_gets_a_manifest_with_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("path,filename,size_bytes,is_dir,decision\nD:\\x,x,3,False,DELETE\n")
    (tmp_path / "b.csv").write_text("path,filename,size_bytes,is_dir,decision\nE:\\y,y,3,False,KEEP\n")
    files = [str(tmp_path / f"{n}.csv") for n in "ab"]
    totals = {r.source_csv[-5:]: r.total_rows for r in jobs.manifest_all(spark, files, str(tmp_path / "out")).collect()}
    assert totals == {"a.csv": 1, "b.csv": 0}
    empty = tmp_path / "out" / "manifest=b_delete_manifest.csv"
    assert [p.read_text().strip() for p in empty.glob("part-*")] == ["path,filename,size_bytes,decision_source"]


def test_a_directory_that_breaks_off_keeps_what_was_listed(monkeypatch):
    class Broken:
        def __init__(self):
            self.left = 1

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def __iter__(self):
            return self

        def __next__(self):
            if not self.left:
                raise OSError(5, "Input/output error")
            self.left -= 1
            return Entry()

    class Entry:
        name, path = "f.txt", "/d/f.txt"

        def is_dir(self):
            return False

        def is_symlink(self):
            return False

    monkeypatch.setattr(tree.os, "scandir", lambda d: Broken())
    rows = list(tree._visit("/d", set(), set()))
    assert [r[0] for r in rows] == ["dir", "file", "error"] and "Input/output" in rows[-1][-1]


def test_a_root_that_does_not_exist_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.scan(spark, str(tmp_path / "nowhere"), str(tmp_path / "t"))
