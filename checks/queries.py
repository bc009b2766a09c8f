"""One callable per operator: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from treeline.functions import paths, replies, values
from treeline.operators import (
    content, deletion, duplicates, hierarchy, inventory, organize, recovery, reports, triage,
)
from treeline.plans import sample_inventory as sample
from treeline.sources import ledger, tables
from treeline.sources.workspace import new_folder
from treeline.streaming import arrivals


def _flag(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def inventory_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return sample.files(spark, d).select(
        "drive_id", "row_seq", "path", "filename", "extension", "size_bytes", "modified",
        "md5_hash", paths.compare_key(path).alias("path_key"),
        paths.parent_key(path).alias("parent_key"), paths.depth(path).alias("depth"),
        paths.drive_letter(path).alias("drive_letter"),
        paths.join_path(F.concat(F.col("drive_id"), F.lit("\\")), F.col("filename")).alias("at_root"))


def inventory_dirs(spark: SparkSession, d: str) -> DataFrame:
    return inventory.directory_rows(sample.files(spark, d)).select("drive_id", "row_seq", "path")


def excluded_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = inventory.prune_excluded_dirs(
        inventory.drop_excluded_extensions(sample.conformed(spark, d)))
    return kept.select("drive_id", "path", "recommendation", "confidence", "comment")


def resume_new_rows(spark: SparkSession, d: str) -> DataFrame:
    inv = sample.conformed(spark, d)
    return inventory.new_rows(inv, fx.earlier_paths(inv)).select(
        "drive_id", "row_seq", "path", _flag("is_dir"))


def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    inv = sample.conformed(spark, d)
    return inventory.remaining_work(inv, fx.earlier_paths(inv), by=["drive_id"])


def hash_winners(spark: SparkSession, d: str) -> DataFrame:
    """The row that stands for each hash: last on the baseline, first on a drive."""
    inv = sample.conformed(spark, d)
    last = duplicates.baseline_hashes(inv.where(F.col("drive_id") == sample.BASELINE_DRIVE))
    first = duplicates.first_of_hash(inv)
    return first.join(last, "md5_hash", "left").select(
        "drive_id", "md5_hash", "first_path", "n", "baseline_path")


def duplicate_kinds(spark: SparkSession, d: str) -> DataFrame:
    return fx.classified(spark, d).select(
        "drive_id", "path", _flag("is_duplicate"), "duplicate_kind", "duplicate_source_path",
        "comment")


def mark_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.mark_duplicates(fx.classified(spark, d)).select(
        "drive_id", "path", "recommendation", "confidence", "decision", "comment")


def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_summary(
        duplicates.mark_duplicates(fx.classified(spark, d)), ["drive_id"])


def effective_decision(spark: SparkSession, d: str) -> DataFrame:
    resolved = hierarchy.resolve(sample.conformed(spark, d), ["decision"])
    return resolved.select(
        "drive_id", "row_seq", "path", "effective_decision", _flag("decision_distance"),
        hierarchy.source_text("decision").alias("decision_source"))


def effective_review_and_decision(spark: SparkSession, d: str) -> DataFrame:
    resolved = hierarchy.resolve(sample.conformed(spark, d), ["review", "decision"])
    return resolved.select(
        "drive_id", "row_seq", "path", "effective_review", "effective_decision",
        _flag("review_distance"), _flag("decision_distance"))


def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_path(
        sample.conformed(spark, d), fx.ASKED_PATH, ["review", "decision", "owner"])


def effective_delete_set(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths_with_value(sample.conformed(spark, d), "decision", "delete")


def delete_manifest(spark: SparkSession, d: str) -> DataFrame:
    return deletion.delete_manifest(sample.conformed(spark, d)).select(
        "drive_id", "path", "filename", "size_bytes", "decision_source")


def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return deletion.manifest_totals(deletion.delete_manifest(sample.conformed(spark, d)))


def manifest_per_drive(spark: SparkSession, d: str) -> DataFrame:
    listed = deletion.delete_manifest(sample.conformed(spark, d))
    source = F.concat(F.lit("reports/drive_"), F.lower(F.substr("drive_id", F.lit(1), F.lit(1))),
                      F.lit(".csv"))
    named = listed.withColumn("manifest", deletion.manifest_name(source))
    return deletion.manifest_totals(named, ["manifest"])


def _directory_manifest(inv: DataFrame) -> DataFrame:
    """The delete set as it was before anybody decided about single files."""
    before = inv.withColumn("decision", F.when(F.col("is_dir"), F.col("decision")))
    return hierarchy.paths_with_value(before, "decision", "DELETE")


def manifest_guard(spark: SparkSession, d: str) -> DataFrame:
    inv = sample.conformed(spark, d)
    current = hierarchy.paths_with_value(inv, "decision", "DELETE")
    return deletion.manifest_guard(current, _directory_manifest(inv), ["drive_id"])


def _delete_input(spark: SparkSession, d: str) -> DataFrame:
    pruned = F.col("is_dir") & (paths.base_name(F.col("path")) == "b5")
    return sample.conformed(spark, d).withColumns({
        "comment": F.when(pruned, "Excluded by config"),
        "delete_status": F.when(F.col("size_bytes") > 5000, " deleted"),
    })


def _plan_tables(inv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest and the subtree plan as tables, as people would review them."""
    manifest = sample.kept(deletion.delete_manifest(inv))
    return manifest, sample.kept(deletion.subtree_candidates(inv, manifest))


def subtree_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _plan_tables(_delete_input(spark, d))[1].select(
        "drive_id", "path", "separators", _flag("has_pruned_descendant"))


def covered_rows(spark: SparkSession, d: str) -> DataFrame:
    inv = _delete_input(spark, d)
    return deletion.covered_rows(inv, _plan_tables(inv)[1]).select(
        "drive_id", "path", _flag("covered"))


def delete_files_plan(spark: SparkSession, d: str) -> DataFrame:
    inv = _delete_input(spark, d)
    return deletion.delete_files_plan(inv, *_plan_tables(inv)).select(
        "drive_id", "path", "size_bytes")


def delete_outcomes(spark: SparkSession, d: str) -> DataFrame:
    inv = _delete_input(spark, d)
    manifest, subtrees = _plan_tables(inv)
    trees = subtrees.select("drive_id", "path", F.when(
        F.col("has_pruned_descendant"), "FAILED").otherwise("DELETED").alias("delete_status"))
    single = deletion.delete_files_plan(inv, manifest, subtrees).select(
        "drive_id", "path", F.when(F.col("extension") == ".exe", "FAILED")
        .otherwise("DELETED").alias("delete_status"))
    return deletion.apply_delete_outcomes(inv, trees, single).select(
        "drive_id", "path", "delete_status")


def triage_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.triage_input(spark, d)
    return rows.select("drive_id", "path", "batch_id", "batch_pos")


def triage_payloads(spark: SparkSession, d: str) -> DataFrame:
    marked = duplicates.mark_duplicates(fx.classified(spark, d))
    return triage.triage_batches(marked).select(
        "drive_id", "batch_id", "n_rows", F.length("items").cast("long").alias("n_chars"),
        F.md5("items").alias("items_md5"))


def rule_triage(spark: SparkSession, d: str) -> DataFrame:
    return triage.rule_ratings(sample.conformed(spark, d)).select(
        "drive_id", "path", "recommendation", "confidence", "comment")


def triage_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = triage.parse_replies(fx.replies(fx.triage_input(spark, d)))
    line = F.transform("parsed", lambda m: F.concat_ws(
        "|", *(F.coalesce(m[k], F.lit("-")) for k in triage.REPLY_KEYS)))
    return parsed.select(
        "drive_id", "batch_id", F.coalesce(F.size("parsed"), F.lit(-1)).cast("long").alias("n_items"),
        F.md5(F.array_join(line, "\n")).alias("items_md5"))


def triage_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.triage_input(spark, d)
    return triage.apply_replies(rows, fx.replies(rows)).select(
        "drive_id", "path", "recommendation", "confidence", "comment",
        _flag("recommendation_valid"))


def summarize_eligible(spark: SparkSession, d: str) -> DataFrame:
    inv = sample.conformed(spark, d).withColumn(
        "summary", F.when(F.col("extension") == ".md", "done").otherwise(" "))
    return content.summarize_eligible(inv).select(
        "drive_id", "path", "effective_review", "effective_decision")


def content_route(spark: SparkSession, d: str) -> DataFrame:
    return sample.files(spark, d).select(
        "drive_id", "path", content.content_route(F.col("extension")).alias("route"))


def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    """Every text cut to the words sent to a model, as length and hash."""
    cut = content.truncate_words(F.col("text"), 300)
    return sample.files(spark, d).withColumn("cut", cut).select(
        "drive_id", "row_seq", F.length("cut").cast("long").alias("n_chars"),
        F.md5("cut").alias("cut_md5"))


def _known_complexity(spark: SparkSession, d: str) -> DataFrame:
    return sample.files(spark, d).where(F.col("extension") == ".pdf").select(
        "path", F.when(F.col("review") == "True", " Simple ")
        .when(F.col("review") == "no", "complex").otherwise("").alias("pdf_complexity"))


def pdf_complexity(spark: SparkSession, d: str) -> DataFrame:
    pages = sample.pdf_pages(spark, d)
    fresh = content.pdf_complexity(pages)
    cached = content.pdf_complexity(pages, _known_complexity(spark, d)).select(
        "path", F.col("is_complex").cast("long").alias("is_complex_cached"))
    return fresh.join(cached, "path").select(
        "path", "n_pages", "total_chars", _flag("has_images"), _flag("sparse"),
        _flag("is_complex"), "is_complex_cached")


def pdf_complexity_fill(spark: SparkSession, d: str) -> DataFrame:
    inv = sample.files(spark, d).withColumn(
        "pdf_complexity", F.when(F.col("review") == "no", "complex"))
    facts = content.pdf_complexity(sample.pdf_pages(spark, d))
    return content.fill_pdf_complexity(inv, facts).select("drive_id", "path", _text("pdf_complexity"))


def pdf_text(spark: SparkSession, d: str) -> DataFrame:
    joined = content.pdf_content(sample.pdf_pages(spark, d))
    return joined.select("path", F.length("content").cast("long").alias("n_chars"),
                         F.md5("content").alias("content_md5"))


def sheet_preview(spark: SparkSession, d: str) -> DataFrame:
    return content.sheet_preview(sample.sheet_rows(spark, d)).select(
        "path", "sheet", "row_no", F.col("shown").cast("long").alias("shown"))


def sheet_text(spark: SparkSession, d: str) -> DataFrame:
    joined = content.sheet_content(sample.sheet_rows(spark, d))
    return joined.select("path", F.length("content").cast("long").alias("n_chars"),
                         F.md5("content").alias("content_md5"))


def paragraph_join(spark: SparkSession, d: str) -> DataFrame:
    joined = content.paragraph_content(sample.paragraphs(spark, d))
    return joined.select("path", F.length("content").cast("long").alias("n_chars"),
                         F.md5("content").alias("content_md5"))


def organize_eligible(spark: SparkSession, d: str) -> DataFrame:
    inv = fx.with_summaries(sample.conformed(spark, d))
    return organize.organize_eligible(inv).select("drive_id", "path", "filename", "summary")


def organize_payloads(spark: SparkSession, d: str) -> DataFrame:
    inv = fx.with_summaries(sample.conformed(spark, d))
    return organize.organize_batches(organize.organize_eligible(inv), 25).select(
        "drive_id", "batch_id", "n_rows", F.md5("items").alias("items_md5"))


def apply_assignments(spark: SparkSession, d: str) -> DataFrame:
    inv = fx.with_summaries(fx.with_targets(sample.conformed(spark, d)))
    eligible = organize.organize_eligible(inv)
    return organize.apply_assignments(inv, eligible, fx.assignments(inv)).select(
        "drive_id", "path", "organized_path", _flag("assigned"))


def rule_targets(spark: SparkSession, d: str) -> DataFrame:
    return sample.files(spark, d).select("drive_id", "path", organize.rule_target(
        F.col("filename"), F.col("extension"), F.col("modified")).alias("organized_path"))


def copy_plan(spark: SparkSession, d: str) -> DataFrame:
    return fx.plan(spark, d).select("drive_id", "path", "organized_path", "dest", "plan_status")


def copy_verify(spark: SparkSession, d: str) -> DataFrame:
    planned = fx.reviewed_plan(spark, d)
    return recovery.verify_copies(planned, fx.copied_files(planned)).select(
        "drive_id", "path", "copy_status")


def copy_counts(spark: SparkSession, d: str) -> DataFrame:
    planned = fx.reviewed_plan(spark, d)
    return recovery.copy_counts(
        recovery.verify_copies(planned, fx.copied_files(planned)), ["drive_id"])


def kept_registry_rows(spark: SparkSession, d: str) -> DataFrame:
    planned = fx.reviewed_plan(spark, d)
    done = recovery.verify_copies(planned, fx.copied_files(planned))
    return recovery.registry_rows(done, F.lit(fx.COPIED_AT))


def status_fold(spark: SparkSession, d: str) -> DataFrame:
    inv = fx.with_targets(sample.conformed(spark, d))
    planned = fx.reviewed_plan(spark, d)
    outcomes = recovery.verify_copies(planned, fx.copied_files(planned))
    return content.fold_outcomes(inv, outcomes, "copy_status", ["drive_id", "path"]).select(
        "drive_id", "path", "copy_status")


def duplicates_report(spark: SparkSession, d: str) -> DataFrame:
    marked = duplicates.mark_duplicates(fx.classified(spark, d)).withColumn(
        "source_csv", F.concat(F.lit("drive "), F.col("drive_id")))
    return reports.duplicates_report(marked)


def report_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.report_totals(duplicates_report(spark, d), ["source_csv"])


def review_shortlist(spark: SparkSession, d: str) -> DataFrame:
    rated = triage.rule_ratings(fx.classified(spark, d))
    return inventory.review_shortlist(rated).select(
        "drive_id", "path", "sort_dir", "recommendation")


def blank_values(spark: SparkSession, d: str) -> DataFrame:
    """Blank and unset cells per drive, and digit texts among the lines of all files."""
    inv = sample.inventory(spark, d)
    return inv.groupBy("drive_id").agg(
        F.count_if(values.blank(values.null_if_token(F.col("decision")))).alias("blank_decisions"),
        F.count_if(values.unset(F.col("decision"))).alias("unset_decisions"),
        F.count_if(values.in_values(F.col("decision"), ["delete"])).alias("deletes"),
        F.sum(values.digits_to_long(paths.base_name(F.col("path")))).alias("digit_names"))


def unfenced_replies(spark: SparkSession, d: str) -> DataFrame:
    """Every document and page as a fenced reply, and the text without its fence."""
    fenced = F.concat(F.lit(" ```JSON\n"), F.col("text"), F.lit("\n```\n"))
    return sample.files(spark, d).select(
        "drive_id", "row_seq", F.md5(replies.unfenced(fenced)).alias("body_md5"))


def ledger_calls(spark: SparkSession, d: str) -> DataFrame:
    """All triage prompts, twice each, in two runs: the first dies early and fails for some."""
    folder, step = new_folder(spark, "calls"), F.col("batch_id") % 5
    marked = duplicates.mark_duplicates(fx.classified(spark, d))
    batches = sample.kept(triage.triage_batches(marked).select("drive_id", "batch_id", F.col("items").alias("prompt")))
    calls = batches.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))

    def first(prompt: str) -> tuple[str | None, str | None]:
        return (None, "busy") if len(prompt) % 3 == 0 else (f"one {prompt[-60:]}", None)

    def second(prompt: str) -> tuple[str | None, str | None]:
        return f"two {prompt[-60:]}", None

    ledger.ask_all(sample.kept(calls.where(step < 3)), folder, first, ["prompt"], wave=7)
    asked = ledger.ask_all(calls, folder, second, ["prompt"], wave=7)
    attempts = ledger.read_ledger(spark, folder).groupBy("digest").agg(F.count("*").alias("n_attempts"))
    named = asked.withColumn("digest", ledger.call_digest(["prompt"]))
    return named.join(attempts, "digest").select("drive_id", "batch_id", "copy", "reply", "error", "n_attempts")


def registry_appends(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of all files in three appends, the last made twice: the last row of each hash."""
    folder = new_folder(spark, "registry")
    every = sample.kept(sample.files(spark, d).select(
        "md5_hash", F.col("path").alias("original_path"), F.concat(F.lit("to/"), "filename").alias("organized_path"),
        F.col("drive_id").alias("drive"), F.lit(fx.COPIED_AT).alias("date_copied"), "row_seq"))
    for k in (0, 1, 2, 2):
        part = every.where(F.col("row_seq") % 3 == k).orderBy("row_seq", "original_path")
        tables.append_registry(part, folder, f"run {k}")
    rows = tables.read_registry(spark, folder).withColumn("appended", F.struct("append_no", "row_no"))
    n = rows.groupBy("md5_hash").agg(F.count("*").alias("n_rows"), F.max("append_no").alias("last_append"))
    return duplicates.registry_hashes(rows, "appended").join(n, "md5_hash")


def summary_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What the summariser is given for every file, from the pieces of its decoder."""
    todo, parts = sample.kept(sample.to_summarize(spark, d)), sample.kept(sample.pieces(spark, d))
    facts = content.pdf_facts(todo, parts)
    return content.file_contents(todo, parts, facts).select(
        "drive_id", "path", "kind", F.length("content").cast("long").alias("n_chars"),
        F.md5("content").alias("content_md5"))


def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents written as CSV in two column orders and read back as records."""
    folder = new_folder(spark, "csv")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("path"), F.concat(F.lit('"'), "text", F.lit(',"\n')).alias("comment"), "lang")
    halves = {"even": docs.where("path % 2 = 0"),
              "odd": docs.where("path % 2 = 1").select("lang", F.lit("x\n").alias("more"), "comment", "path")}
    for name, half in halves.items():
        tables.write_csv(half, f"{folder}/{name}")
    rows = tables.read_csv(spark, [f"{folder}/{name}" for name in halves], ["path", "comment", "lang", "more"])
    return rows.select(
        F.col("path").cast("long").alias("doc_id"), "lang", "more",
        F.regexp_extract("source_csv", "[a-z]+$", 0).alias("half"),
        F.length("comment").cast("long").alias("n_chars"), F.md5("comment").alias("comment_md5"))


def incremental_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The whole inventory arriving as a stream of three drops, by ranges of row_seq."""
    folder, inv = new_folder(spark, "arrivals"), sample.conformed(spark, d)
    known, kept = fx.lookups(spark, d)
    last = inv.agg(F.max("row_seq")).first()[0] or 0
    drop = F.floor(3 * F.col("row_seq") / (last + 1))
    for k in range(3):
        inv.where(drop == k).write.mode("append").parquet(f"{folder}/drops")
        out = arrivals.run_available(
            spark, f"{folder}/drops", f"{folder}/state", baseline=known, registry=kept,
            baseline_drive=sample.BASELINE_DRIVE)
    return out.select(
        "drive_id", "path", _flag("is_duplicate"), "duplicate_kind", "duplicate_source_path",
        "comment")


def rate_fold(spark: SparkSession, d: str) -> DataFrame:
    """Rows to rate and all others put together again, with each path twice: none goes or grows."""
    marked = duplicates.mark_duplicates(fx.twice(fx.classified(spark, d)))
    rated = triage.rule_ratings(triage.needs_triage(marked))
    return triage.needs_no_triage(marked).unionByName(rated).groupBy("drive_id", "path").agg(
        F.count("*").alias("n_rows"), F.min("recommendation").alias("recommendation"),
        F.count_if(triage.needs_triage_column()).alias("still_open"))


def summary_fold(spark: SparkSession, d: str) -> DataFrame:
    """Summaries folded into an inventory with each path twice; a summary that is there stays."""
    inv = fx.twice(sample.conformed(spark, d)).withColumn(
        "summary", F.when(F.col("row_seq") % 2 == 1, "kept").otherwise(""))
    work = inv.where(~F.col("is_dir")).select("drive_id", "path", F.col("md5_hash").alias("summary"))
    done = content.fold_outcomes(inv, work, "summary", ["drive_id", "path"], only_blank=True)
    return done.groupBy("drive_id", "path").agg(
        F.count("*").alias("n_rows"), F.min("summary").alias("least"), F.max("summary").alias("most"))


QUERIES = [
    inventory_files, inventory_dirs, excluded_filtered, resume_new_rows, remaining_work,
    hash_winners, duplicate_kinds, mark_duplicates, duplicate_summary, effective_decision,
    effective_review_and_decision, resolve_path, effective_delete_set, delete_manifest,
    manifest_totals, manifest_per_drive, manifest_guard, subtree_candidates, covered_rows,
    delete_files_plan, delete_outcomes, triage_batches, triage_payloads, rule_triage,
    triage_parse, triage_apply, summarize_eligible, content_route, truncate_words,
    pdf_complexity, pdf_complexity_fill, pdf_text, sheet_preview, sheet_text, paragraph_join,
    organize_eligible, organize_payloads, apply_assignments, rule_targets, copy_plan,
    copy_verify, copy_counts, kept_registry_rows, status_fold, duplicates_report,
    report_totals, review_shortlist, blank_values, unfenced_replies, incremental_inventory,
    rate_fold, summary_fold, csv_records, ledger_calls, registry_appends, summary_inputs,
]
