"""The jobs of the working cycle: scan, mark, rate, summarise, organise, copy, delete.

A job takes an inventory table (a folder with versions), reads its last version and
writes the next one. Edits people make between jobs are an overlay table joined in
with apply_edits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import fixed_values as fixed
from treeline.functions import paths
from treeline.functions.values import blank
from treeline.operators import (
    content, deletion, duplicates, hierarchy, inventory, organize, recovery, reports, triage,
)
from treeline.schema import conform, ensure_columns
from treeline.sources import ledger, tables, tree
from treeline.sources.workspace import Work, calls_folder


@dataclass
class Options:
    """Settings shared by the jobs."""

    exclude_dirs: list[str] = field(default_factory=lambda: list(fixed.EXCLUDED_DIRS))
    exclude_extensions: list[str] = field(default_factory=lambda: list(fixed.EXCLUDED_EXTENSIONS))
    registry: str | None = None
    baseline: str | None = None
    batch_size: int = fixed.DEFAULT_BATCH_SIZE
    max_words: int = fixed.DEFAULT_MAX_WORDS
    concurrency: int | None = None
    min_dup_bytes: int = 0
    archive_prefix: str | None = None
    instructions: str = triage.INSTRUCTIONS
    #: Name of the drive, for trees whose paths do not begin with one.
    drive: str | None = None
    #: The drives that a phase works on; the files of all others stay as they are.
    drives: list[str] | None = None
    #: Name of the model: replies of another one do not count as given.
    model: str = ""
    #: Model calls between two writes of their replies.
    wave: int = ledger.WAVE


def _ask(
    calls: DataFrame, table: str, answer: ledger.Answer, inputs: list[str], o: Options, step: str
) -> DataFrame:
    """Calls of one step through the record beside the table: a rerun asks only what is open."""
    return ledger.ask_all(
        calls, calls_folder(table), answer, inputs, model=f"{o.model}/{step}", run=uuid.uuid4().hex,
        wave=o.wave, concurrency=o.concurrency)


def _drive(o: Options) -> Column:
    return F.lit(o.drive) if o.drive else paths.drive(F.col("path"))


def _lookups(spark: SparkSession, table: str, options: Options) -> tuple[DataFrame, DataFrame]:
    baseline = "md5_hash string, baseline_path string"
    kept = spark.createDataFrame([], "md5_hash string, kept_path string, kept_target string")
    if options.baseline and options.baseline.rstrip("/") != table.rstrip("/"):
        known = duplicates.baseline_hashes(tables.read_table(spark, options.baseline))
    else:
        known = spark.createDataFrame([], baseline)
    if options.registry:
        rows = tables.read_registry(spark, options.registry)
        kept = duplicates.registry_hashes(
            rows.withColumn("appended", F.struct("append_no", "row_no")), "appended")
    return known, kept


def scan(spark: SparkSession, root: str, table: str, options: Options | None = None) -> DataFrame:
    """List a tree, hash what is new, find duplicates and append the rows.

    Known paths are removed before any file is read. Returns the rows added.
    """
    o = options or Options()
    work = Work(spark, table)
    listing = tree.list_tree(
        spark, root, work.path("listing"), exclude_dirs=o.exclude_dirs,
        exclude_extensions=o.exclude_extensions)
    known = tables.read_table(spark, table)
    fresh = inventory.new_rows(
        listing.withColumn("drive_id", _drive(o)), inventory.seen_paths(known), ["drive_id", "path"])
    last = known.agg(F.max("row_seq")).first()[0]
    numbered = work.stored(tree.number_rows(fresh, 0 if last is None else last + 1), "numbered")
    hashed = work.stored(tree.hash_files(numbered), "hashed")
    baseline, registry = _lookups(spark, table, o)
    rows = duplicates.classify(
        conform(hashed), baseline, registry, earlier=known, min_dup_bytes=o.min_dup_bytes)
    added = work.stored(rows, "scanned")
    tables.append_rows(added, table)
    return added


def estimate(spark: SparkSession, root: str, table: str, options: Options | None = None) -> DataFrame:
    """Items and bytes a scan of the tree would still have to read."""
    o = options or Options()
    listing = conform(tree.list_tree(
        spark, root, Work(spark, table).path("listing"), exclude_dirs=o.exclude_dirs,
        exclude_extensions=o.exclude_extensions).withColumn("drive_id", _drive(o)))
    seen = inventory.seen_paths(tables.read_table(spark, table))
    counted = listing.where(
        ~F.col("is_dir") | F.coalesce(F.col("comment") == fixed.COMMENT_EXCLUDED, F.lit(False)))
    return inventory.new_rows(counted, seen, ["drive_id", "path"]).agg(
        F.count("*").alias("remaining_items"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("remaining_bytes"))


def ingest_csv(spark: SparkSession, files: str | list[str], table: str) -> int:
    """Take existing CSV inventories into a table; row numbers are fixed here."""
    return tables.write_table(tables.read_inventory_csv(spark, files), table)


def apply_edits(df: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """Lay reviews and decisions of (path, review, decision) over an inventory.

    Edits with a drive_id are for that drive only. A null leaves the value as it is, an empty
    text clears it. Of several edits of one path the last by the column `order` counts, for
    each of the two values; without it, or among equals, the last in text order.
    """
    df = ensure_columns(df, ["review", "decision"])
    key = [c for c in ("drive_id", "path") if c in edits.columns]
    at = F.col(order) if order else F.lit(0)
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))
            for c in ("review", "decision")}
    new = edits.groupBy(*key).agg(*(v.alias(f"_{c}") for c, v in last.items()))
    return df.join(new, key, "left").withColumns({
        c: F.coalesce(f"_{c}", c) for c in last}).select(*df.columns)


def mark_duplicates(spark: SparkSession, table: str, options: Options | None = None) -> DataFrame:
    """Mark duplicates in the table; returns the summary."""
    drives = (options or Options()).drives
    tables.write_table(duplicates.mark_duplicates(tables.read_table(spark, table, drives)), table, drives)
    return duplicates.duplicate_summary(tables.read_table(spark, table, drives))


def rate(
    spark: SparkSession, table: str, scorer: triage.Scorer, options: Options | None = None
) -> None:
    """Rate the rows without a recommendation, in batches, with the caller's scorer."""
    o = options or Options()
    work = Work(spark, table)
    marked = duplicates.mark_duplicates(tables.read_table(spark, table, o.drives))
    rows = work.stored(triage.triage_rows(marked, o.batch_size), "triage_rows")
    prompts = triage.with_prompt(triage.assemble(rows, triage.ITEM_FIELDS), o.instructions)
    calls = work.stored(prompts.select("drive_id", "batch_id", "prompt"), "prompts")
    replies = _ask(calls, table, triage.triage_answer(scorer), ["prompt"], o, "rate").drop("prompt")
    rated = triage.apply_replies(rows, replies).drop("batch_id", "batch_pos")
    rest = triage.needs_no_triage(marked)
    tables.write_table(rest.unionByName(rated, allowMissingColumns=True), table, o.drives)


def summarize(
    spark: SparkSession, table: str, decoder: content.Decoder,
    summarizer: content.Summarizer, options: Options | None = None,
) -> None:
    """Summarise the files under review.

    A file is opened at its `source_uri`, or at its path where the table has none. Text files are
    decoded here, PDF, Word, Excel and image files by `decoder`, which yields their pieces.
    """
    o, work = options or Options(), Work(spark, table)
    df = ensure_columns(tables.read_table(spark, table, o.drives), ["summary", "pdf_complexity", "source_uri"])
    # One row per drive and path, whole and the first: the same file is summarised once.
    first = F.min(F.struct(F.coalesce("row_seq", F.lit(2 ** 63 - 1)).alias("at"), F.coalesce(
        "source_uri", "path").alias("uri"), "extension", "pdf_complexity"))
    files = work.stored(content.summarize_eligible(df).groupBy(*content.KEY).agg(first.alias("f")).select(
        *content.KEY, content.content_route(F.col("f.extension")).alias("route"), "f.uri",
        "f.pdf_complexity"), "to_summarize")
    tasks = o.concurrency or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = work.stored(content.decode_pieces(files.repartition(tasks, *content.KEY), decoder), "pieces")
    facts = work.stored(content.pdf_facts(files, pieces), "pdf_facts")
    contents = work.stored(content.cut_content(
        content.file_contents(files, pieces, facts), o.max_words), "contents")
    calls = contents.where(F.col("kind") != "error")
    replies = _ask(calls, table, content.summary_answer(summarizer), ["kind", "content"], o, "summarize")
    none = F.lit(None).cast("string")
    done = replies.unionByName(contents.where(F.col("kind") == "error").withColumns({"reply": none, "error": none}))
    done = work.stored(done.select(*content.KEY, content.summary_text(
        *(F.col(c) for c in ("kind", "content", "reply", "error"))).alias("summary")), "summaries")
    out = content.fold_outcomes(df, done, "summary", content.KEY, only_blank=True)
    tables.write_table(content.fill_pdf_complexity(out, facts, content.KEY), table, o.drives)


class Organised(NamedTuple):
    taxonomy: str
    assigned: int


def organise(
    spark: SparkSession, table: str, propose: Callable[[str], str], merge: Callable[[str], str],
    assign: Callable[[str], str], options: Options | None = None,
) -> Organised:
    """Propose a taxonomy, assign target paths in batches; returns both.

    Raises, and changes nothing, when a call fails twice; the replies there are stay known.
    """
    o = options or Options()
    df, work = tables.read_table(spark, table, o.drives), Work(spark, table)
    eligible = work.stored(organize.organize_eligible(df), "organizable")
    batches = work.stored(organize.organize_batches(eligible, o.batch_size), "organize_batches")
    steps = {propose: "propose", merge: "merge"}

    def asking(prompts: DataFrame, ask: Callable[[str], str | None], keys: list[str]) -> DataFrame:
        step = steps.get(ask, "assign")
        calls = work.stored(prompts.select(*keys, "prompt"), f"{step}_{uuid.uuid4().hex}")
        return _ask(calls, table, organize.twice(ask), ["prompt"], o, step).select(*keys, "reply", "error")

    taxonomy = organize.draft_taxonomy(batches, propose, merge, work.path("taxonomy"), asking)
    replies = work.stored(organize.assign_batches(batches, taxonomy, assign, asking), "assignments")
    organize.check_replies(replies, "assignment calls", ["drive_id", "batch_id"])
    assigned = work.stored(organize.apply_assignments(
        df, eligible, organize.parse_assignments(replies)), "assigned")
    tables.write_table(assigned.drop("assigned"), table, o.drives)
    return Organised(taxonomy, assigned.where("assigned").count())


def copy(spark: SparkSession, table: str, dest_root: str, options: Options | None = None) -> DataFrame:
    """Copy the kept files, verify them, extend the registry; returns the counts."""
    o = options or Options()
    df, work = tables.read_table(spark, table, o.drives), Work(spark, table)
    plan = work.stored(recovery.copy_plan(
        recovery.copy_eligible(df), dest_root, archive_prefix=o.archive_prefix), "copy_plan")
    copied = work.stored(recovery.run_copies(plan, o.concurrency), "copied")
    verified = work.stored(recovery.verify_copies(plan, copied), "verified")
    if o.registry:
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        # A run that died behind this step is repeated on the same version: it adds nothing twice.
        run = f"{table.rstrip('/')}@{tables.last_version(spark, table)}"
        tables.append_registry(recovery.registry_rows(verified, stamp), o.registry, run)
    tables.write_table(
        content.fold_outcomes(df, verified, "copy_status", ["drive_id", "path"]), table, o.drives)
    return recovery.copy_counts(verified)


def manifest(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """Write the delete manifest as CSV; returns the totals."""
    rows = Work(spark, folder).stored(deletion.delete_manifest(tables.read_table(spark, table)), "manifest")
    tables.write_manifest(rows, folder)
    return deletion.manifest_totals(rows)


def manifest_all(spark: SparkSession, files: list[str], folder: str) -> DataFrame:
    """Manifests of several CSV inventories in one job; returns totals per inventory.

    An inventory without anything to delete gets a manifest with a header only.
    """
    names, work = ["path", "filename", "size_bytes", "is_dir", "decision"], Work(spark, folder)
    rows = tables.read_csv(spark, files, names).where(~blank(F.col("path")))
    inv = work.stored(conform(rows, from_csv=True), "inventories")
    listed = work.stored(deletion.delete_manifest(inv, within=("source_csv",)), "manifests")
    tables.write_manifests_per_drive(listed, "source_csv", folder)
    totals = deletion.manifest_totals(listed, ["source_csv"])
    every = spark.createDataFrame([(f,) for f in files], "source_csv string").distinct()
    found = every.join(totals, "source_csv", "left")
    none = [r["source_csv"] for r in found.where("total_rows is null").collect()]
    tables.write_empty_manifests(spark, none, folder)
    return found.na.fill(0)


def delete_plan(spark: SparkSession, table: str, manifest_folder: str) -> tuple[DataFrame, DataFrame]:
    """Check the reviewed manifest, then return the subtree plan and the single files.

    Raises when the manifest no longer matches the table. Nothing is deleted.
    """
    df, work = tables.read_table(spark, table), Work(spark, manifest_folder)
    current = work.stored(hierarchy.paths_with_value(df, "decision", "DELETE"), "delete_set")
    deletion.check_manifest(current, tables.read_manifest(spark, manifest_folder))
    subtrees = work.stored(deletion.subtree_candidates(df, current), "subtrees")
    return subtrees, deletion.delete_files_plan(df, current, subtrees)


def resolve(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Effective review and decision of one path; only row groups on its way up are read."""
    return hierarchy.resolve_path(
        tables.read_table(spark, table, with_key=True), path, ["review", "decision"])


def duplicates_report(spark: SparkSession, files: list[str], folder: str) -> DataFrame:
    """Write the report over several CSV inventories; returns its totals."""
    report = Work(spark, folder).stored(reports.duplicates_report(tables.read_report_input(spark, files)), "report")
    tables.write_report(report, folder)
    return reports.report_totals(report)
