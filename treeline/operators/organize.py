"""Target paths for the files worth keeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import fixed_values as fixed
from treeline.functions.replies import normalised, parse_items
from treeline.functions.values import blank, in_values
from treeline.operators.batches import assemble, number_batches
from treeline.operators.hierarchy import resolve
from treeline.operators.skew import HOT_ROWS
from treeline.schema import ensure_columns

ITEM_FIELDS = ["path", "filename", "summary"]
REPLY_KEYS = ["original_path", "organized_path"]
# Taxonomy drafts merged per call.
MERGE_FAN_IN = 20


def organize_eligible(
    df: DataFrame, *, within: tuple[str, ...] = ("drive_id",), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Files with effective KEEP or ARCHIVE and a summary that is not an error text."""
    df = ensure_columns(df, ["summary"])
    resolved = resolve(df, ["decision"], within=within, hot_rows=hot_rows)
    summary = F.col("summary")
    failed = summary.startswith("UNREADABLE") | summary.startswith("LLM_ERROR")
    return resolved.where(
        in_values(F.col("effective_decision"), ["KEEP", "ARCHIVE"])
        & ~blank(summary) & ~failed & ~F.coalesce(F.col("is_dir"), F.lit(False)))


def organize_batches(eligible: DataFrame, size: int = fixed.DEFAULT_BATCH_SIZE) -> DataFrame:
    """(drive_id, batch_id, n_rows, items) with path, filename and summary as JSON."""
    return assemble(number_batches(eligible, size), ITEM_FIELDS)


#: Makes the calls of (keys, prompt) and returns (keys, reply, error).
Asking = Callable[[DataFrame, Callable[[str], str | None], list[str]], DataFrame]


def twice(ask: Callable[[str], str | None]) -> Callable[[str], tuple[str | None, str | None]]:
    """A call that fails or gives no text is made once more: (reply, None) or (None, error)."""
    def answer(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(2):
            try:
                reply = ask(prompt)
                if reply and reply.strip():
                    return reply, None
                error = "no usable reply"
            except Exception as e:  # any failure of the caller's model counts
                error = str(e)
        return None, error
    return answer


def ask_each(prompts: DataFrame, ask: Callable[[str], str | None], keys: list[str]) -> DataFrame:
    """(keys, reply, error): a call that fails twice has a null reply and says why."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in prompts.select(*keys).schema) + ", reply string, error string"
    answer = twice(ask)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [answer(p) for p in frame["prompt"]]
            yield frame[keys].assign(reply=[a[0] for a in answers], error=[a[1] for a in answers])

    return prompts.select(*keys, "prompt").mapInPandas(run, schema)


def check_replies(replies: DataFrame, what: str, keys: list[str]) -> None:
    """Raise with the first few keys when a call failed twice: nothing is left out in silence."""
    failed = replies.where(F.col("reply").isNull())
    some = failed.orderBy(*keys).limit(10).collect()
    if some:
        named = "; ".join(f"{[r[k] for k in keys]}: {r['error']}" for r in some)
        raise RuntimeError(f"{failed.count()} {what} failed twice: {named}")


def draft_taxonomy(
    batches: DataFrame, propose: Callable[[str], str], merge: Callable[[str], str], folder: str,
    asking: Asking = ask_each,
) -> str:
    """One taxonomy text over all summaries: a draft per batch, then merged in rounds.

    Every round is written to `folder` (shared storage), so no call is repeated when
    a later step fails. Only the last text comes to the driver. Raises when a draft or a
    merge fails twice.
    """
    spark = batches.sparkSession
    prompts = batches.select(
        F.xxhash64("drive_id", "batch_id").alias("slot"),
        F.concat_ws("/", "drive_id", "batch_id").alias("batches"), F.col("items").alias("prompt"))
    drafts = asking(prompts, propose, ["slot", "batches"])
    step = 0
    while True:
        target = f"{folder}/taxonomy_{step}"
        drafts.write.mode("overwrite").parquet(target)
        drafts = spark.read.parquet(target)
        check_replies(drafts, "taxonomy calls", ["batches"])
        n = drafts.count()
        if n <= 1:
            last = drafts.take(1)
            return last[0]["reply"] if last else ""
        groups = -(-n // MERGE_FAN_IN)
        ranked = number_batches(
            drafts.withColumn("_at", F.pmod("slot", F.lit(groups * 10_000))), MERGE_FAN_IN,
            scope=(), order="_at", then=[F.col("slot"), F.col("reply")])
        prompts = ranked.groupBy(F.col("batch_id").alias("slot")).agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "reply"))),
                        lambda x: x["reply"]), "\n\n").alias("prompt"),
            F.concat(F.min("batches"), F.lit(" and others")).alias("batches"))
        drafts = asking(prompts, merge, ["slot", "batches"])
        step += 1


def assign_batches(
    batches: DataFrame, taxonomy: str, assign: Callable[[str], str], asking: Asking = ask_each
) -> DataFrame:
    """(drive_id, batch_id, reply, error): the target paths proposed for each batch.

    A batch whose reply is unusable twice has a null reply.
    """
    def checked(prompt: str) -> str | None:
        return normalised(assign(prompt), REPLY_KEYS)

    prompts = batches.withColumn("prompt", F.concat(
        F.lit("Assign each file a relative path within one of these categories.\n"),
        F.lit(taxonomy),
        F.lit("\nAnswer with a JSON array of objects with the keys original_path and "
              "organized_path, and nothing else.\n\nFiles:\n"),
        F.col("items")))
    return asking(prompts, checked, ["drive_id", "batch_id"])


def parse_assignments(replies: DataFrame) -> DataFrame:
    """(drive_id, batch_id, original_path, organized_path, position) of usable replies."""
    parsed = replies.withColumn("_items", parse_items(F.col("reply"), REPLY_KEYS))
    return parsed.where(F.col("_items").isNotNull()).select(
        "drive_id", "batch_id", F.posexplode("_items").alias("position", "_item")
    ).select(
        "drive_id", "batch_id", "position",
        F.col("_item")["original_path"].alias("original_path"),
        F.col("_item")["organized_path"].alias("organized_path"))


def apply_assignments(df: DataFrame, eligible: DataFrame, assignments: DataFrame) -> DataFrame:
    """Set organized_path of eligible rows; the last assignment of a path counts.

    `assignments` holds (original_path, organized_path, position) and may give the
    batch_id, which then goes before the position, and the drive_id, which then has to
    match as well. Rows that are not eligible or not named keep what they have. Adds the
    boolean `assigned`.
    """
    df = ensure_columns(df, ["organized_path"])
    drive = [c for c in ("drive_id",) if c in assignments.columns]
    key = [*drive, "path"]
    order = F.struct(*[c for c in ("batch_id", "position") if c in assignments.columns])
    latest = assignments.groupBy(*drive, F.col("original_path").alias("path")).agg(
        F.max_by(F.struct("organized_path"), order).alias("_to"))
    targets = latest.join(eligible.select(*key), key, "left_semi")
    return df.join(targets, key, "left").withColumns({
        "organized_path": F.when(F.col("_to").isNotNull(), F.col("_to.organized_path"))
        .otherwise(F.col("organized_path")),
        "assigned": F.col("_to").isNotNull(),
    }).select(*df.columns, "assigned")


def rule_target(filename: Column, ext: Column, modified: Column) -> Column:
    """A target without a model: kind of file / year / name."""
    e = F.lower(F.coalesce(ext, F.lit("")))
    kind = (
        F.when(e.isin(".docx", ".pdf", ".xlsx"), "Documents")
        .when(e.isin(fixed.IMAGE_EXTENSIONS), "Pictures")
        .when(e.isin(fixed.TEXT_EXTENSIONS), "Text")
        .otherwise("Files")
    )
    year = F.coalesce(F.year(modified.try_cast("timestamp_ntz")).cast("string"), F.lit("undated"))
    return F.concat_ws("/", kind, year, filename)
