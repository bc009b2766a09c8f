"""Batch scoring of the rows that are neither duplicates nor rated yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import fixed_values as fixed
from treeline.functions import paths
from treeline.functions.replies import normalised, parse_items
from treeline.functions.values import is_true, unset
from treeline.operators.batches import assemble, number_batches
from treeline.schema import ensure_columns

ITEM_FIELDS = ["path", "filename", "extension", "is_dir", "size_bytes", "modified"]
REPLY_KEYS = ["path", "recommendation", "confidence", "comment"]
RATINGS = ["INTERESTING", "REVIEW", "SKIP"]

#: What a reply has to look like; what to judge by is the caller's to say.
INSTRUCTIONS = (
    "Rate each item INTERESTING, REVIEW or SKIP. Answer only with a JSON array of objects with"
    " the keys path, recommendation, confidence and comment.\n\nItems:\n")
STRICTER = "\n\nThe previous answer was not a valid JSON array. Send only the JSON array."

Scorer = Callable[[str], str]


def needs_triage_column() -> Column:
    """Whether a row is neither rated nor a duplicate; never null."""
    return F.coalesce(unset(F.col("recommendation")) & ~is_true(F.col("is_duplicate")), F.lit(False))


def needs_triage(df: DataFrame) -> DataFrame:
    return ensure_columns(df, ["recommendation", "is_duplicate"]).where(needs_triage_column())


def needs_no_triage(df: DataFrame) -> DataFrame:
    """All other rows: the two parts together are the inventory, row by row."""
    return ensure_columns(df, ["recommendation", "is_duplicate"]).where(~needs_triage_column())


def triage_rows(df: DataFrame, size: int = fixed.DEFAULT_BATCH_SIZE) -> DataFrame:
    """Rows to rate with batch_id and batch_pos; directories precede their files."""
    return number_batches(
        needs_triage(df), size, then=[paths.depth(F.col("path")), F.col("path")])


def triage_batches(df: DataFrame, size: int = fixed.DEFAULT_BATCH_SIZE) -> DataFrame:
    """(drive_id, batch_id, n_rows, items) with the items as JSON text."""
    return assemble(triage_rows(df, size), ITEM_FIELDS)


def with_prompt(batches: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    return batches.withColumn("prompt", F.concat(F.lit(instructions), F.col("items")))


def triage_answer(scorer: Scorer) -> Callable[[str], tuple[str | None, str | None]]:
    """One prompt with one stricter retry after an error or an unusable reply: (reply, error)."""
    def answer(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for text in (prompt, prompt + STRICTER):
            try:
                reply = normalised(scorer(text), REPLY_KEYS)
                if reply is not None:
                    return reply, None
                error = "unusable reply"
            except Exception as e:  # any failure of the caller's model counts
                error = str(e)
        return None, error
    return answer


def parse_replies(replies: DataFrame) -> DataFrame:
    """Add `parsed` (items as maps, null for a failed batch)."""
    return replies.withColumn("parsed", parse_items(F.col("reply"), REPLY_KEYS))


def reply_items(parsed: DataFrame) -> DataFrame:
    """One row per rated path and batch; the last item for a path counts."""
    items = parsed.where(F.col("parsed").isNotNull()).select(
        "drive_id", "batch_id", F.posexplode("parsed").alias("_pos", "_item"))
    return items.groupBy(
        "drive_id", "batch_id", F.col("_item")["path"].alias("path")
    ).agg(F.max_by("_item", "_pos").alias("_item")).select(
        "drive_id", "batch_id", "path",
        F.struct(*[F.col("_item")[k].alias(k) for k in REPLY_KEYS[1:]]).alias("_rated"),
    )


def apply_replies(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Write ratings into the batch rows (from triage_rows).

    A failed or missing batch and a row the reply does not name fall back to
    REVIEW / 0.5. `recommendation_valid` tells whether the rating is one of the
    three known ones with a confidence from 0 to 1.
    """
    rows = ensure_columns(rows, ["confidence", "comment"])
    parsed = parse_replies(replies)
    # Batch rows are at most `size` per key, so no key of these joins is heavy.
    good = parsed.where(F.col("parsed").isNotNull()).select(
        "drive_id", "batch_id", F.lit(True).alias("_good"))
    joined = rows.join(good, ["drive_id", "batch_id"], "left").join(
        reply_items(parsed), ["drive_id", "batch_id", "path"], "left")
    rated = F.col("_rated").isNotNull()
    note = F.when(F.col("_good"), fixed.COMMENT_NO_RESULT).otherwise(fixed.COMMENT_BAD_REPLY)
    number = rows.schema["confidence"].dataType
    out = joined.withColumns({
        "recommendation": F.when(rated, F.col("_rated.recommendation")).otherwise("REVIEW"),
        "confidence": F.when(rated, F.col("_rated.confidence")).otherwise("0.5").try_cast(number),
        "comment": F.when(rated, F.col("_rated.comment")).otherwise(note),
    })
    known = F.col("recommendation").isin(RATINGS)
    sure = F.col("confidence").try_cast("double").between(0.0, 1.0)
    return out.withColumn(
        "recommendation_valid", F.coalesce(known & sure, F.lit(False))
    ).select(*rows.columns, "recommendation_valid")


def rule_ratings(df: DataFrame) -> DataFrame:
    """A deterministic scorer without a model: (recommendation, confidence, comment)."""
    names = paths.parts(F.col("path"))
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    ext = F.lower(F.coalesce(F.col("extension"), F.lit("")))
    size = F.coalesce(F.col("size_bytes").try_cast("long"), F.lit(0))
    in_user_dir = F.exists(names, lambda n: F.lower(n).isin(fixed.RULE_USER_DIRS))
    in_system = F.exists(names, lambda n: n.isin(fixed.RULE_SYSTEM_DIRS))
    rule = _first_rule([
        (in_system, "SKIP", 0.99, "system directory"),
        (~is_dir & ext.isin(fixed.RULE_PROGRAMS), "SKIP", 0.9, "program file"),
        (~is_dir & ext.isin(fixed.RULE_DOCUMENTS) & in_user_dir, "INTERESTING", 0.8,
         "document in a user directory"),
        (~is_dir & ext.isin(fixed.RULE_IMAGES), "REVIEW", 0.6, "picture"),
        (~is_dir & (size < fixed.RULE_SMALL_BYTES), "SKIP", 0.7, "very small file"),
    ])
    df = ensure_columns(df, ["recommendation", "confidence", "comment"])
    number = df.schema["confidence"].dataType
    return df.withColumn("_rule", rule).withColumns({
        "recommendation": F.col("_rule.recommendation"),
        "confidence": F.col("_rule.confidence").cast(number),
        "comment": F.col("_rule.comment"),
    }).drop("_rule")


def _first_rule(rules: list[tuple[Column, str, float, str]]) -> Column:
    def result(rating: str, confidence: float, comment: str) -> Column:
        return F.struct(
            F.lit(rating).alias("recommendation"), F.lit(confidence).alias("confidence"),
            F.lit(comment).alias("comment"))

    chain = None
    for condition, *values in rules:
        step = F if chain is None else chain
        chain = step.when(condition, result(*values))
    return chain.otherwise(result("REVIEW", 0.5, "no rule applies"))
