"""The inventory row and its canonical types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.values import null_if_token

INVENTORY = T.StructType([
    T.StructField("drive_id", T.StringType()),
    T.StructField("row_seq", T.LongType()),
    T.StructField("path", T.StringType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("modified", T.TimestampNTZType()),
    T.StructField("md5_hash", T.StringType()),
    T.StructField("is_duplicate", T.BooleanType()),
    T.StructField("duplicate_kind", T.StringType()),
    T.StructField("duplicate_source_path", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("comment", T.StringType()),
    T.StructField("review", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("pdf_complexity", T.StringType()),
    T.StructField("organized_path", T.StringType()),
    T.StructField("copy_status", T.StringType()),
    T.StructField("delete_status", T.StringType()),
])

REGISTRY = T.StructType([
    T.StructField("md5_hash", T.StringType()),
    T.StructField("original_path", T.StringType()),
    T.StructField("organized_path", T.StringType()),
    T.StructField("drive", T.StringType()),
    T.StructField("date_copied", T.StringType()),
])

MANIFEST_COLUMNS = ["path", "filename", "size_bytes", "decision_source"]

REPORT_COLUMNS = [
    "source_csv", "path", "filename", "size_bytes", "md5_hash",
    "duplicate_source_path", "recommendation", "decision", "comment",
]


def text_schema(columns: list[str] | None = None) -> T.StructType:
    """Every column as text, the form in which CSV inventories are read."""
    names = columns or [f.name for f in INVENTORY if f.name not in ("drive_id", "row_seq")]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Text columns in which a null token is never a real value.
TOKEN_COLUMNS = ("review", "decision")


def _typed(field: T.StructField, present: Column, from_csv: bool) -> Column:
    text = present.cast("string")
    is_text = field.dataType == T.StringType()
    if field.name == "path" or is_text and not (from_csv or field.name in TOKEN_COLUMNS):
        return text
    text = null_if_token(text)
    if field.dataType == T.BooleanType():
        return F.lower(text) == "true"
    if field.dataType == T.StringType():
        return text
    return text.try_cast(field.dataType)


def conform(df: DataFrame, from_csv: bool = False) -> DataFrame:
    """Inventory columns in order with canonical types; missing ones become nulls.

    Null tokens (NA, None, null) are read as nulls in CSV cells; in a stored table only
    reviews and decisions are, as a file may have such a name.

    Columns the contract does not name are kept behind them. Numbers and times
    that cannot be read become null.
    """
    known = {f.name for f in INVENTORY}
    columns = []
    for field in INVENTORY:
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif df.schema[field.name].dataType == field.dataType and field.dataType != T.StringType():
            columns.append(F.col(field.name))
        else:
            columns.append(_typed(field, F.col(field.name), from_csv).alias(field.name))
    # Path comparisons run within a drive, so its name is never null.
    columns[0] = F.coalesce(columns[0], F.lit("")).alias("drive_id")
    return df.select(*columns, *[c for c in df.columns if c not in known])


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the named text columns a phase writes when the input lacks them."""
    missing = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df
