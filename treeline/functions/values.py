"""Blank tests, trimmed comparison and number parsing for text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.fixed_values import NULL_TOKENS, WHITESPACE


def strip(c: Column) -> Column:
    """Remove white space on both ends, tabs and Unicode spaces included."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def unset(c: Column) -> Column:
    """Null or empty; a value of only spaces counts as set."""
    return c.isNull() | (c == "")


def upper_value(c: Column) -> Column:
    return F.upper(strip(c))


def lower_value(c: Column) -> Column:
    return F.lower(strip(c))


def is_true(c: Column) -> Column:
    """Text flag to boolean: "true" in any case, everything else false."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def null_if_token(c: Column) -> Column:
    """Spreadsheet spellings of "no value" become null."""
    return F.when(~c.isin(NULL_TOKENS), c)


def digits_to_long(c: Column) -> Column:
    """The number in a text of digits only, else null."""
    text = c.cast("string")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def bytes_to_gb(c: Column) -> Column:
    return F.round(c / F.lit(float(1024 ** 3)), 2)


def in_values(c: Column, values: list[str]) -> Column:
    """Trimmed, case-insensitive membership; null is not a member."""
    return F.coalesce(upper_value(c).isin([v.upper() for v in values]), F.lit(False))
