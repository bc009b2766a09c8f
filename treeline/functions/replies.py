"""Reading the JSON arrays that models send back."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.fixed_values import FENCE_CLOSE, FENCE_OPEN
from treeline.functions.values import strip

_ITEMS = "array<array<map<string,string>>>"
_FENCES = re.compile(f"{FENCE_OPEN}|{FENCE_CLOSE}", re.IGNORECASE)


def unfenced(text: Column) -> Column:
    """The reply without Markdown code fences and surrounding white space."""
    opened = F.regexp_replace(strip(text), "(?i)" + FENCE_OPEN, "")
    return strip(F.regexp_replace(strip(opened), FENCE_CLOSE, ""))


def parse_items(text: Column, required: list[str]) -> Column:
    """Items of a reply as maps, or null when the reply is not usable as a whole.

    Usable means: exactly one JSON array of objects, each with all required keys
    (a key with a null value counts). The reply is read as the only element of an
    outer array, which makes text behind the array a syntax error.
    """
    body = unfenced(text)
    outer = F.from_json(F.concat(F.lit("["), body, F.lit("]")), _ITEMS, {"mode": "PERMISSIVE"})
    closed = F.startswith(body, F.lit("[")) & F.endswith(body, F.lit("]"))
    items = F.when(closed & (F.size(outer) == 1), F.element_at(outer, 1))
    complete = F.forall(items, lambda m: F.coalesce(
        m.isNotNull() & _has_all(m, required), F.lit(False)))
    return F.when(complete, items)


def _has_all(item: Column, required: list[str]) -> Column:
    ok = F.lit(True)
    for key in required:
        ok = ok & F.map_contains_key(item, key)
    return ok


def _refused(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def normalised(text: str, required: list[str]) -> str | None:
    """A usable reply as plain JSON text, else null; for the worker that asks.

    What the worker hands on is written anew from what it has parsed, so `parse_items` reads the
    same items from it: of two values of one key the last, no NaN or Infinity, numbers as they were written.
    """
    body = _FENCES.sub("", text.strip()).strip()
    try:
        items = json.loads(body, parse_constant=_refused, parse_float=str, parse_int=str)
    except ValueError:
        return None
    whole = isinstance(items, list) and all(isinstance(i, dict) and i.keys() >= set(required) for i in items)
    return json.dumps(items) if whole else None
