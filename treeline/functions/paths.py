r"""Windows path rules as Column expressions.

Both separators are accepted, repeated separators and "." parts vanish, ".." stays,
and two paths are the same when their normal forms match in any letter case. The
root of a path is its drive (or share) with or without the separator after it.

Every step refers to its input once, or binds it to a lambda variable: a path is
often itself a computed column, and repeating it would multiply the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\\"
_ROOT = r"\\\\[^\\]+\\[^\\]+\\|[A-Za-z]:\\?|\\"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalize(path: Column) -> Column:
    text = F.translate(path, "/", SEP)
    for pattern, put in [
        (r"(?<=^|\\|^[A-Za-z]:)\.(?:\\+|$)", ""),        # "." parts
        (r"(?<!^)\\{2,}", r"\\"),                          # repeated separators
        (r"(?<!^)(?<!^[A-Za-z]:)\\$", ""),                 # separator at the end
        (r"^(\\\\[^\\]+\\[^\\]+)$", r"$1\\"),              # a share is its own root
        (r"^$", "."),
    ]:
        text = F.regexp_replace(text, pattern, put)
    return text


def compare_key(path: Column) -> Column:
    """Equal for paths that name the same place."""
    return F.lower(normalize(path))


def _prefix(norm: Column) -> Column:
    return F.regexp_extract(norm, f"^({_ROOT})?", 1)


def _parts(norm: Column) -> Column:
    names = F.split(F.regexp_replace(norm, f"^(?:{_ROOT})", ""), r"\\")
    return F.filter(names, lambda x: (x != "") & (x != "."))


def _ups(norm: Column) -> Column:
    """Number of directories above, the root left out."""
    n = F.size(_parts(norm))
    return F.greatest(n - 1, F.lit(0)) + F.when(
        (n > 0) & (_prefix(norm) == ""), 1).otherwise(0)


def _up(norm: Column, distance: Column) -> Column:
    """`distance` steps up, for a distance from 1 to the number of directories above."""
    separators = F.length(norm) - F.length(F.translate(norm, SEP, ""))
    return F.when(distance > separators, ".").otherwise(
        F.call_function("substring_index", norm, F.lit(SEP), separators + 1 - distance))


def _above(norm: Column) -> Column:
    return _let(_ups(norm), lambda n: F.when(
        n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: _up(norm, i))
    ).otherwise(F.array().cast("array<string>")))


def prefix(path: Column) -> Column:
    """Everything before the first part: drive plus separator when rooted."""
    return _prefix(normalize(path))


def drive(path: Column) -> Column:
    """Drive letter with colon, UNC share, or an empty text."""
    return F.regexp_extract(normalize(path), r"^(\\\\[^\\]+\\[^\\]+|[A-Za-z]:)", 1)


def parts(path: Column) -> Column:
    """The names below the root, outermost first."""
    return _parts(normalize(path))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, without the root."""
    return _let(normalize(path), _above)


def ancestor_keys(path: Column) -> Column:
    return _let(compare_key(path), _above)


def self_and_ancestor_keys(path: Column) -> Column:
    return _let(compare_key(path), lambda p: F.concat(F.array(p), _above(p)))


def self_and_ancestors(path: Column) -> Column:
    return _let(normalize(path), lambda p: F.concat(F.array(p), _above(p)))


def ancestor_at(path: Column, distance: Column) -> Column:
    """The directory `distance` steps up, spelled as in the path itself."""
    return _let(normalize(path), lambda p: F.when(
        (distance >= 1) & (distance <= _ups(p)), _up(p, distance)))


def parent(path: Column) -> Column:
    """The directory that holds the path; null directly below the root."""
    return ancestor_at(path, F.lit(1))


def parent_key(path: Column) -> Column:
    return F.lower(parent(path))


def is_root(path: Column) -> Column:
    return F.size(parts(path)) == 0


def base_name(path: Column) -> Column:
    return F.regexp_extract(normalize(path), r"^(?!\.$)(?:[A-Za-z]:)?(?:.*\\)?([^\\]*)$", 1)


def depth(path: Column) -> Column:
    return F.size(parts(path)).cast("long")


def separator_count(path: Column) -> Column:
    return (F.length(path) - F.length(F.translate(path, SEP, ""))).cast("long")


def drive_letter(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.:)", 1)


def extension(name: Column) -> Column:
    """Lower-case text from the last dot on; leading dots do not count."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def join_path(directory: Column, name: Column) -> Column:
    return normalize(F.concat(directory, F.lit(SEP), name))


def stem(name: Column) -> Column:
    """Last part of a file location without its extension."""
    last = F.regexp_extract(name, r"([^/\\]*)[/\\]?$", 1)
    return F.regexp_replace(last, r"(?<=[^.])\.[^.]*$", "")
