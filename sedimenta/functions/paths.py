"""Column functions on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forward_slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def clean(path: Column) -> Column:
    """With forward slashes and without leading ``./``."""
    return F.regexp_replace(forward_slashes(path), r"^(?:\./)+", "")


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """The folder of a path, the empty string at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(base(path), r"^.+?(\.[^.]+)$", 1))


def normalized(path: Column) -> Column:
    """Without ``.`` and empty parts; ``..`` takes the part before it, beyond the top it stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def prefixes(path: Column) -> Column:
    """All folders above a path, the nearest last; the top is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def looks_like_path(text: Column) -> Column:
    """Whether a target names a file: it holds a slash or ends with a dot and one to five letters."""
    return text.rlike(r"[/\\]|\.[A-Za-z]{1,5}$")


def matches_hint(path: Column, hint: Column) -> Column:
    return (path == hint) | F.endswith(path, F.concat(F.lit("/"), hint))


def without_extension(path: Column) -> Column:
    """Without the extension of the last part, if it has one beside its name; of declaration files both go."""
    return F.regexp_replace(path, r"(?<=[^/])(?:\.d)?\.[A-Za-z0-9]{1,5}$", "")
