"""Column functions on texts, hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 8192


def lines(text: Column) -> Column:
    """Lines of a text; an empty text has one, a final line end opens another."""
    return F.split(text, "\n", -1)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def uuid_from(text: Column) -> Column:
    """The first 32 hex digits of a text's SHA-256 in UUID form."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def chunk_id(path: Column, start: Column) -> Column:
    return uuid_from(F.concat_ws(":", path, start.cast("string")))


def continuation_id(parent: Column, part: Column) -> Column:
    return uuid_from(F.concat(parent, F.lit("\x00"), part.cast("string")))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: t != "")


def document_text(path: Column, content: Column, prefix: str = "", with_path: bool = True) -> Column:
    """What is embedded and indexed for a chunk: an optional prefix, its path on a line of its own, its content."""
    return F.concat(F.lit(prefix), *([path, F.lit("\n")] if with_path else []), content)


def has_text(text: Column) -> Column:
    """Whether anything but white space is there."""
    return text.rlike(r"\S")


def is_binary(text: Column) -> Column:
    """Whether a NUL stands in the head."""
    return F.instr(F.substring(text, 1, HEAD_BYTES), "\x00") > 0


def branch_suffix(branch: Column) -> Column:
    """A branch name as part of an identifier: other characters than letters, digits, dot, dash become one underscore, ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(branch, r"[^A-Za-z0-9.-]+", "_"), r"^_+|_+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def version_key(version: Column) -> Column:
    """A sortable key of a semantic version: numbers by value, a pre-release before its release; null if it isn't one."""
    pattern = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    number = lambda i: F.lpad(F.regexp_extract(version, pattern, i), 9, "0")
    pre = F.regexp_extract(version, pattern, 4)
    return F.when(version.rlike(pattern), F.concat_ws(".", number(1), number(2), number(3), F.when(pre == "", F.lit("~")).otherwise(pre)))
