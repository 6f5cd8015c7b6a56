"""Cuts files into chunks of lines, of declarations or of characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import text as T

WINDOW_LINES, OVERLAP_LINES, MINIFIED_WIDTH, MAX_CHARS = 100, 10, 500, 2000


def strategy(content: Column, lines: int = WINDOW_LINES, width: int = MINIFIED_WIDTH) -> Column:
    """How a file is cut: by characters where lines are very wide, as a whole if short, else by declarations or line windows."""
    n = F.size(T.lines(content))
    return F.when(F.length(content) / n > width, "characters").when(n <= lines, "whole").otherwise("windows")


def line_windows(files: DataFrame, text_col: str = "content", size: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Adds window_no, start_line, end_line and chunk for each window of a file's lines; the last window is the first to reach the end.
    White-space-only and null texts give no rows."""
    step = size - overlap
    n = F.size("_lines")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    cut = files.withColumn("_lines", T.lines(F.col(text_col))).where(F.col(text_col).isNotNull())
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    start = F.col("window_no") * step
    chunk = F.array_join(F.slice("_lines", start + 1, F.lit(size)), "\n")
    out = cut.withColumns({"start_line": start + 1, "end_line": F.least(start + size, n), "chunk": chunk}).drop("_lines")
    return out.where(T.has_text(F.col("chunk")))


def merge_regions(regions: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Unites intervals that overlap or touch, within keys. start is inclusive, end exclusive."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.coalesce(reach, F.lit(-1)) < F.col(start)).cast("int")
    numbered = regions.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def split_chars(text: str, most: int, boundaries: str) -> list[str]:
    """Pieces of at most `most` characters, each cut after the last boundary character if there is one beyond the first character;
    never inside a line end of two characters. Together they are the text."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        cut = next((i + 1 for i in range(end - 1, at, -1) if text[i] in boundaries), end)
        if cut < len(text) and text[cut - 1] == "\r" and text[cut] == "\n":
            cut = cut + 1 if cut - at < most else cut - 1 if cut - at > 1 else cut + 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def capped(chunks: DataFrame, id_col: str, text_col: str, most: int = MAX_CHARS, boundaries: str = "\n") -> DataFrame:
    """The pieces of each chunk: id, part (from 0), piece, first_line and last_line relative to the chunk. Null texts give none."""
    kind = chunks.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"], strict=True):
                line = 0
                for part, piece in enumerate(split_chars(text, most, boundaries)):
                    breaks = piece.count("\n")
                    rows.append((i, part, piece, line, line + breaks - (piece.endswith("\n") and breaks > 0)))
                    line += breaks
            yield pd.DataFrame(rows, columns=["id", "part", "piece", "first_line", "last_line"])

    rows = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(go, f"id {kind}, part int, piece string, first_line int, last_line int")


# How a top-level declaration begins.
_DECLARATION = {
    "python": r"(?:async )?(?:def|class) ", "javascript": r"(?:export )?(?:default )?(?:async )?(?:function|class) ", "typescript": r"(?:export )?(?:default )?(?:declare )?(?:abstract )?(?:async )?(?:function|class|interface|enum|type) ",
    "go": r"(?:func|type) ", "java": r"(?:public |protected |private |abstract |final )*(?:class|interface|enum|record) ", "rust": r"(?:pub(?:\([^)]*\))? )?(?:fn|struct|enum|trait|impl|mod) ", "shell": r"\w[\w-]*\s*\(\)\s*\{",
}


def declarations(files: DataFrame) -> DataFrame:
    """project, rel_path, start_line, end_line (exclusive) of the top-level declarations of files (project, rel_path, language, content):
    from a line that begins one to the next unindented line that closes or replaces it."""
    patterns = {k: re.compile(v) for k, v in _DECLARATION.items()}

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, language, text in b.itertuples(index=False):
                start = None
                lines = text.split("\n")
                for i, line in enumerate(lines, 1):
                    begins = patterns[language].match(line) is not None
                    if start is not None and (begins or re.match(r"[})\]]", line) or (language == "python" and re.match(r"[^\s#)\]}]", line))):
                        rows.append((project, path, start, i + bool(re.match(r"[})\]]", line))))
                        start = None
                    if begins and start is None:
                        start = i
                if start is not None:
                    rows.append((project, path, start, len(lines) + 1))
            yield pd.DataFrame(rows, columns=["project", "rel_path", "start_line", "end_line"])

    known = files.where(F.col("language").isin(*_DECLARATION) & F.col("content").isNotNull()).select("project", "rel_path", "language", "content")
    return known.mapInPandas(go, "project string, rel_path string, start_line int, end_line int")


SMALL_LINES, LARGE_LINES = 5, 150  # a declaration of fewer lines joins its neighbours; a longer group is cut into windows


def _windows(first: int, last: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Lines first to last (inclusive) in windows."""
    out, at = [], first
    while True:
        end = min(at + size - 1, last)
        out.append((at, end))
        if end == last:
            return out
        at += size - overlap


def region_spans(n: int, regions: list[tuple[int, int]], size: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> list[tuple[int, int]]:
    """The line spans that a file of n lines is cut into along its declarations (start, end, end exclusive; from 1).

    What stands before the first and after the last is a span of its own; lines between two declarations go with the second. A small
    declaration joins the group before it as long as that stays within a window.
    """
    groups: list[list[int]] = []
    end = regions[0][0]
    for lo, hi in regions:
        start = min(end, lo)
        if groups and hi - groups[-1][0] <= size and hi - lo < SMALL_LINES:
            groups[-1][1] = hi
        else:
            groups.append([start, hi])
        end = hi
    spans = [(1, regions[0][0] - 1)] if regions[0][0] > 1 else []
    for lo, hi in groups:
        spans += [(lo, hi - 1)] if hi - lo <= LARGE_LINES else _windows(lo, hi - 1, size, overlap)
    return spans + ([(end, n)] if end <= n else [])


def merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Regions by start, those that overlap or touch united."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(regions):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def file_spans(text: str, language: str | None) -> list[tuple[int, int, str]]:
    """start_line, end_line, content of the chunks of a text: by characters where lines are very wide, as a whole if short, along the
    declarations where the language has some, else in windows; none is longer than MAX_CHARS, and none is blank."""
    from sedimenta.operators.declared import pattern_symbols, python_symbols

    lines = text.split("\n")
    n = len(lines)
    if len(text) / n > MINIFIED_WIDTH:
        whole, boundaries = [(1, n)], "\n \t;,"
    else:
        boundaries = "\n"
        whole = [(1, n)]
        if n > WINDOW_LINES:
            found = (python_symbols(text) if language == "python" else None) or pattern_symbols(text, language or "")
            regions = merged([(s[3], s[4] + 1) for s in found if "." not in s[1] and s[2] != "variable"])
            whole = region_spans(n, regions) if regions else _windows(1, n, WINDOW_LINES, OVERLAP_LINES)
    out = []
    for lo, hi in whole:
        line = lo
        for piece in split_chars("\n".join(lines[lo - 1 : hi]), MAX_CHARS, boundaries):
            breaks = piece.count("\n")
            if piece.strip():
                out.append((line, min(hi, line + breaks - (piece.endswith("\n") and breaks > 0)), piece))
            line += breaks
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """chunk_id, rel_path, language, start_line, end_line, content, content_hash of the chunks of files (rel_path, content, language). Ids
    come from path, start line and, where several chunks start in one line, their number."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, language, h in b.itertuples(index=False):
                part, last = 0, None
                for lo, hi, piece in file_spans(text, language):
                    part = part + 1 if lo == last else 0
                    last = lo
                    rows.append((path, language, lo, hi, part, piece, h))
            yield pd.DataFrame(rows, columns=["rel_path", "language", "start_line", "end_line", "part", "content", "content_hash"])

    known = files.where("content is not null").select("rel_path", "content", "language", T.content_hash(F.col("content")).alias("content_hash"))
    cut = known.mapInPandas(go, "rel_path string, language string, start_line int, end_line int, part int, content string, content_hash string")
    own = T.chunk_id(F.col("rel_path"), F.col("start_line"))
    return cut.select(F.when(F.col("part") == 0, own).otherwise(T.continuation_id(own, F.col("part"))).alias("chunk_id"), "rel_path", "language", "start_line", "end_line", "content", "content_hash")
