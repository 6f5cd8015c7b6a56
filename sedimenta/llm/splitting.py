"""Splits oversized texts at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a text may be cut, the best kind first: before a section (a heading, or an unindented line after an empty one), after empty
# lines, after a line, after a sentence, after white space.
_KINDS = (
    re.compile(r"\n(?=#{1,6} )|\n[ \t\r]*\n(?=[^\s)}\]])"),
    re.compile(r"\n(?:[ \t\r]*\n)+"),
    re.compile(r"\n"),
    re.compile(r"[.!?;]+[\"')\]]*\s+|[。！？；]+"),
    re.compile(r"\s+|[,，、]"),
)


def segments(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive intervals of at most `most` characters: an interval that is longer is split by the next kind of boundary."""
    stack = [(0, len(text), 0)]
    while stack:
        lo, hi, kind = stack.pop()
        if hi - lo <= most:
            yield lo, hi
        elif kind < len(_KINDS):
            cuts = [lo, *sorted({m.end() for m in _KINDS[kind].finditer(text, lo, hi)} - {lo, hi}), hi]
            stack.extend((a, b, kind + 1) for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True))
        else:
            at = lo
            while at < hi:
                end = min(at + most, hi)
                if end < hi and end - at > 1 and text[end - 1] == "\r" and text[end] == "\n":
                    end -= 1
                yield at, end
                at = end


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Intervals of the pieces of a text: each at most limit characters; all but the first begin with up to overlap characters of the end
    of the piece before, from the start of a line or word if there is one in the later half of them. Together they cover the text."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than limit")
    if len(text) <= limit:
        return [(0, len(text))]
    pieces: list[tuple[int, int]] = []
    start = end = 0
    for lo, hi in segments(text, limit - overlap):
        if hi - start > limit:
            pieces.append((start, end))
            start = _overlap_from(text, max(start + 1, end - overlap), end)
        end = hi
    pieces.append((start, end))
    return pieces


def _overlap_from(text: str, lo: int, end: int) -> int:
    """The place from lo to the middle between lo and end where a line, else a word, begins; else lo."""
    middle = lo + (end - lo) // 2
    for kind in (r"\n", r"\s+"):
        m = re.compile(kind).search(text, max(0, lo - 1), middle)
        if m and lo <= m.end() <= middle:
            return m.end()
    return lo + (0 < lo < end and text[lo - 1] == "\r" and text[lo] == "\n")


def split_oversized(chunks: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """The pieces that replace the contents of chunks that are longer than limit code points.

    chunks: chunk_id, content, start_line; other columns are ignored. Returns chunk_id, piece_no (from 0), content, start_line, end_line,
    start_char (offset in the content). Rows with null content or of at most limit characters give no pieces; a null start_line counts
    as 1. Repeated rows give repeated pieces: drop duplicates of chunk_id before, if they may occur. A map without shuffle.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for chunk_id, text, first in zip(b["chunk_id"], b["content"], b["start_line"], strict=True):
                breaks = [m.start() for m in re.finditer("\n", text)]
                for i, (lo, hi) in enumerate(split_text(text, limit, overlap)):
                    rows.append((chunk_id, i, text[lo:hi], first + bisect_left(breaks, lo), first + bisect_left(breaks, max(lo, hi - 1)), lo))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "content", "start_line", "end_line", "start_char"])

    long = chunks.where(F.length("content") > limit).select("chunk_id", "content", F.coalesce("start_line", F.lit(1)).alias("start_line"))
    return long.mapInPandas(go, "chunk_id string, piece_no int, content string, start_line int, end_line int, start_char int")
