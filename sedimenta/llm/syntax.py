"""Source files that aren't valid in the language they claim, by packrat parsing."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.grammars import GRAMMARS

_MARKER = re.compile(r"(?:<{7}|\|{7}|={7}|>{7})(?: |\r?$)")
DEPTH = 200_000  # frames, some of which a level of nesting takes; sources nested beyond that count as invalid
RESULT = "project string, rel_path string, language string, valid boolean, line int, col int, cause string"


class Checker:
    """Parses a source by its language's grammar; made once per process, as compiling a grammar takes time."""

    def __init__(self):
        self._ready: dict[str, tuple] = {}
        self._slow: dict = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))  # the parser's frames lie on the heap

    def _of(self, language: str):
        if language not in self._ready:
            grammar, lexer = GRAMMARS[language]
            self._ready[language] = (lexer(), grammar.parser())
        return self._ready[language]

    def _unfused(self, language: str):
        """The parser that finds the furthest failure; only invalid sources need it."""
        if language not in self._slow:
            self._slow[language] = GRAMMARS[language][0].parser(fused=False)
        return self._slow[language]

    def accepts(self, text: str, language: str) -> bool:
        lexer, parse = self._of(language)
        return parse(*lexer(text)) == -1

    def __call__(self, text: str, language: str) -> tuple[bool, int | None, int | None, str | None]:
        """valid, and for an invalid source line, column and cause of the furthest failure."""
        try:
            if self.accepts(text, language):
                return True, None, None, None
            lexer = self._of(language)[0]
            tokens, ends = lexer(text)
            at = lexer.offset(text, self._unfused(language)(tokens, ends))
        except RecursionError:
            return False, None, None, "too deeply nested"
        line = text.count("\n", 0, at) + 1
        start = text.rfind("\n", 0, at) + 1
        return False, line, at - start + 1, self._cause(text, language, at, start)

    def _cause(self, text: str, language: str, at: int, start: int) -> str:
        if any(_MARKER.match(x) for x in text[max(0, start - 1) : start + 400].lstrip("\n").split("\n")[:1]):
            return "merge conflict"
        if not text[at:].strip():
            return "truncated"
        if text.lstrip()[:1] in ("{", "[") and language != "json" and self.accepts(text, "json"):
            return "written in json"
        for other in GRAMMARS:
            if other != language and other not in ("json", "shell") and self.accepts(text, other):
                return f"written in {other}"
        if text.startswith("#!") and language != "shell" and self.accepts(text, "shell"):
            return "written in shell"
        if re.match(r"\s*<(?:!doctype|html|\?xml)", text, re.I):
            return "markup"
        return "merge conflict" if any(_MARKER.match(x) for x in text.split("\n")) else "syntax"


_CHECKER: list[Checker] = []


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if not _CHECKER:
        _CHECKER.append(Checker())
    for b in batches:
        found = [_CHECKER[0](text, language) for text, language in zip(b["text"], b["language"], strict=True)]
        out = b[["project", "rel_path", "language"]].reset_index(drop=True)
        out["valid"] = [f[0] for f in found]
        out["line"] = pd.array([f[1] for f in found], dtype="Int32")
        out["col"] = pd.array([f[2] for f in found], dtype="Int32")
        out["cause"] = [f[3] for f in found]
        yield out


def check_syntax(files: DataFrame) -> DataFrame:
    """For each file (project, rel_path, language, text; other columns are ignored) of a language with a grammar whether it is valid, and
    line, col and cause of the furthest failure. Files of other or no language don't appear; null text counts as empty. An empty file is
    valid in all languages but json and go; byte order marks are accepted."""
    known = files.where(F.col("language").isin(*GRAMMARS)).select("project", "rel_path", "language", F.coalesce("text", F.lit("")).alias("text"))
    return known.mapInPandas(_check, RESULT)


def syntax_rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their rate by project and language, with the totals of each project, language and of all (nulls)."""
    return checked.rollup("project", "language").agg(
        F.count("*").alias("files"), F.count(F.when(~F.col("valid"), 1)).alias("invalid"), F.round(F.avg(F.when(F.col("valid"), 0.0).otherwise(1.0)), 6).alias("rate")
    )
