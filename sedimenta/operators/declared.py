"""Symbols that sources declare: exactly for python, by declaration patterns and braces or indentation for other languages."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"([A-Za-z_$][\w$]*)"
# Per language pattern and kind of declarations.
_PATTERNS: dict[str, list[tuple[str, str]]] = {
    "javascript": [(rf"\s*(?:export\s+)?(?:default\s+)?class\s+{_NAME}", "class"), (rf"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}", "function"), (rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", "function"),
                   (rf"\s+(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+)*(?!if|for|while|switch|catch|return|function){_NAME}\s*\([^)]*\)\s*(?::[^{{]+)?\{{", "method"), (rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}\b", "variable")],
    "go": [(rf"func\s+\([^)]*\)\s*{_NAME}", "method"), (rf"func\s+{_NAME}", "function"), (rf"type\s+{_NAME}\s+struct", "struct"), (rf"type\s+{_NAME}\s+interface", "interface"), (rf"type\s+{_NAME}", "type"), (rf"(?:var|const)\s+{_NAME}", "variable")],
    "java": [(rf"\s*(?:@\w+\s+)*(?:public|protected|private|static|final|abstract|sealed|\s)*class\s+{_NAME}", "class"), (rf"\s*(?:public|protected|private|static|\s)*interface\s+{_NAME}", "interface"), (rf"\s*(?:public|protected|private|static|\s)*enum\s+{_NAME}", "enum"),
             (rf"\s+(?:public|protected|private|static|final|abstract|synchronized|\s)*(?:<[^>]+>\s+)?[\w<>\[\], .?]+\s+(?!if|for|while|switch|catch|return|new){_NAME}\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\{{", "method")],
    "rust": [(rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_NAME}", "function"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+{_NAME}", "struct"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}", "enum"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}", "trait"),
             (rf"\s*(?:pub(?:\([^)]*\))?\s+)?type\s+{_NAME}", "type"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?{_NAME}\s*:", "variable")],
    "shell": [(rf"\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)", "function")],
    "ruby": [(rf"\s*class\s+{_NAME}", "class"), (rf"\s*module\s+{_NAME}", "module"), (r"\s*def\s+(?:self\.)?([\w?!=]+)", "method")],
    "php": [(rf"\s*(?:abstract\s+|final\s+)*class\s+{_NAME}", "class"), (rf"\s*interface\s+{_NAME}", "interface"), (rf"\s*trait\s+{_NAME}", "trait"), (rf"\s*(?:public|protected|private|static|\s)*function\s+&?{_NAME}", "function")],
    "csharp": [(rf"\s*(?:public|internal|private|protected|static|sealed|abstract|partial|\s)*(?:class|struct|record)\s+{_NAME}", "class"), (rf"\s*(?:public|internal|\s)*interface\s+{_NAME}", "interface"), (rf"\s+(?:public|internal|private|protected|static|async|override|virtual|\s)+[\w<>\[\],?. ]+\s+{_NAME}\s*\([^)]*\)", "method")],
    "c": [(rf"(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w ]*[\s*]+{_NAME}\s*\([^;]*$", "function"), (rf"(?:typedef\s+)?struct\s+{_NAME}", "struct")],
    "swift": [(rf"\s*(?:public\s+|private\s+|final\s+|open\s+)*(?:class|struct|actor)\s+{_NAME}", "class"), (rf"\s*(?:public\s+)?protocol\s+{_NAME}", "interface"), (rf"\s*(?:public\s+)?enum\s+{_NAME}", "enum"), (rf"\s*(?:\w+\s+)*func\s+{_NAME}", "function")],
    "kotlin": [(rf"\s*(?:\w+\s+)*(?:class|object)\s+{_NAME}", "class"), (rf"\s*(?:\w+\s+)*interface\s+{_NAME}", "interface"), (rf"\s*(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?{_NAME}", "function")],
    "lua": [(r"\s*(?:local\s+)?function\s+([\w.:]+)", "function"), (r"\s*([\w.:]+)\s*=\s*function\b", "function")],
    "dart": [(rf"\s*(?:abstract\s+)?class\s+{_NAME}", "class"), (rf"\s*enum\s+{_NAME}", "enum"), (rf"\s*(?:static\s+)?[\w<>?]+\s+{_NAME}\s*\([^)]*\)\s*(?:async\s*)?(?:\{{|=>)", "function")],
    "elixir": [(r"\s*defmodule\s+([\w.]+)", "module"), (r"\s*defp?\s+([\w?!]+)", "function")],
    "gdscript": [(rf"class_name\s+{_NAME}", "class"), (rf"\s*class\s+{_NAME}", "class"), (rf"\s*(?:static\s+)?func\s+{_NAME}", "function"), (rf"signal\s+{_NAME}", "signal"), (rf"enum\s+{_NAME}", "enum"), (rf"const\s+{_NAME}", "constant"), (rf"(?:@\w+\s+)*var\s+{_NAME}", "variable")],
}
_PATTERNS["typescript"] = [(rf"\s*(?:export\s+)?(?:declare\s+)?interface\s+{_NAME}", "interface"), (rf"\s*(?:export\s+)?(?:declare\s+)?type\s+{_NAME}", "type"), (rf"\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}", "enum"), (rf"\s*(?:export\s+)?(?:default\s+)?abstract\s+class\s+{_NAME}", "class"), *_PATTERNS["javascript"]]
_PATTERNS["cpp"] = [(rf"\s*class\s+{_NAME}", "class"), (rf"[\w:<>*& ]+\s+\w+::{_NAME}\s*\(", "method"), *_PATTERNS["c"]]
_PATTERNS["scala"] = _PATTERNS["kotlin"] + [(rf"\s*(?:\w+\s+)*def\s+{_NAME}", "function"), (rf"\s*(?:\w+\s+)*trait\s+{_NAME}", "trait")]
_INDENTED = ("ruby", "elixir", "lua", "gdscript")
_OWNERS = ("class", "interface", "struct", "trait", "enum", "module")


def python_symbols(text: str) -> list[tuple[str, str, str, int, int]] | None:
    """name, qualified name, kind, line, end line; None if the source doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    stack = [(tree, "", False)]
    while stack:
        node, owner, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{owner}.{child.name}" if owner else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "constructor" if in_class and child.name == "__init__" else "method" if in_class else "function"
                out.append((child.name, name, kind, child.lineno, child.end_lineno or child.lineno))
                stack.append((child, name, kind == "class"))
            else:
                stack.append((child, owner, in_class))
    return sorted(out, key=lambda x: (x[3], x[1]))


def pattern_symbols(text: str, language: str) -> list[tuple[str, str, str, int, int]]:
    rules = [(re.compile(p), k) for p, k in _PATTERNS.get(language, [])]
    lines = text.split("\n")
    out: list[tuple[str, str, str, int, int]] = []
    owners: list[tuple[str, int, int]] = []
    for i, line in enumerate(lines, 1):
        for rule, kind in rules:
            m = rule.match(line)
            if not m:
                continue
            end = _end(lines, i - 1, language)
            while owners and owners[-1][1] < i:
                owners.pop()
            name = m.group(1)
            full = f"{owners[-1][0]}.{name}" if owners else name
            kind = "method" if kind == "function" and owners else kind
            out.append((name, full, kind, i, end))
            if kind in _OWNERS:
                owners.append((full, end, i))
            break
    return out


def _end(lines: list[str], at: int, language: str) -> int:
    """The last line of a declaration: where its braces close, or the next line of its indentation."""
    first = lines[at]
    indent = len(first) - len(first.lstrip())
    if language in _INDENTED:
        for j in range(at + 1, len(lines)):
            if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                return j + 1 if lines[j].strip() == "end" else j
        return len(lines)
    depth, opened = 0, False
    for j in range(at, len(lines)):
        code = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*", "", lines[j])
        depth += code.count("{") - code.count("}")
        opened = opened or "{" in code
        if (opened and depth <= 0) or (not opened and (code.rstrip().endswith(";") or j > at + 3)):
            return j + 1 if opened or code.rstrip().endswith(";") else at + 1
    return len(lines)


def declared_symbols(files: DataFrame) -> DataFrame:
    """project, file, language, name, qualified_name, kind, line, end_line of files (project, rel_path, language, content).

    Every file has a ``<module>`` symbol over all its lines, also where nothing else is found or a source doesn't parse. Null content
    counts as empty.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, language, text in b.itertuples(index=False):
                found = python_symbols(text) if language == "python" else pattern_symbols(text, language or "")
                rows += [(project, path, language, *x) for x in [("<module>", "<module>", "module", 1, text.count("\n") + 1), *(found or [])]]
            yield pd.DataFrame(rows, columns=["project", "file", "language", "name", "qualified_name", "kind", "line", "end_line"])

    rows = files.select("project", "rel_path", "language", F.coalesce("content", F.lit("")).alias("content"))
    return rows.mapInPandas(go, "project string, file string, language string, name string, qualified_name string, kind string, line int, end_line int")
