"""Source files that nobody wrote by hand in their repository: generated, minified, vendored or data saved as code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.near_duplicates import RunHasher
from sedimenta.plans.workspace import Workspace

GRAM, WINDOW = 8, 20
PROJECTS, SHARE = 3, 0.8

# File names, directories and banners by which tools and third-party code can be told.
_LOCK = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|composer\.lock|Gemfile\.lock|Cargo\.lock|poetry\.lock|uv\.lock|pdm\.lock|Pipfile\.lock|go\.sum|mix\.lock|pubspec\.lock|Podfile\.lock|packages\.lock\.json|flake\.lock|gradle\.lockfile|deno\.lock)$"
)
_GENERATED_NAME = re.compile(
    r"(?:^|/)[^/]*(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw|\.validate)?\.(?:go|cc|h|rs|ts|js|java)|_grpc\.pb\.go|\.g\.(?:dart|cs|ts|js)|\.designer\.cs|\.freezed\.dart|[._-]generated\.\w+|[._-]gen\.\w+|\.auto\.\w+|_autogen\.\w+|_string\.go|\.twirp\.go|zz_generated[^/]*|bindata\.go|mock_[^/]+_generated\.go|[^/]*OuterClass\.java|[^/]*Grpc\.java|_pb(?:_service)?\.(?:d\.)?(?:ts|js|mjs|rb|go))$"
    r"|(?:^|/)(?:generated|autogen|auto[-_]generated|gen|__generated__|generated[-_]sources|generated[-_]src|\.generated|_generated|codegen[-_]out(?:put)?|gen-(?:go|py|js|java|src)|auto_gen|generated[-_]code)/",
    re.I,
)
_MINIFIED_NAME = re.compile(r"\.min\.(?:js|mjs|cjs|css)$|[.-](?:bundle|chunk|packed|prod)\.(?:js|mjs|cjs)$|(?:^|/)bundle\.js$", re.I)
_VENDORED_PATH = re.compile(
    r"(?:^|/)(?:vendors?|third[-_]?party|3rd[-_]?party|node_modules|bower_components|jspm_packages|web_modules|site-packages|dist-packages|pods|carthage|godeps|externals?|contrib/vendor|extern|thirdparty[-_]libs?|_vendor|vendored|deps|elm-stuff|\.yarn|\.cargo/registry|pkg/mod)/(?:[^/]+/)*[^/]+$",
    re.I,
)
_BANNER = re.compile(
    r"^\W*(?:code\s+generated\b.*(?:do not edit|by\b).*|(?:this|the following) (?:file|code|module|class|source)\b.{0,40}\b(?:is|was|has been)\b.{0,25}\bgenerated\b.*|auto-?\s?generated\b(?!\s*:\s*(?:no|false)).*|automatically\s+(?:generated|produced|created|built|written|derived|compiled)\b.*|(?:created|produced|emitted|written|compiled)\s+(?:by|with|from)\b.*(?:codegen|code generator|generator\b|compiler\b|protoc\b|\.(?:proto|idl|xsd|graphql|thrift|avsc|wsdl|fbs)\b).*|source:\s*\S+\.(?:proto|idl|xsd|graphql|thrift|avsc|wsdl|fbs)|(?:any |all )?(?:manual |local )?(?:edits|changes|modifications)\b.{0,40}\b(?:lost|overwritten)\b.*|<auto-?generated\b.*|@generated\b(?:\s*$|\s+(?:by|from|with|signedsource|<).*)|generated\s+(?:by|from|with|using|automatically|code|file|source)\b.*"
    r"|machine[- ]generated\b.*|do not (?:edit|modify)\b.*(?:generated|overwrit|changes will)|diese datei wurde\b.*(?:erzeugt|generiert).*|(?:ce )?fichier\b.*\bg[ée]n[ée]r[ée].*|(?:este )?(?:archivo|fichero|arquivo)\b.*\b(?:generado|gerado).*|(?:этот )?файл\b.*сгенерирован.*|.*(?:自動生成|自动生成).*)\W*$",
    re.I,
)
_DISCLAIM = re.compile(r"\bnot\s+(?:auto-?)?generated|\bleft out|\bwrites? the|\bemits?\b|\bedit freely|\bskip|\bexclud|\bignore", re.I)
_COPIED = re.compile(
    r"^\W*(?:(?:copied|taken|vendored|imported|borrowed|lifted|ported|extracted|synced|mirrored)\s+(?:verbatim\s+|unchanged\s+|unmodified\s+)?(?:from|out of)\s+(?:the\s+)?[\w@./-]+.*|this file is part of\s+[\w@.-]+.*|.*\breleased under the .{2,30} licen[cs]e\b.*|upstream:\s*\S+.*|[\w@.-]+ v?\d+\.\d+(?:\.\d+)?\s*\|\s*\(c\).*|!?\s*[\w@.-]+ v?\d+\.\d+\.\d+(?:\s*\|.*|\s*-\s*.*licen[cs]e.*)|vendored copy of\b.*|third[- ]party (?:code|copy|source)\b.*)$",
    re.I,
)
_COMMENT_LINE = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|\"\"\"|''')")
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_COLLECTED = ("*/", "-->")  # ends of blocks all of whose lines are looked at; a docstring may speak of anything
_OPENER = re.compile(r"^\s*(?:<\?|<!doctype|['\"]use strict['\"]|---|package\s+[\w.]+;?\s*$|@charset)", re.I)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_NUMBERS = re.compile(r"(?=[-+\d])(?:[-+]?(?:0[xX][\da-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[a-zA-Z]?\s*,\s*){8,}")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/=_%-])(?=[^\s\"'`]*\d)(?:[A-Za-z0-9+/=_%-]|\\x[\da-fA-F]{2}){40,}")
_VALUE = r"(?:[-+]?[\d.]+[a-zA-Z]?|\"[^\"]*\"|'[^']*'|0x[\da-fA-F]+)"
_ROW = re.compile(rf"\s*[\[{{(]?\s*{_VALUE}(?:\s*,\s*{_VALUE}){{3,}}\s*,?\s*[\])}}]?\s*,?\s*")
_ENTRY = re.compile(rf"\s*(?:{_VALUE}\s*(?::|=>)\s*)?[\[({{]?\s*{_VALUE}(?:\s*,\s*{_VALUE})*\s*[\])}}]?\s*,?\s*")
_ENTRY_STARTS = frozenset("\"'[({-0123456789")
_ENTRIES = 8  # so many lines of one form in a row are a table
_TOKENS = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|[^\w\s]")
PROGRAMS = ("python", "javascript", "typescript", "go", "java", "rust", "shell")


def _header(text: str) -> list[str]:
    """The comment lines of the head, however long it is, and those among the first 20 lines, without comment marks."""
    out = []
    head, close = True, ""
    at = n = 0
    while at <= len(text) and (head or n < 20):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        at, n = end + 1, n + 1
        mark = _COMMENT_LINE.match(line)
        if mark or close and close in _COLLECTED:
            out.append(re.sub(r"^\s*(?:#+!?|//+|/\*+!?|\*+/?|<!--|--|;+|\"\"\"|''')\s?|\s*(?:\*/|-->|\"\"\"|''')\s*$", "", line).strip())
        if close:
            close = "" if close in line else close
        elif mark and head:
            opened = mark.group().strip()
            close = _BLOCKS.get(opened, "")
            if close and close in line[mark.end() :]:
                close = ""
        elif line.strip() and not _OPENER.match(line):
            head = False
    return out


def minified(text: str) -> bool:
    """Whether code without its comments and literals stands in long dense lines."""
    lines = [x for x in _STRING.sub('""', text).split("\n") if x.strip() and not _COMMENT_LINE.match(x)]
    size = sum(map(len, lines))
    if size < 200:
        return False
    dense = [x for x in lines if len(x) > 200 and sum(c.isspace() for c in x) < 0.12 * len(x)]
    return sum(map(len, dense)) > 0.6 * size


def _table_rows(lines: list[str]) -> int:
    """The size of the lines that are rows of literals: of four or more, or in a row of lines of one form with numbers."""
    size = run = 0
    form, pending = None, 0
    for line in [*lines, ""]:
        this = None
        if line.lstrip()[:1] in _ENTRY_STARTS and _ENTRY.fullmatch(line):
            bare = _STRING.sub("s", line)
            this = (bare.count(","), ":" in bare or "=>" in bare) if any(map(str.isdigit, bare)) else None
        if this is None or this != form:
            size += pending if run >= _ENTRIES else 0
            form, run, pending = this, 0, 0
        if this is not None and not _ROW.fullmatch(line):
            run += 1
            pending += len(line) + 1
        elif _ROW.fullmatch(line):
            size += len(line) + 1
    return size


def data_share(text: str) -> float:
    """The share of a text that is numbers in lists, rows of literals or encoded blobs."""
    size = len(text)
    numbers = sum(len(m.group()) for m in _NUMBERS.finditer(text))
    blobs = sum(len(m.group()) for m in _BLOB.finditer(text))
    return max(numbers, _table_rows(text.split("\n"))) / size + blobs / size if size else 0.0


def mostly_data(text: str) -> bool:
    """Whether embedded data makes up most of a program's text; one long literal among code doesn't."""
    return len(text) >= 300 and data_share(text) > 0.7


def kind_of(path: str, text: str, language: str | None) -> str | None:
    """generated, minified, vendored or data, as path or text show; None for what looks hand-written."""
    path = path.replace("\\", "/")
    if _LOCK.search(path) or _GENERATED_NAME.search(path):
        return "generated"
    head = _header(text)
    if any(_BANNER.match(x) and not _DISCLAIM.search(x) for x in head):
        return "generated"
    if _MINIFIED_NAME.search(path):
        return "minified"
    if language in ("javascript", "typescript", None) and minified(text):
        return "minified"
    if _VENDORED_PATH.search(path):
        return "vendored"
    if any(_COPIED.match(x) and not _DISCLAIM.search(x) for x in head):
        return "vendored"
    if language in PROGRAMS and mostly_data(text):
        return "data"
    return None


def winnow(text: str, hasher: RunHasher, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Winnowing fingerprints of the normalized tokens: of every window of hashes the smallest. Comments count, case and space don't;
    literals become one token each."""
    hashes = hasher.sequence(_STRING.sub('"', text).lower())
    if len(hashes) <= window:
        return np.unique(hashes[:1] if len(hashes) == 0 else hashes.min(keepdims=True))
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1))


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = RunHasher(GRAM, _TOKENS)
    for b in batches:
        rows = b[["project", "rel_path"]].reset_index(drop=True)
        rows["kind"] = [kind_of(p, t, x) for p, t, x in zip(b["rel_path"], b["text"], b["language"], strict=True)]
        rows["prints"] = [winnow(t, hasher).view(np.int64) for t in b["text"]]
        yield rows


def provenance(files: DataFrame, projects: int = PROJECTS, share: float = SHARE) -> DataFrame:
    """One row per file: project, rel_path, kind (generated, minified, vendored, data; null: hand-written), recurring.

    files: project, rel_path, language, text; other columns are ignored. recurring is the share of a file's winnowing fingerprints that
    occur in at least `projects` projects: in any folder if a file told by path or text has the fingerprint too, else each time in a
    folder of the same two names (a copy keeps its library's folder; without that, files that repositories took from one another and
    edited would count as third-party code). Fingerprints of all files count, whatever their language and whether told or not. From
    `share` on, a file that nothing else tells is a vendored copy. It is null for files told by path or text and for those without
    tokens. Fingerprints are counted per project and folder first, so a fingerprint that all files share costs no more than one row for
    each of these. Null text counts as empty, null project as one project.
    """
    ws = Workspace(files.sparkSession, "provenance")
    rows = files.select("project", "rel_path", "language", F.coalesce("text", F.lit("")).alias("text"))
    marked = ws.write(rows.mapInPandas(_marks, "project string, rel_path string, kind string, prints array<long>"), "marked")
    folder = F.regexp_extract(F.regexp_replace("rel_path", r"\\\\", "/"), r"(?:^|/)([^/]+/[^/]+)/[^/]*$", 1)
    told = F.col("kind").isNotNull().alias("told")
    each = marked.where("size(prints) > 0").select("project", "rel_path", told, F.explode("prints").alias("print"), F.xxhash64(folder).alias("folder"), (folder != "").alias("named"))
    key = ["print", "folder"]
    placed = each.groupBy(*key, "named", F.xxhash64("project").alias("project")).agg(F.max("told").alias("told"))
    alike = placed.where("named").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= projects).select(*key)
    known = each.where("told").select("print").distinct()
    anywhere = placed.join(known, "print", "left_semi").select("print", "project").distinct().groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") >= projects)
    spread = alike.union(placed.join(anywhere, "print", "left_semi").select(*key)).distinct()
    each = each.where("not told")
    recurring = each.join(spread, key).groupBy("project", "rel_path").agg(F.count("*").alias("hits"))
    out = marked.select("project", "rel_path", "kind", F.when(F.col("kind").isNull(), F.size("prints")).alias("prints")).join(recurring, ["project", "rel_path"], "left")
    part = F.when(F.col("prints") > 0, F.coalesce("hits", F.lit(0)) / F.col("prints"))
    return out.withColumn("recurring", part).select(
        "project", "rel_path", F.coalesce("kind", F.when((F.col("recurring") >= share) & (F.col("prints") >= 4), F.lit("vendored"))).alias("kind"), "recurring"
    )
