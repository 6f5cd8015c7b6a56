"""Call sites of sources with the symbol they stand in, and their resolution in stages over modules, re-exports and dependencies."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.declared import pattern_symbols, python_symbols
from sedimenta.plans.workspace import Workspace

SCRIPTS = ("javascript", "typescript", "vue", "svelte")
# Words before a parenthesis that are no calls.
_WORDS = frozenset(
    "if for while switch catch return function def fn func class new elif elsif else try do with match case when unless until and or not in is typeof instanceof await yield throw raise assert lambda sizeof using lock foreach fixed unchecked checked super this self import export package struct enum interface trait impl mod use pub let var const fun where".split()
)
_CALL = re.compile(r"(?:(?P<q>[A-Za-z_$@][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)(?:\.|::|->|\?\.))?(?P<n>[A-Za-z_$][\w$]*)(?P<m>!?)\s*(?:<[\w, <>]*>)?\(")
_QUIET = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|//[^\n]*|/\*.*?\*/", re.S)
_HASHED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w$])#[^\n]*")
_COMMAND = re.compile(r"(?:^|[;&|({]|\b(?:then|do|else)\b)\s*([A-Za-z_][\w-]*)(?=\s|$|;|\))")
_IMPORTED = re.compile(r"(?m)^\s*import\s+(?:type\s+)?([^'\"();]*?)\s+from\s+['\"]([^'\"\n]+)['\"]")
_REQUIRED = re.compile(r"\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"\n]+)['\"]\s*\)")
_REEXPORTED = re.compile(r"(?m)^\s*export\s+(?:type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s+['\"]([^'\"\n]+)['\"]")
_LISTED = re.compile(r"(?m)^\s*export\s*\{([^}]*)\}\s*(?!\s*from);?\s*$")
_EXPORTED = re.compile(r"(?m)^\s*export\s+(default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|enum|const|let|var)\s+([\w$]+)")
_DEFAULT = re.compile(r"(?m)^\s*export\s+default\s+([\w$]+)\s*;?\s*$")


def _pairs(text: str) -> list[tuple[str, str]]:
    """The names and their aliases of ``{ a as b, c: d, e }``."""
    out = []
    for part in text.strip().strip("{}").split(","):
        m = re.fullmatch(r"\s*(?:type\s+)?([\w$]+)(?:\s*(?:\bas\b|:)\s*([\w$]+))?\s*", part)
        if m:
            out.append((m.group(1), m.group(2) or m.group(1)))
    return out


def script_names(text: str) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str, str]], dict[str, str]]:
    """Of a script: local name -> (module, imported name; * for the whole module), re-exports (name, imported name, module), and exported
    names -> what they are exported as."""
    local: dict[str, tuple[str, str]] = {}
    for clause, module in _IMPORTED.findall(text):
        for m in re.finditer(r"\*\s+as\s+([\w$]+)", clause):
            local[m.group(1)] = module, "*"
        for name, alias in _pairs("".join(re.findall(r"\{[^}]*\}", clause))):
            local[alias] = module, name
        first = re.match(r"([\w$]+)\s*(?:,|$)", clause)
        if first:
            local[first.group(1)] = module, "default"
    for what, module in _REQUIRED.findall(text):
        for name, alias in _pairs(what) if what[0] == "{" else [("*", what)]:
            local[alias] = module, name
    again = []
    for what, module in _REEXPORTED.findall(text):
        if what[0] == "*":
            alias = re.search(r"as\s+([\w$]+)", what)
            again.append((alias.group(1) if alias else "*", "*", module))
        else:
            again += [(alias, name, module) for name, alias in _pairs(what)]
    shown = {name: "default" if default else name for default, name in _EXPORTED.findall(text)}
    shown |= {name: "default" for name in _DEFAULT.findall(text)}
    for names in _LISTED.findall(text):
        shown |= dict(_pairs(names))
    return local, again, shown


def _python_calls(tree: ast.AST) -> tuple[list[tuple[str, str, int]], dict[str, tuple[str, str]]]:
    calls, local = [], {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            chain, at = [], node.func
            while isinstance(at, ast.Attribute):
                chain.append(at.attr)
                at = at.value
            if isinstance(at, ast.Name):
                chain.append(at.id)
            if chain:
                calls.append((chain[0], ".".join(reversed(chain[1:])), node.lineno))
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            local |= {a.asname or a.name: (module, a.name) for a in node.names if a.name != "*"}
        elif isinstance(node, ast.Import):
            local |= {a.asname or a.name: (a.name, "*") for a in node.names}
    return calls, local


def _pattern_calls(text: str, language: str, declared: set[tuple[str, int]]) -> list[tuple[str, str, int]]:
    quiet = (_HASHED if language in ("ruby", "shell", "elixir", "gdscript", "python") else _QUIET).sub(lambda m: "\n" * m.group().count("\n"), text)
    out = []
    for i, line in enumerate(quiet.split("\n"), 1):
        if language == "shell":
            out += [(name, "", i) for name in _COMMAND.findall(line) if name not in _WORDS and name not in ("then", "fi", "done", "esac", "local", "echo", "set", "export") and (name, i) not in declared]
            continue
        for m in _CALL.finditer(line):
            name = m.group("n")
            if name not in _WORDS and (name, i) not in declared:
                out.append((name, re.sub(r"::|->|\?\.", ".", m.group("q") or ""), i))
    return out


def _innermost(symbols: list[tuple], line: int) -> tuple | None:
    best = None
    for s in symbols:
        if s[3] <= line <= s[4] and (best is None or s[3] >= best[3]):
            best = s
    return best


SITES = "project string, file string, language string, caller string, callee string, line int, qualifier string, source_module string, imported_name string"
SYMBOLS = "project string, file string, language string, symbol_id string, name string, qualified_name string, kind string, line int, end_line int, is_exported boolean, exported_as string"
REEXPORTS = "project string, file string, name string, imported_name string, source_module string"


def _read(text: str, language: str | None) -> tuple[list, list, dict, list, dict]:
    """symbols, calls, imported names, re-exports, exports of a source."""
    symbols, again, shown, local = None, [], {}, {}
    if language == "python":
        symbols = python_symbols(text)
        if symbols is not None:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                calls, local = _python_calls(ast.parse(text))
    if symbols is None:
        symbols = pattern_symbols(text, language or "")
        calls = _pattern_calls(text, language or "", {(s[0].split(".")[-1].split(":")[-1], s[3]) for s in symbols})
    if language in SCRIPTS:
        local, again, shown = script_names(text)
    return symbols, calls, local, again, shown


def _files(files: DataFrame) -> DataFrame:
    return files.select("project", "rel_path", "language", F.coalesce("content", F.lit("")).alias("content"))


def symbols_of(files: DataFrame) -> DataFrame:
    """The symbols of files (project, rel_path, language, content) with their ids; a ``<module>`` symbol spans each file. is_exported is
    null where a language has no exports, which counts as exported."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, language, text in b.itertuples(index=False):
                symbols, _, _, _, shown = _read(text, language)
                for name, full, kind, line, end in [("<module>", "<module>", "module", 1, text.count("\n") + 1), *symbols]:
                    exported = (name in shown) if language in SCRIPTS and name != "<module>" else None
                    rows.append((project, path, language, f"{path}::{full}#{line}", name, full, kind, line, end, exported, shown.get(name)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")]).astype({"is_exported": "boolean"})

    return _files(files).mapInPandas(go, SYMBOLS)


def call_sites(files: DataFrame) -> DataFrame:
    """Every call in files: the symbol it stands in (the innermost, of those with one start the one declared later; else the module), the
    last name of what is called, what stands before it, and for imported names the module and the name there. Python sources are parsed,
    others are read by patterns without strings and comments; a source that doesn't parse is read by patterns, too."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, language, text in b.itertuples(index=False):
                symbols, calls, local, _, _ = _read(text, language)
                for name, qualifier, line in calls:
                    s = _innermost(symbols, line)
                    caller = f"{path}::{s[1]}#{s[3]}" if s else f"{path}::<module>#1"
                    module = imported = None
                    if not qualifier and name in local and local[name][1] != "*":
                        module, imported = local[name]
                    elif qualifier in local and local[qualifier][1] == "*":  # else a member of an imported value
                        module, imported = local[qualifier][0], name
                    rows.append((project, path, language, caller, name, line, qualifier, module, imported))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SITES.split(", ")])

    return _files(files).mapInPandas(go, SITES)


def reexports_of(files: DataFrame) -> DataFrame:
    """Names that scripts export from other modules: name (* for all), the name there and the module."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, f, *again) for p, f, _, text in b.itertuples(index=False) for again in script_names(text)[1]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REEXPORTS.split(", ")])

    return _files(files).where(F.col("language").isin(*SCRIPTS)).mapInPandas(go, REEXPORTS)


def exported_search(asked: DataFrame, symbols: DataFrame, reexports: DataFrame) -> DataFrame:
    """project, file, name, symbol_id: the exported symbols that each asked (project, file, name) leads to, directly or over re-exports.

    Re-exports (project, file, name, imported_name, target: a file) are followed to any depth; a pair of file and name is visited once for
    each question, so rings of re-exports end. default finds what is exported as default.
    """
    ws = Workspace(asked.sparkSession, "exports")
    start = asked.select("project", "file", "name").distinct()
    front = ws.write(start.select("project", F.col("file").alias("root_file"), F.col("name").alias("root_name"), "file", "name"), "step0")
    schema, steps = front.schema, ["step0"]
    links = reexports.where("target is not null").select("project", "file", F.col("name").alias("shown"), "imported_name", "target").distinct()
    while True:
        last = ws.read(schema, steps[-1])
        named = last.join(links, ["project", "file"]).where("shown = name or shown = '*' and imported_name = '*'")
        step = named.select("project", "root_file", "root_name", F.col("target").alias("file"), F.when(F.col("shown") == "*", F.col("name")).otherwise(F.col("imported_name")).alias("name")).distinct()
        new = step.join(ws.read(schema, *steps), schema.names, "left_anti")
        name = f"step{len(steps)}"
        if ws.write(new, name).isEmpty():
            break
        steps.append(name)
    every = ws.read(schema, *steps)
    shown = symbols.where("coalesce(is_exported, true) and name <> '<module>'")
    by_name = shown.select("project", "file", F.col("name").alias("name"), "symbol_id", "exported_as").where("exported_as is null or exported_as = name or exported_as <> 'default'")
    keys = by_name.select("project", "file", "name", "symbol_id").union(shown.where("exported_as is not null").select("project", "file", F.col("exported_as").alias("name"), "symbol_id")).distinct()
    hits = every.join(keys, ["project", "file", "name"])
    return hits.select("project", F.col("root_file").alias("file"), F.col("root_name").alias("name"), "symbol_id").distinct()


def resolve_sites(sites: DataFrame, symbols: DataFrame, dependencies: DataFrame, targets: DataFrame, reexports: DataFrame) -> DataFrame:
    """sites with confidence (local, unique, multiple-candidates, unresolved) and candidates, sorted symbol ids.

    dependencies: project, file, dep; targets: project, file, source_module, target (files that modules name); reexports: project, file,
    name, imported_name, source_module. A site of an imported name looks for it in the module's file alone; any other looks in its own
    file, where all matches count, then in all files its file depends on. Searches in other files see exported symbols, over re-exports.
    Calls are looked up once per file and name, however often they occur.
    """
    keys = ["project", "file", "callee", "source_module", "imported_name"]
    asked = sites.select(*keys).distinct()
    plain, named = asked.where("source_module is null"), asked.where("source_module is not null")
    own = symbols.where("name <> '<module>'").select("project", "file", F.col("name").alias("callee"), "symbol_id").distinct()
    local = plain.join(own, ["project", "file", "callee"]).select(*keys, F.lit(0).alias("tier"), "symbol_id")
    again = reexports.join(targets, ["project", "file", "source_module"], "left")
    here = named.join(targets, ["project", "file", "source_module"]).select(*keys, F.col("target").alias("there"), F.coalesce("imported_name", "callee").alias("wanted"))
    near = plain.join(dependencies.where("dep is not null").select("project", "file", F.col("dep").alias("there")).distinct(), ["project", "file"]).select(*keys, "there", F.col("callee").alias("wanted"))
    places = here.withColumn("tier", F.lit(1)).unionByName(near.withColumn("tier", F.lit(2))).where("there is not null")
    found = exported_search(places.select("project", F.col("there").alias("file"), F.col("wanted").alias("name")), symbols, again)
    far = places.join(found.select("project", F.col("file").alias("there"), F.col("name").alias("wanted"), "symbol_id"), ["project", "there", "wanted"]).select(*keys, "tier", "symbol_id")
    every = local.unionByName(far)
    best = every.groupBy(*keys).agg(F.min("tier").alias("tier"))
    same = reduce(lambda a, b: a & b, (F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "tier"]))
    kept = every.alias("e").join(best.alias("b"), same).groupBy(*(F.col(f"e.{k}").alias(k) for k in keys)).agg(F.min("e.tier").alias("tier"), F.array_sort(F.collect_set("e.symbol_id")).alias("candidates"))
    match = reduce(lambda a, b: a & b, (F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys))
    confidence = F.when(F.col("k.tier").isNull(), "unresolved").when(F.col("k.tier") == 0, "local").when(F.size("k.candidates") == 1, "unique").otherwise("multiple-candidates")
    return sites.alias("s").join(kept.alias("k"), match, "left").select("s.*", confidence.alias("confidence"), F.coalesce("k.candidates", F.array().cast("array<string>")).alias("candidates"))
