"""From import specifiers to the files they name, for every language: ordered candidate paths, manifests and declared names.

Each way to find a target gives rows (import, rank, path); they are united, joined with the files of the project once, and the first rank
that is a file wins. Longest prefixes are equi-joins on all prefixes of a specifier, so nothing compares all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import paths as P
from sedimenta.operators.imports import SCRIPT_ENDS

KEY = ("project", "rel_path", "language", "specifier", "kind")
SCRIPTS = ("javascript", "typescript", "vue", "svelte")
STYLES = ("css", "scss", "sass", "less", "stylus")
# Source roots of the JVM languages, endings of their files, and endings tried for other languages.
JVM = {"java": (".java",), "kotlin": (".kt", ".kts", ".java"), "scala": (".scala", ".java")}
JVM_ROOTS = ("", "src/main/{}/", "src/main/", "src/")
STYLE_ENDS = ("", ".scss", ".sass", ".css", ".less", ".styl", "/index.scss", "/_index.scss", "/index.css")


def manifests(files: DataFrame) -> DataFrame:
    """project, kind, prefix, target: what manifests (files with content) say about names.

    go: module path and its folder; dart: package name and its lib folder; php: PSR-4 prefix and folder; script: workspace package and its
    folder, or alias up to its star and what replaces it; python: a package root below a project file.
    """
    name, content = P.base(F.col("rel_path")), F.col("content")
    folder = P.folder(F.col("rel_path"))
    below = lambda path: P.normalized(F.concat_ws("/", folder, path))
    base = files.where("content is not null").withColumns({"_name": name, "_folder": folder})

    def rows(where: Column, kind: str, prefix: Column, target: Column) -> DataFrame:
        return base.where(where).select("project", F.lit(kind).alias("kind"), prefix.alias("prefix"), target.alias("target"))

    plain = F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[\s,{\[])//[^\n]*", "$1")
    psr = F.from_json(F.get_json_object(content, "$.autoload.psr-4"), "map<string,string>")
    alias = F.from_json(F.get_json_object(plain, "$.compilerOptions.paths"), "map<string,array<string>>")
    root = F.coalesce(F.get_json_object(plain, "$.compilerOptions.baseUrl"), F.lit("."))
    php = base.where(name == "composer.json").select("project", "rel_path", F.explode(psr).alias("p", "d"))
    script = base.where(name.isin("tsconfig.json", "jsconfig.json")).select("project", "rel_path", root.alias("root"), F.explode(alias).alias("p", "ds")).where("size(ds) > 0")
    found = [
        rows(name == "go.mod", "go", F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1), F.col("_folder")),
        rows(name == "pubspec.yaml", "dart", F.regexp_extract(content, r"(?m)^name:\s*[\"']?([\w]+)", 1), below(F.lit("lib"))),
        php.select("project", F.lit("php").alias("kind"), F.regexp_replace("p", r"\\+$", "").alias("prefix"), P.normalized(F.concat_ws("/", folder, "d")).alias("target")),
        rows(name == "package.json", "script", F.get_json_object(content, "$.name"), F.col("_folder")),
        script.select("project", F.lit("script").alias("kind"), F.regexp_replace("p", r"/?\*$", "").alias("prefix"), P.normalized(F.concat_ws("/", folder, "root", F.regexp_replace(F.col("ds")[0], r"/?\*$", ""))).alias("target")),
        rows(name == "pyproject.toml", "python", F.lit(""), below(F.regexp_extract(content, r"(?m)^\s*(?:where|package-dir|from)\s*=\s*\[?\{?[^\"'\n]*[\"']([^\"']+)[\"']", 1))),
        rows(name.isin("setup.py", "setup.cfg"), "python", F.lit(""), F.col("_folder")),
    ]
    return reduce(DataFrame.unionByName, found).where("prefix is not null and (prefix <> '' or kind = 'python')").distinct()


def declared_names(files: DataFrame) -> DataFrame:
    """project, language, name, file: the first file, by path, that declares a namespace (csharp), module (elixir), qualified class (php) or
    class name (gdscript)."""
    content = F.col("content")
    space = F.regexp_extract(content, r"(?m)(?:^|<\?php)\s*namespace\s+([\w\\]+)\s*[;{]", 1)
    php = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:abstract\s+|final\s+|readonly\s+)*(?:class|interface|trait|enum)\s+(\w+)"), 1), lambda c: F.when(space == "", c).otherwise(F.concat(space, F.lit("\\"), c)))
    ways = {
        "csharp": F.regexp_extract_all(content, F.lit(r"(?m)^\s*namespace\s+([\w.]+)"), 1),
        "elixir": F.regexp_extract_all(content, F.lit(r"(?m)^\s*defmodule\s+([\w.]+)"), 1),
        "php": php,
        "gdscript": F.regexp_extract_all(content, F.lit(r"(?m)^class_name\s+(\w+)"), 1),
    }
    rows = [files.where((F.col("language") == k) & content.isNotNull()).select("project", "language", F.explode(v).alias("name"), "rel_path") for k, v in ways.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("project", "language", "name").agg(F.min("rel_path").alias("file"))


def _with(path: Column, ends: tuple[str, ...]) -> list[Column]:
    return [F.concat(path, F.lit(e)) for e in ends]


def _path_candidates() -> Column:
    """The candidate paths that follow from specifier, language and importing file alone, in order."""
    spec, language, folder = F.col("specifier"), F.col("language"), P.folder(F.col("rel_path"))
    beside = P.normalized(F.concat_ws("/", folder, spec))
    dotted = spec.startswith("./") | spec.startswith("../") | spec.isin(".", "..")
    scripts = [*_with(beside, SCRIPT_ENDS), *_with(F.regexp_replace(beside, r"\.(?:js|jsx|mjs|cjs)$", ""), (".ts", ".tsx", ".d.ts"))]
    partial = P.normalized(F.concat_ws("/", folder, P.folder(spec), F.concat(F.lit("_"), P.base(spec))))
    styles = [*_with(beside, STYLE_ENDS), *_with(partial, (".scss", ".sass", ".less"))]
    up = F.length(F.regexp_extract(spec, r"^\.*", 0))
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    python_ends = (".py", "/__init__.py", ".pyi")
    near = P.normalized(F.concat_ws("/", folder, F.array_join(F.array_repeat(F.lit(".."), F.greatest(up - 1, F.lit(0))), "/"), module))
    python = F.when(up > 0, F.array(*_with(near, python_ends))).otherwise(
        F.array(*(c for r in ("", "src/", "lib/") for c in _with(F.concat(F.lit(r), module), python_ends)), *_with(P.normalized(F.concat_ws("/", folder, module)), python_ends))
    )
    crate = F.regexp_replace(spec, "::", "/")
    own = F.when(P.base(F.col("rel_path")).isin("mod.rs", "lib.rs", "main.rs"), folder).otherwise(F.regexp_replace("rel_path", r"\.rs$", ""))
    bases = (
        F.when(spec.startswith("crate::"), F.concat(F.lit("src/"), F.regexp_replace(crate, "^crate/", "")))
        .when(spec.startswith("self::"), P.normalized(F.concat_ws("/", own, F.regexp_replace(crate, "^self/", ""))))
        .when(spec.startswith("super::"), P.normalized(F.concat_ws("/", own, F.lit(".."), F.regexp_replace(crate, "^super/", ""))))
        .otherwise(P.normalized(F.concat_ws("/", own, crate)))
    )
    shorter = F.regexp_replace(bases, r"/[^/]*$", "")  # the last part may be an item of the module
    rust = [*_with(beside, ("",)), *_with(bases, (".rs", "/mod.rs")), *_with(shorter, (".rs", "/mod.rs"))]
    jvm_path = F.replace(F.regexp_replace(spec, r"\.\*$", ""), F.lit("."), F.lit("/"))
    jvm_outer = F.regexp_replace(jvm_path, r"/[^/]*$", "")  # a nested class or a member
    jvm = F.when(F.lit(False), F.array(F.lit("")))
    for k, ends in JVM.items():
        jvm = jvm.when(language == k, F.array(*(F.concat(F.lit(r.format(k)), p, F.lit(e)) for p in (jvm_path, jvm_outer) for r in JVM_ROOTS for e in ends)))
    ruby = [*_with(beside, ("", ".rb")), *_with(spec, ("", ".rb")), *_with(F.concat(F.lit("lib/"), spec), (".rb",))]
    php_file = F.regexp_replace(spec, r"^/+", "")
    php_path = F.replace(F.regexp_replace(spec, r"^\\+", ""), F.lit("\\"), F.lit("/"))
    lowered = F.concat(F.lower(F.substring_index(php_path, "/", 1)), F.regexp_extract(php_path, "(/.*)$", 1))
    php = [*_with(P.normalized(F.concat_ws("/", folder, php_file)), ("",)), *_with(php_file, ("",)), *_with(php_path, (".php",)), *_with(lowered, (".php",)), F.concat(F.lit("src/"), php_path, F.lit(".php")), F.concat(F.lit("lib/"), php_path, F.lit(".php"))]
    swift = _with(beside, ("", ".swift"))
    lua = F.replace(spec, F.lit("."), F.lit("/"))
    return (
        F.when(language.isin(*SCRIPTS) & dotted, F.array(*scripts))
        .when(language.isin(*STYLES), F.array(*styles))
        .when(language == "python", python)
        .when(language.isin("c", "cpp"), F.array(beside))
        .when(language == "ruby", F.array(*ruby))
        .when(language == "php", F.array(*php))
        .when(language == "rust", F.array(*rust))
        .when(language.isin(*JVM), jvm)
        .when(language == "swift", F.array(*swift))
        .when(language == "shell", F.array(beside, spec))
        .when((language == "dart") & ~spec.contains(":"), F.array(beside))
        .when(language == "lua", F.array(*_with(lua, (".lua", "/init.lua"))))
        .when(language.isin("gdscript", "godot-resource") & spec.startswith("res://"), F.array(F.regexp_replace(spec, "^res://", "")))
        .when(language.isin("gdscript", "godot-resource", "html"), F.array(beside))
        .otherwise(F.array().cast("array<string>"))
    )


def _prefixes(spec: Column, sign: str) -> Column:
    """All prefixes of a name at its separators, shortest first, itself last."""
    parts = F.split(spec, "\\\\\\\\" if sign == "\\" else sign, -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sign))


def _by_manifest(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates below the target of the longest prefix that a manifest names: KEY, rank, path; for go the path is a folder."""
    language, spec = F.col("language"), F.regexp_replace("specifier", r"^(?:package:|\\+)", "")
    kind = F.when(language.isin(*SCRIPTS, *STYLES), "script").otherwise(language)
    named = asked.where(language.isin("go", "dart", "php", *SCRIPTS, *STYLES)).withColumns({"kind_": kind, "spec": spec})
    tried = named.select(*KEY, "kind_", "spec", F.posexplode(F.when(language == "php", _prefixes(F.col("spec"), "\\")).otherwise(_prefixes(F.col("spec"), "/"))).alias("at", "prefix"))
    hit = tried.join(found.withColumnRenamed("kind", "kind_"), ["project", "kind_", "prefix"]).withColumn("prefix_size", F.length("prefix"))
    rest = F.replace(F.expr("substring(spec, prefix_size + 2)"), F.lit("\\"), F.lit("/"))
    path = P.normalized(F.concat_ws("/", "target", rest))
    ends = F.when(language == "php", F.array(F.concat(path, F.lit(".php")))).when(language.isin("go", "dart"), F.array(path)).otherwise(F.array(*_with(path, SCRIPT_ENDS), *_with(path, ("/src/index.ts", "/src/index.js", "/main.js")), *_with(path, STYLE_ENDS[1:6])))
    each = hit.select(*KEY, "at", F.posexplode(ends).alias("order", "path"))
    return each.select(*KEY, (F.col("order") - 1000 * F.col("at")).alias("rank"), "path")


def resolve_all(imports: DataFrame, files: DataFrame) -> DataFrame:
    """KEY and target of every distinct import: the file it names, null if it is none of the project.

    imports: project, rel_path, language, specifier, kind; files: project, rel_path, language, content (used of manifests and of files that
    declare names). A candidate that is the importing file itself ends the search of python imports and is passed over elsewhere. Where
    several manifests name one prefix, the smallest path wins.
    """
    asked = imports.select(*KEY).where("specifier is not null and specifier <> ''").distinct()
    there = files.select("project", F.col("rel_path").alias("path")).distinct()
    rows = asked.select(*KEY, F.posexplode(_path_candidates()).alias("rank", "path"))
    found = manifests(files)
    beyond = asked.where("language = 'python' and specifier not like '.%'").join(found.where("kind = 'python'").select("project", "target"), "project")
    roots = beyond.select(*KEY, F.posexplode(F.array(*_with(P.normalized(F.concat_ws("/", "target", F.replace("specifier", F.lit("."), F.lit("/")))), (".py", "/__init__.py")))).alias("order", "path"))
    manifest = _by_manifest(asked, found)
    packages = files.where("language = 'go' and rel_path not like '%\\\\_test.go'").groupBy("project", P.folder(F.col("rel_path")).alias("folder")).agg(F.min("rel_path").alias("path"))
    go = manifest.where("language = 'go'").withColumnRenamed("path", "folder").join(packages, ["project", "folder"]).select(*KEY, "rank", "path")
    name = F.when(F.col("language") == "php", F.regexp_replace("specifier", r"^\\+", "")).otherwise(F.col("specifier"))
    declared = asked.withColumn("name", name).join(declared_names(files), ["project", "language", "name"]).select(*KEY, F.lit(-1).alias("rank"), F.col("file").alias("path"))
    suffix = _by_suffix(asked, files)
    every = reduce(DataFrame.unionByName, [rows, roots.select(*KEY, (F.col("order") + 100).alias("rank"), "path"), manifest.where("language <> 'go'"), go, declared, suffix])
    best = every.join(there, ["project", "path"]).where("path <> rel_path or language = 'python'").groupBy(*KEY).agg(F.min(F.struct("rank", "path")).alias("best"))
    hit = F.when(F.col("best.path") != F.col("rel_path"), F.col("best.path"))
    return asked.join(best.select(*KEY, hit.alias("target")), list(KEY), "left")


def _by_suffix(asked: DataFrame, files: DataFrame) -> DataFrame:
    """For JVM imports the file whose path ends with the class's path below a source root of any module; the first by path."""
    ends = files.where(F.col("language").isin(*JVM)).select("project", "rel_path", F.regexp_replace("rel_path", r"\.\w+$", "").alias("bare"))
    below = ends.select("project", "rel_path", F.regexp_extract("bare", r"(?:^|/)src/\w+/(?:java|kotlin|scala)/(.*)$", 1).alias("class_path")).where("class_path <> ''")
    first = below.groupBy("project", "class_path").agg(F.min("rel_path").alias("path"))
    named = asked.where(F.col("language").isin(*JVM)).withColumn("class_path", F.replace(F.regexp_replace("specifier", r"\.\*$", ""), F.lit("."), F.lit("/")))
    return named.join(first, ["project", "class_path"]).select(*KEY, F.lit(500).alias("rank"), "path")
