"""Import specifiers of sources and the files they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import language as L
from sedimenta.functions import paths as P

# Per language the patterns of imports; the first group is the specifier.
_SCRIPT = {
    "import": (r"(?m)^\s*import\s+(?:[^'\"();]*?\sfrom\s+)?['\"]([^'\"\n]+)['\"]", r"\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)"),
    "dynamic-import": (r"\bimport\(\s*['\"]([^'\"\n]+)['\"]\s*\)",),
    "re-export": (r"(?m)^\s*export\s+[^'\"();=]*?\sfrom\s+['\"]([^'\"\n]+)['\"]",),
}
_STYLE = (r"@(?:import|use|forward|require)\s+(?:\([^)]*\)\s*)?(?:url\()?\s*['\"]?(?!https?:|//)([^'\"\s;)]+)",)
PATTERNS: dict[str, dict[str, tuple[str, ...]]] = {
    "javascript": _SCRIPT, "typescript": _SCRIPT, "vue": _SCRIPT | {"import": _SCRIPT["import"] + _STYLE}, "svelte": _SCRIPT | {"import": _SCRIPT["import"] + _STYLE},
    "python": {"import": (r"(?m)^\s*from\s+([.\w]+)\s+import\b", r"(?m)^\s*import\s+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)")},
    "go": {"import": (r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"", r"(?m)^\t(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$")},
    "java": {"import": (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",)},
    "kotlin": {"import": (r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)",)}, "scala": {"import": (r"(?m)^\s*import\s+([\w.]+)",)}, "swift": {"import": (r"(?m)^\s*import\s+(?:\w+\s+)?([\w.]+)",)},
    "rust": {"import": (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+(?:\{[^;]*\})?)", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", r"(?m)^\s*extern\s+crate\s+(\w+)", r"#\[path\s*=\s*\"([^\"\n]+)\"\]", r"\binclude!\(\s*\"([^\"\n]+)\"")},
    "csharp": {"import": (r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;",)}, "ruby": {"import": (r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"\n]+)['\"]",)},
    "php": {"import": (r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+(?:\{[^}]*\})?)", r"(?:require|include)(?:_once)?\s*\(?\s*(?:(?:__DIR__|dirname\(__FILE__\))\s*\.\s*)?['\"]([^'\"\n]+)['\"]")}, "c": {"import": (r"(?m)^\s*#\s*include\s+\"([^\"\n]+)\"",)}, "cpp": {"import": (r"(?m)^\s*#\s*include\s+\"([^\"\n]+)\"",)},
    "shell": {"import": (r"(?m)^\s*(?:source|\.)\s+[\"']?([^\s\"';]+)",)}, "css": {"import": _STYLE}, "scss": {"import": _STYLE}, "sass": {"import": _STYLE}, "less": {"import": _STYLE}, "stylus": {"import": _STYLE},
    "elixir": {"import": (r"(?m)^\s*(?:alias|import|require|use)\s+([\w.]+(?:\{[^}]*\})?)",)}, "dart": {"import": (r"(?m)^\s*(?:import|part)\s+['\"]([^'\"\n]+)['\"]",), "re-export": (r"(?m)^\s*export\s+['\"]([^'\"\n]+)['\"]",)},
    "lua": {"import": (r"\b(?:require|dofile|loadfile)\s*\(?\s*['\"]([^'\"\n]+)['\"]",)}, "gdscript": {"import": (r"\b(?:preload|load)\(\s*['\"]([^'\"\n]+)['\"]", r"(?m)^extends\s+['\"]([^'\"\n]+)['\"]")}, "godot-resource": {"import": (r"(?m)^\[ext_resource\b[^\]\n]*\bpath=\"([^\"\n]+)\"",)},
    "html": {"import": (r"(?i)\b(?:href|src)=['\"]([^'\"\n]+)['\"]",)},
}
_LISTS = PATTERNS["python"]["import"][1:]
# What is tried for a path without a file of that name.
SCRIPT_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.mjs")


def extract(chunks: DataFrame) -> DataFrame:
    """chunk_id, project, rel_path, language, specifier, kind (import, dynamic-import, re-export), n (how often) for every chunk.

    chunks: chunk_id, project, rel_path, content, language; a missing language is told by the extension. Repeated rows count once.
    """
    once = chunks.groupBy("chunk_id", "project", "rel_path").agg(F.max("content").alias("content"), F.max("language").alias("language"))
    known = once.withColumn("language", F.coalesce("language", L.language_of(F.col("rel_path"))))
    found = F.array().cast("array<struct<specifier:string,kind:string>>")
    for language, kinds in PATTERNS.items():
        parts = [_matches(p, kind) for kind, ps in kinds.items() for p in ps]
        found = F.when(F.col("language") == language, F.concat(*parts)).otherwise(found)
    each = known.withColumn("_each", F.explode(found)).select("chunk_id", "project", "rel_path", "language", "_each.specifier", "_each.kind")
    each = each.withColumn("specifier", F.explode(_members(F.col("specifier"))))
    return each.groupBy("chunk_id", "project", "rel_path", "language", "specifier", "kind").agg(F.count("*").alias("n"))


def _matches(pattern: str, kind: str) -> Column:
    # a python import names several modules
    names = F.flatten(F.transform(F.regexp_extract_all(F.col("content"), F.lit(pattern), 1), lambda x: F.split(x, r"\s*,\s*"))) if pattern in _LISTS else F.regexp_extract_all(F.col("content"), F.lit(pattern), 1)
    return F.transform(names, lambda x: F.struct((F.regexp_extract(x, r"^[\w.]+", 0) if pattern in _LISTS else x).alias("specifier"), F.lit(kind).alias("kind")))


def _members(spec: Column) -> Column:
    """The names that a specifier with a group stands for: a::{b, c::{d, e}} is a::b, a::c::d, a::c::e; ``self`` and what follows ``as`` go.
    Each step opens the innermost groups; three levels are opened, deeper ones keep their outer part."""
    plain = F.regexp_replace(F.regexp_replace(spec, r"\s+as\s+\w+", ""), r"\s+", "")
    names = F.array(plain)

    def opened(name: Column) -> Column:
        head, inside, tail = (F.regexp_extract(name, r"^(.*?)([\w:.\\]*)\{([^{}]*)\}(.*)$", i) for i in (1, 3, 4))
        stem = F.regexp_extract(name, r"^(.*?)([\w:.\\]*)\{([^{}]*)\}(.*)$", 2)
        flat = F.array_join(F.transform(F.filter(F.split(inside, ","), lambda x: x != ""), lambda x: F.concat(stem, x)), ",")
        return F.when(name.contains("{"), F.concat(head, flat, tail)).otherwise(name)

    for _ in range(3):
        names = F.transform(names, opened)
    every = F.flatten(F.transform(names, lambda n: F.split(F.regexp_replace(n, r"\{.*$", ""), ",")))
    return F.filter(F.transform(every, lambda n: F.regexp_replace(n, r"(?:::|\.|\\)(?:self)?$|::self$", "")), lambda n: n != "")


def _first_existing(rows: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """Adds target: the first of the candidate paths that is a file of the project, else null."""
    key = ["project", "rel_path", "specifier", "kind"]
    rows = rows.select(*key).distinct()
    tried = rows.select(*key, F.posexplode(candidates).alias("_at", "_path"))
    there = tried.join(files.select("project", F.col("rel_path").alias("_path")).distinct(), ["project", "_path"])
    best = there.groupBy(*key).agg(F.min_by("_path", "_at").alias("target"))
    return rows.join(best, key, "left")


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """project, rel_path, specifier, kind, target of imports that begin with a dot and a slash (scripts), or a dot (python)."""
    dotted = imports.where(F.col("specifier").startswith("./") | F.col("specifier").startswith("../"))
    place = P.normalized(F.concat_ws("/", P.folder(F.col("rel_path")), "specifier"))
    bare = F.regexp_replace(place, r"\.(?:js|jsx|mjs)$", "")
    candidates = F.concat(F.array(*(F.concat(place, F.lit(e)) for e in SCRIPT_ENDS)), F.array(*(F.concat(bare, F.lit(e)) for e in (".ts", ".tsx"))))
    return _first_existing(dotted, candidates, files)


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """project, rel_path, specifier, kind, target of imports by module name.

    python: relative dots, then the root, ``src`` and ``lib``, then the importer's folder; java: the class below the usual source roots.
    """
    named = imports.where(F.col("language").isin("python", "java", "rust", "lua"))
    name = F.regexp_replace(F.regexp_replace("specifier", r"^crate::", "src::"), r"::|\.", "/")
    up = F.length(F.regexp_extract("specifier", r"^\.*", 0))
    folder = P.folder(F.col("rel_path"))
    base = F.concat_ws("/", folder, F.array_repeat(F.lit(".."), F.greatest(up - 1, F.lit(0))))
    tail = F.regexp_replace(F.regexp_replace("specifier", r"^\.+", ""), r"\.", "/")
    ends = ("{}.py", "{}/__init__.py")
    relative = [P.normalized(F.concat_ws("/", base, F.concat(tail, F.lit(e[2:])))) for e in ends]
    roots = [F.concat(F.lit(r), name, F.lit(e[2:])) for r in ("", "src/", "lib/") for e in ends] + [F.concat_ws("/", folder, F.concat(name, F.lit(e[2:]))) for e in ends]
    java = [F.concat(F.lit(r), name, F.lit(".java")) for r in ("", "src/main/java/", "src/main/", "src/")]
    rust = [F.concat(name, F.lit(e)) for e in (".rs", "/mod.rs")] + [F.concat_ws("/", folder, F.concat(name, F.lit(e))) for e in (".rs", "/mod.rs")]
    candidates = (
        F.when((F.col("language") == "python") & (up > 0), F.array(*relative)).when(F.col("language") == "python", F.array(*roots)).when(F.col("language") == "java", F.array(*java)).when(F.col("language") == "rust", F.array(*rust)).otherwise(F.array(F.concat(name, F.lit(".lua"))))
    )
    rows = named.withColumn("_c", candidates)
    key = ["project", "rel_path", "specifier", "kind"]
    tried = rows.select(*key, F.posexplode("_c").alias("_at", "_path")).where("_path <> rel_path").distinct()
    there = tried.join(files.select("project", F.col("rel_path").alias("_path")).distinct(), ["project", "_path"])
    best = there.groupBy(*key).agg(F.min_by("_path", "_at").alias("target"))
    return rows.select(*key).distinct().join(best, key, "left")


def nearest(files: DataFrame, folders: DataFrame) -> DataFrame:
    """project, rel_path, folder: the longest of the given folders above each file, null if none is. An equi-join on all folders above."""
    above = files.select("project", "rel_path", F.posexplode(P.prefixes(F.col("rel_path"))).alias("_depth", "folder"))
    hit = above.join(folders, ["project", "folder"]).groupBy("project", "rel_path").agg(F.max_by("folder", "_depth").alias("folder"))
    return files.join(hit, ["project", "rel_path"], "left").select("project", "rel_path", "folder")
