"""Symbols, calls between them and their resolution.

symbols(symbol_id, name, file, line, project), calls(project, caller, callee) of symbol ids, sites(project, file, name, caller) for calls
whose target isn't known yet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import language as L
from sedimenta.functions import paths as P
from sedimenta.operators.graph import reach

# The conventional entry point of a language, method names of routers, and words before a parenthesis that are no calls.
ENTRY_NAMES = {"csharp": "Main"} | dict.fromkeys(("javascript", "typescript", "python", "go", "rust", "java", "kotlin", "scala", "c", "cpp", "swift", "ruby", "php", "dart"), "main")
ROUTE_NAMES = ("get", "post", "put", "delete", "patch", "head", "options", "all", "use")
SPAN = 64
NO_CALLS = ("if", "for", "while", "switch", "return", "function", "def", "fn", "func", "class", "new")


def symbols_from_flow(flow: DataFrame) -> DataFrame:
    """One row per node of the flow table."""
    keep = {c: F.min(c).alias(c) for c in ("project", "symbol_id", "symbol_name", "file", "line_no")}
    return flow.where("node_id is not null").groupBy("node_id").agg(*keep.values()).withColumnRenamed("symbol_name", "name").withColumnRenamed("line_no", "line")


def calls_from_flow(flow: DataFrame) -> DataFrame:
    """Distinct calls (caller, callee) of node ids that exist."""
    pairs = flow.where("node_id is not null").select(F.col("node_id").alias("caller"), F.explode("children").alias("callee")).where("callee is not null").distinct()
    return pairs.join(flow.select(F.col("node_id").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee")


def name_index(symbols: DataFrame) -> DataFrame:
    """project, name, symbol_id, n: the symbols of each name, and how many share it; module bodies are left out. One row per symbol, so a
    name that everyone uses makes no endless row."""
    named = symbols.where("name <> '<module>'").select("project", "name", "symbol_id").distinct()
    return named.join(named.groupBy("project", "name").agg(F.count("*").alias("n")), ["project", "name"])


def reverse_index(calls: DataFrame) -> DataFrame:
    """callee, caller, n: every caller of a symbol once, and how many there are."""
    pairs = calls.select("callee", "caller").distinct()
    return pairs.join(pairs.groupBy("callee").agg(F.count("*").alias("n")), "callee")


def context(symbols: DataFrame, calls: DataFrame, shown: int = 30) -> DataFrame:
    """Every symbol with the totals of its callers and callees and the first of each by id. Totals are added up before the shuffle, and only
    the first rows of a group are kept before it is sorted."""

    def side(me: str, other: str, name: str) -> DataFrame:
        first = calls.withColumn("_r", F.row_number().over(Window.partitionBy(me).orderBy(other))).where(F.col("_r") <= shown)
        listed = first.groupBy(F.col(me).alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(other)), ",").alias(name))
        return listed.join(calls.groupBy(F.col(me).alias("node_id")).agg(F.count("*").alias(f"n_{name}")), "node_id")

    out = symbols.select("node_id", "project", "name", "file", "line")
    for s in (side("callee", "caller", "callers"), side("caller", "callee", "callees")):
        out = out.join(s, "node_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_callers", "n_callees")} | {c: F.coalesce(c, F.lit("")) for c in ("callers", "callees")})


def find(symbols: DataFrame, part: str, limit: int = 200) -> DataFrame:
    """The first symbols whose name holds part, regardless of case, by name, file and line."""
    hits = symbols.where(F.contains(F.lower("name"), F.lit(part.lower()))).where("name <> '<module>'")
    return hits.orderBy("name", "file", "line", "node_id").limit(limit)


def entry_points(symbols: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """project, id, name, file, reason of where a program may begin, each reason once.

    orphan: a file whose symbols call others and that no file depends on (its id and name are its path); well-known-name: a symbol of the
    conventional name of its file's language; framework: the symbol that holds a call of a router's method; test: a symbol of a test's
    name. symbols: node_id, project, name, file; calls: caller, callee; edges: project, src, dst.
    """
    base = symbols.where("name <> '<module>'").select("project", F.col("node_id").cast("string").alias("id"), "name", "file", "node_id")
    caller, callee = symbols.select(F.col("node_id").alias("caller"), "project", "file"), symbols.select(F.col("node_id").alias("callee"), F.lower("name").alias("called"))
    busy = calls.join(caller, "caller").select("project", "file").distinct()
    used = edges.where("dst is not null").select("project", F.col("dst").alias("file")).distinct()
    alone = busy.join(used, ["project", "file"], "left_anti").select("project", F.col("file").alias("id"), F.col("file").alias("name"), "file", F.lit("orphan").alias("reason"))
    usual = F.create_map(*(F.lit(x) for kv in ENTRY_NAMES.items() for x in kv))
    known = base.where(F.try_element_at(usual, L.language_of(F.col("file"))) == F.col("name"))
    route = F.when(F.col("called") == "route", "framework:route").when(F.col("called").isin(*ROUTE_NAMES), F.concat(F.lit("framework:http-"), "called"))
    held = calls.join(callee, "callee").withColumn("reason", route).where("reason is not null").select(F.col("caller").alias("node_id"), "reason").distinct()
    test = base.where(F.col("name").rlike(r"^test[_A-Z]|^Test[A-Z_]|^(?:it|describe)$"))
    cols = ["project", "id", "name", "file", "reason"]
    out = alone.select(*cols).unionByName(known.withColumn("reason", F.concat(F.lit("well-known-name:"), "name")).select(*cols))
    return out.unionByName(base.join(held, "node_id").select(*cols)).unionByName(test.withColumn("reason", F.lit("test")).select(*cols)).distinct()


def flow_trees(symbols: DataFrame, calls: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """root, at, path, hop, node, name, truncated of the tree of calls from each root (root: node ids).

    The walk is depth first, callees by number of the call, then id. What was met before in the same walk isn't opened again (cycle), nor is
    what lies at the depth (1 to 10). at numbers the rows of a tree in the order of the walk. Only calls within the depth of a root are
    gathered: one task holds the calls around a root, not all calls.
    """
    depth = max(1, min(10, depth))
    numbered = calls if "n" in calls.columns else calls.withColumn("n", F.lit(0))
    near = reach(calls.select(F.col("caller").alias("from"), F.col("callee").alias("to")), roots, depth).where(F.col("hop") < depth).select("root", F.col("node").alias("caller"))
    names = symbols.select(F.col("node_id").alias("callee"), F.col("name").alias("callee_name"))
    around = near.join(numbered, "caller").join(names, "callee").select("root", "caller", "callee", "n", "callee_name")
    tops = roots.select("root").distinct().join(symbols.select(F.col("node_id").alias("root"), F.col("name").alias("callee_name")), "root")
    every = around.unionByName(tops.select("root", F.lit(None).cast(around.schema["caller"].dataType).alias("caller"), F.col("root").alias("callee"), F.lit(0).alias("n"), "callee_name"))
    kind = symbols.schema["node_id"].dataType.simpleString()

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        root = group["root"].iloc[0]
        names = dict(zip(group["callee"], group["callee_name"], strict=True))
        inner = group[group["caller"].notna()].sort_values(["caller", "n", "callee"])
        nexts: dict = {}
        for caller, callee in zip(inner["caller"], inner["callee"], strict=True):
            nexts.setdefault(type(callee)(caller), []).append(callee)
        rows, seen, stack = [], set(), [(root, (), 0)]
        while stack:
            node, above, hop = stack.pop()
            path = (*above, node)
            why = "cycle" if node in seen else "depth" if hop >= depth else None
            rows.append((root, len(rows), ">".join(map(str, path)), hop, node, names.get(node), why))
            seen.add(node)
            if why is None:
                stack += [(x, path, hop + 1) for x in reversed(nexts.get(node, []))]
        return pd.DataFrame(rows, columns=["root", "at", "path", "hop", "node", "name", "truncated"])

    return every.groupBy("root").applyInPandas(walk, f"root {kind}, at int, path string, hop int, node {kind}, name string, truncated string")


def impact_of(symbols: DataFrame, calls: DataFrame, targets: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """What depends on symbols that targets (target: a name; file: a hint or null) name: rows (target, hop, file), each file at its first
    hop and without the target's own, and one status row for each target: status (found, ambiguous, not_found), matches, files, truncated
    (there are callers beyond the depth of 1 to 10)."""
    depth = max(1, min(10, depth))
    hint = F.col("h.file").isNull() | P.matches_hint(F.col("s.file"), F.col("h.file"))
    asked = targets.select("target", "file").distinct()
    named = asked.alias("h").join(symbols.where("name <> '<module>'").alias("s"), F.col("h.target") == F.col("s.name")).where(hint).select("h.target", "s.node_id", F.col("s.file").alias("own")).distinct()
    matches = named.groupBy("target").agg(F.countDistinct("node_id").alias("matches"), F.min("node_id").alias("root"), F.min("own").alias("own"))
    one = matches.where("matches = 1")
    back = calls.select(F.col("callee").alias("from"), F.col("caller").alias("to"))
    met = reach(back, one.select("root"), depth + 1).where("hop > 0")
    placed = met.join(symbols.select(F.col("node_id").alias("node"), "file"), "node").join(one, "root")
    files = placed.where((F.col("hop") <= depth) & (F.col("file") != F.col("own"))).groupBy("target", "file").agg(F.min("hop").alias("hop")).select("target", "hop", "file")
    beyond = placed.groupBy("target").agg(F.max("hop").alias("far"))
    counted = files.groupBy("target").agg(F.count("*").alias("files"))
    state = F.when(F.col("matches").isNull(), "not_found").when(F.col("matches") > 1, "ambiguous").otherwise("found")
    status = asked.select("target").distinct().join(matches, "target", "left").join(counted, "target", "left").join(beyond, "target", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("matches", "files")}
    return files, status.withColumn("status", state).withColumns(zero).select("target", "status", "matches", "files", F.coalesce(F.col("far") > depth, F.lit(False)).alias("truncated"))


def resolve(sites: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """project, file, name, confidence, targets of every distinct call site.

    The first of these that finds a symbol of the name counts: the same file (local, all matches), the files it depends on (unique or
    multiple-candidates), else unresolved. Both are equi-joins; the second goes over the dependency edges.
    """
    asked = sites.select("project", "file", "name").distinct()
    known = symbols.select("project", "file", "name", "symbol_id").distinct()
    local = asked.join(known, ["project", "file", "name"]).groupBy("project", "file", "name").agg(F.array_sort(F.collect_set("symbol_id")).alias("local"))
    deps = edges.where("dst is not null").select("project", F.col("src").alias("file"), F.col("dst").alias("dep")).distinct()
    near = asked.join(deps, ["project", "file"]).join(known.withColumnRenamed("file", "dep"), ["project", "dep", "name"])
    near = near.groupBy("project", "file", "name").agg(F.array_sort(F.collect_set("symbol_id")).alias("near"))
    both = asked.join(local, ["project", "file", "name"], "left").join(near, ["project", "file", "name"], "left")
    confidence = F.when(F.col("local").isNotNull(), "local").when(F.col("near").isNull(), "unresolved").when(F.size("near") == 1, "unique").otherwise("multiple-candidates")
    targets = F.array_join(F.coalesce("local", "near", F.array().cast("array<string>")), ",")
    return both.select("project", "file", "name", confidence.alias("confidence"), targets.alias("targets"))


def unresolved_share(resolved: DataFrame) -> DataFrame:
    """Percentage of unresolved call sites per project; calls into an engine count on neither side."""
    real = resolved.where("confidence <> 'engine'")
    return real.groupBy("project").agg(F.count("*").alias("sites"), F.round(100 * F.avg(F.when(F.col("confidence") == "unresolved", 1.0).otherwise(0.0)), 4).alias("unresolved_pct"))


def innermost_scope(points: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """For each point (key, line) the scope (key, scope_start, scope_end) that holds it and starts last; the one that ends first wins ties.
    Scopes and points meet in blocks of SPAN lines, so a point isn't compared with all scopes of its file."""
    block = lambda c: F.floor(F.col(c) / SPAN)
    held = scopes.where("scope_start <= scope_end").withColumn("_block", F.explode(F.sequence(block("scope_start"), block("scope_end"))))
    inside = points.withColumn("_block", block("line")).join(held, [key, "_block"]).where("line between scope_start and scope_end")
    best = F.max(F.struct(F.col("scope_start"), (-F.col("scope_end")).alias("neg_end"))).alias("best")
    return inside.groupBy(key, "line").agg(best).select(key, "line", "best.scope_start", (-F.col("best.neg_end")).alias("scope_end"))


def called_names(texts: DataFrame, text_col: str) -> DataFrame:
    """Identifiers before a parenthesis, other than keywords, with how often they occur."""
    names = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)[ \t\n\x0b\f\r]*\("), 1))
    return texts.select(names.alias("name")).where(~F.col("name").isin(*NO_CALLS)).groupBy("name").agg(F.count("*").alias("n"))


def flow_paths(calls: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, path (ids joined by >), hop: all simple paths of calls from each root over at most depth calls."""
    step = calls.select(F.col("caller").alias("tip"), F.col("callee").alias("next"))
    rows = roots.select("root", F.col("root").alias("tip"), F.array("root").alias("path"), F.lit(0).alias("hop"))
    out = rows
    for hop in range(1, depth + 1):
        rows = rows.join(step, "tip").where(~F.array_contains("path", F.col("next"))).select("root", F.col("next").alias("tip"), F.concat("path", F.array("next")).alias("path"), F.lit(hop).alias("hop"))
        out = out.unionByName(rows)
    return out.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hop")
