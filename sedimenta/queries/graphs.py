"""Queries on file graphs, symbols and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import language as L
from sedimenta.functions import paths as P
from sedimenta.operators import calls as K
from sedimenta.operators import graph as G
from sedimenta.operators import imports as I
from sedimenta.operators import resolution as R
from sedimenta.operators import symbols as Y
from sedimenta.operators.declared import declared_symbols
from sedimenta.plans.workspace import Workspace
from sedimenta.sources import tables as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edges(spark, d):
    return G.clean_edges(_t(spark, d, "edges"))


def _symbols(spark, d):
    return Y.symbols_from_flow(_t(spark, d, "flow_nodes"))


def _calls(spark, d):
    return Y.calls_from_flow(_t(spark, d, "flow_nodes"))


def file_dependencies(spark, d):
    return G.dependencies(_edges(spark, d))


def graph_stats(spark, d):
    return G.stats(_edges(spark, d))


def graph_degrees(spark, d):
    return G.degrees(_edges(spark, d))


def graph_top_connected(spark, d):
    return G.top_connected(_edges(spark, d))


def graph_orphans(spark, d):
    """Files of chunks that no link touches."""
    files = _t(spark, d, "chunks").select("project", F.col("rel_path").alias("file")).distinct()
    return files.join(G.nodes(_edges(spark, d).where("dst is not null")), ["project", "file"], "left_anti")


def impact_file(spark, d):
    """What depends, over at most three links, on the most connected file of each project."""
    e = _edges(spark, d)
    targets = G.top_connected(e, 1).select("project", F.col("file").alias("root"))
    return G.impact(e, targets, 3)


def cyclic_files(spark, d):
    return G.strongly_connected(_edges(spark, d)).select("project", "file", "component")


def mermaid(spark, d):
    e = _edges(spark, d)
    return G.mermaid(e, G.strongly_connected(e)).select("project", F.length("diagram").alias("n_chars"), F.size(F.split("diagram", "\n")).alias("n_lines"), F.substring(F.sha2("diagram", 256), 1, 16).alias("hash"))


def viz_symbols_capped(spark, d):
    """Symbols for drawing: at most 200 of a file, by line."""
    order = Window.partitionBy("project", "file").orderBy("line", "node_id")
    ranked = _symbols(spark, d).withColumn("rank", F.row_number().over(order))
    return ranked.where("rank <= 200").select("project", "file", "rank", F.to_json(F.struct("name", "line")).alias("json"))


def name_index(spark, d):
    return Y.name_index(_symbols(spark, d))


def reverse_index(spark, d):
    return Y.reverse_index(_calls(spark, d))


def symbol_context(spark, d):
    return Y.context(_symbols(spark, d), _calls(spark, d))


def symbol_callers(spark, d):
    """Each caller of each symbol with the caller's place."""
    caller = _symbols(spark, d).select(F.col("node_id").alias("caller"), F.col("name").alias("caller_name"), "file", "line")
    return _calls(spark, d).join(caller, "caller").select("callee", "caller", "caller_name", "file", "line")


def list_symbols(spark, d):
    return Y.find(_symbols(spark, d), "FLUSH").select("node_id", "name", "file", "line")


def entry_points(spark, d):
    return Y.entry_points(_symbols(spark, d), _calls(spark, d), _edges(spark, d))


def impact_symbol(spark, d):
    """Callers over at most three calls of every symbol whose id is divisible by 50."""
    calls = _calls(spark, d)
    roots = _symbols(spark, d).where("node_id % 50 = 0").select(F.col("node_id").alias("root"))
    return G.reach(calls.select(F.col("callee").alias("from"), F.col("caller").alias("to")), roots, 3).where("hop > 0").select("root", "node", "hop")


def call_flow(spark, d):
    """All symbols that those with an id divisible by 50 call, over at most five calls, with their first distance."""
    roots = _symbols(spark, d).where("node_id % 50 = 0").select(F.col("node_id").alias("root"))
    return G.reach(_calls(spark, d).select(F.col("caller").alias("from"), F.col("callee").alias("to")), roots, 5).select("root", "node", "hop")


def flow_paths(spark, d):
    roots = _symbols(spark, d).where("node_id % 50 = 0").select(F.col("node_id").alias("root"))
    return Y.flow_paths(_calls(spark, d), roots, 5)


def _sites(spark, d):
    """Calls whose target is known by name only."""
    s = _symbols(spark, d)
    caller, callee = s.select(F.col("node_id").alias("caller"), "project", "file"), s.select(F.col("node_id").alias("callee"), "name")
    return _calls(spark, d).join(caller, "caller").join(callee, "callee").select("project", "file", "name")


def resolve_calls(spark, d):
    return Y.resolve(_sites(spark, d), _symbols(spark, d), _edges(spark, d))


def unresolved_pct(spark, d):
    return Y.unresolved_share(resolve_calls(spark, d))


def scope_range_join(spark, d):
    """The innermost chunk around every line of a file."""
    c = _t(spark, d, "chunks").select(F.concat_ws(":", "project", "rel_path").alias("file"), F.col("start_line").alias("scope_start"), F.col("end_line").alias("scope_end")).distinct()
    points = c.groupBy("file").agg(F.max("scope_end").alias("n")).select("file", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("line"))
    return Y.innermost_scope(points, c, "file")


def longest_prefix_join(spark, d):
    """The nearest package of each file: of the folders that hold a manifest, the deepest above it."""
    files = _t(spark, d, "chunks").select("project", "rel_path").distinct()
    manifests = files.where(F.col("rel_path").rlike(r"(?:^|/)(?:package-lock\.json|[^/]*\.ya?ml)$")).select("project", P.folder(F.col("rel_path")).alias("folder")).distinct()
    return I.nearest(files, manifests)


def extract_imports(spark, d):
    return I.extract(_t(spark, d, "chunks")).select("chunk_id", "language", "specifier", "kind", "n")


def resolve_relative(spark, d):
    """Relative imports of chunks by the file they name, the first existing of the candidates."""
    c = _t(spark, d, "chunks")
    return I.resolve_relative(I.extract(c), S.files_from_chunks(c))


def import_resolution(spark, d):
    c = _t(spark, d, "chunks")
    found = I.resolve_relative(I.extract(c), S.files_from_chunks(c))
    return found.groupBy("project").agg(F.count("*").alias("imports"), F.count("target").alias("resolved"), ((F.count("*") >= 20) & (F.count("target") < 0.02 * F.count("*"))).alias("low_resolution"))


def module_targets(spark, d):
    """Imports of python, java, rust and lua by module name."""
    c = _t(spark, d, "chunks")
    return I.resolve_modules(I.extract(c), S.files_from_chunks(c))


def import_edges(spark, d):
    c = _t(spark, d, "chunks")
    found = I.resolve_relative(I.extract(c), S.files_from_chunks(c)).where("target is not null")
    return found.select("project", F.col("rel_path").alias("src"), F.col("target").alias("dst"), "kind").distinct()


def import_targets(spark, d):
    """The file that each import of a chunk's file names, in any language."""
    c = _t(spark, d, "chunks")
    return R.resolve_all(I.extract(c), S.files_from_chunks(c, content=True))


def call_sites(spark, d):
    """Calls of all files with the symbol they stand in."""
    return K.call_sites(S.files_from_chunks(_t(spark, d, "chunks"), content=True)).select("project", "file", "caller", "callee", "line", "source_module")


def resolved_sites(spark, d):
    """How many calls of each language are resolved how."""
    c = _t(spark, d, "chunks")
    ws = Workspace(spark, "sites")
    files = ws.write(S.files_from_chunks(c, content=True), "files")
    targets = R.resolve_all(I.extract(c), files).where("target is not null")
    edges = targets.select("project", F.col("rel_path").alias("file"), F.col("target").alias("dep")).distinct()
    modules = targets.select("project", F.col("rel_path").alias("file"), F.col("specifier").alias("source_module"), "target").distinct()
    done = K.resolve_sites(K.call_sites(files), K.symbols_of(files), edges, modules, K.reexports_of(files))
    return done.groupBy("language", "confidence").agg(F.count("*").alias("n"))


def flow_trees(spark, d):
    """The tree of calls from each symbol whose id is divisible by 50, with what ends its branches."""
    roots = _symbols(spark, d).where("node_id % 50 = 0").select(F.col("node_id").alias("root"))
    return Y.flow_trees(_symbols(spark, d), _calls(spark, d), roots)


def impact_names(spark, d):
    """The status of every symbol's name as a target of an impact query."""
    s = _symbols(spark, d)
    return Y.impact_of(s, _calls(spark, d), s.where("node_id % 50 = 0").select(F.col("name").alias("target"), F.lit(None).cast("string").alias("file")))[1]


def extract_symbols(spark, d):
    return declared_symbols(S.files_from_chunks(_t(spark, d, "chunks"), content=True)).select("project", "file", "name", "qualified_name", "kind", "line", "end_line")


def fallback_calls(spark, d):
    return Y.called_names(_t(spark, d, "documents"), "text")


def edge_languages(spark, d):
    """Links between languages of files."""
    e = _edges(spark, d).where("dst is not null")
    return e.groupBy(L.language_of(F.col("src")).alias("src_language"), L.language_of(F.col("dst")).alias("dst_language"), "type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    file_dependencies, graph_stats, graph_degrees, graph_top_connected, graph_orphans, impact_file, cyclic_files, mermaid, viz_symbols_capped, name_index, reverse_index, symbol_context, symbol_callers, list_symbols,
    entry_points, impact_symbol, call_flow, flow_paths, resolve_calls, unresolved_pct, scope_range_join, longest_prefix_join, extract_imports, resolve_relative, import_resolution, module_targets, import_edges,
    import_targets, call_sites, resolved_sites, flow_trees, impact_names, extract_symbols, fallback_calls, edge_languages,
)}

_E = r"""e AS (SELECT DISTINCT project, regexp_replace(replace(src, '\', '/'), '^(\./)+', '') AS src, regexp_replace(replace(dst, '\', '/'), '^(\./)+', '') AS dst, type FROM edges WHERE src IS NOT NULL),
  r AS (SELECT * FROM e WHERE dst IS NOT NULL)"""
_DEG = _E + """, g AS (SELECT project, file, sum(o) AS imports, sum(i) AS imported_by FROM (SELECT project, src AS file, 1 AS o, 0 AS i FROM r UNION ALL SELECT project, dst, 0, 1 FROM r) GROUP BY ALL)"""
_S = """s AS (SELECT node_id, min(project) AS project, min(symbol_id) AS symbol_id, min(symbol_name) AS name, min(file) AS file, min(line_no) AS line FROM flow_nodes GROUP BY node_id),
  c AS (SELECT DISTINCT node_id AS caller, callee FROM (SELECT node_id, unnest(children) AS callee FROM flow_nodes) WHERE callee IN (SELECT node_id FROM flow_nodes))"""
_RESOLVE = f"""{_E}, {_S}, site AS (SELECT DISTINCT a.project, a.file, b.name FROM c JOIN s a ON a.node_id = c.caller JOIN s b ON b.node_id = c.callee),
  k AS (SELECT DISTINCT project, file, name, symbol_id FROM s),
  loc AS (SELECT t.project, t.file, t.name, string_agg(DISTINCT symbol_id, ',' ORDER BY symbol_id) AS ids FROM site t JOIN k USING (project, file, name) GROUP BY ALL),
  near AS (SELECT t.project, t.file, t.name, count(DISTINCT symbol_id) AS n, string_agg(DISTINCT symbol_id, ',' ORDER BY symbol_id) AS ids FROM site t JOIN r ON r.project = t.project AND r.src = t.file
    JOIN k ON k.project = t.project AND k.file = r.dst AND k.name = t.name GROUP BY ALL),
  res AS (SELECT t.project, t.file, t.name, CASE WHEN loc.ids IS NOT NULL THEN 'local' WHEN near.ids IS NULL THEN 'unresolved' WHEN n = 1 THEN 'unique' ELSE 'multiple-candidates' END AS confidence,
    coalesce(loc.ids, near.ids, '') AS targets FROM site t LEFT JOIN loc USING (project, file, name) LEFT JOIN near USING (project, file, name))"""
_EXT = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+?(\\.[^.]+)$', 1))"
_LANG = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.LANGUAGES.items()) + ")"


def _reach(start: str, frm: str, to: str, depth: int) -> str:
    return f"""w AS (SELECT node_id AS root, node_id AS node, 0 AS hop FROM s WHERE {start} UNION SELECT w.root, c.{to}, w.hop + 1 FROM w JOIN c ON c.{frm} = w.node WHERE w.hop < {depth}),
      first AS (SELECT root, node, min(hop) AS hop FROM w GROUP BY ALL)"""


SQL = {
    "file_dependencies": f"WITH {_E}, x AS (SELECT DISTINCT project, src, dst FROM r) SELECT project, src AS file, 'imports' AS direction, dst AS other FROM x UNION ALL SELECT project, dst, 'imported by', src FROM x",
    "graph_stats": f"""WITH {_E}, n AS (SELECT project, count(*) AS files FROM (SELECT project, src FROM e UNION SELECT project, dst FROM r) GROUP BY project), m AS (SELECT project, count(dst) AS links, count(*) AS declared FROM e GROUP BY project)
        SELECT project, files, links, round(links / files, 6) AS avg_links, declared - links AS unresolved, round(100.0 * (declared - links) / declared, 4) AS unresolved_pct, declared >= 20 AND links < 0.02 * declared AS low_resolution FROM n JOIN m USING (project)""",
    "graph_degrees": f"WITH {_DEG} SELECT project, file, imports, imported_by FROM g",
    "graph_top_connected": f"WITH {_DEG}, t AS (SELECT project, file, imports + imported_by AS links, row_number() OVER (PARTITION BY project ORDER BY imports + imported_by DESC, encode(file)) AS rank FROM g) SELECT * FROM t WHERE rank <= 10",
    "graph_orphans": f"WITH {_E} SELECT DISTINCT project, rel_path AS file FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.project = c.project AND (r.src = c.rel_path OR r.dst = c.rel_path))",
    "impact_file": f"""WITH RECURSIVE {_DEG}, t AS (SELECT project, file, row_number() OVER (PARTITION BY project ORDER BY imports + imported_by DESC, encode(file)) AS rank FROM g),
        w AS (SELECT project, file AS root, file AS node, 0 AS hop FROM t WHERE rank = 1 UNION SELECT w.project, w.root, r.src, w.hop + 1 FROM w JOIN r ON r.project = w.project AND r.dst = w.node WHERE w.hop < 3)
        SELECT project, root, node, min(hop) AS hop FROM w GROUP BY ALL HAVING min(hop) > 0""",
    "cyclic_files": f"""WITH RECURSIVE {_E}, l AS (SELECT DISTINCT project, src, dst FROM r), w AS (SELECT project, src AS a, dst AS b FROM l UNION SELECT w.project, w.a, l.dst FROM w JOIN l ON l.project = w.project AND l.src = w.b)
        SELECT x.project, x.a AS file, min(x.b) AS component FROM w x JOIN w y ON y.project = x.project AND y.a = x.b AND y.b = x.a GROUP BY x.project, x.a""",
    "name_index": f"WITH {_S}, d AS (SELECT DISTINCT project, name, symbol_id FROM s WHERE name <> '<module>') SELECT *, count(*) OVER (PARTITION BY project, name) AS n FROM d",
    "reverse_index": f"WITH {_S} SELECT callee, caller, count(*) OVER (PARTITION BY callee) AS n FROM c",
    "symbol_context": f"""WITH {_S}, a AS (SELECT callee AS node_id, count(*) AS n, string_agg(caller, ',' ORDER BY caller) FILTER (rn <= 30) AS l FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS rn FROM c) GROUP BY callee),
        b AS (SELECT caller AS node_id, count(*) AS n, string_agg(callee, ',' ORDER BY callee) FILTER (rn <= 30) AS l FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY callee) AS rn FROM c) GROUP BY caller)
        SELECT s.node_id, project, name, file, line, coalesce(a.n, 0) AS n_callers, coalesce(a.l, '') AS callers, coalesce(b.n, 0) AS n_callees, coalesce(b.l, '') AS callees FROM s LEFT JOIN a USING (node_id) LEFT JOIN b USING (node_id)""",
    "symbol_callers": f"WITH {_S} SELECT callee, caller, name AS caller_name, file, line FROM c JOIN s ON s.node_id = c.caller",
    "list_symbols": f"WITH {_S} SELECT node_id, name, file, line FROM s WHERE contains(lower(name), 'flush') AND name <> '<module>' ORDER BY encode(name), encode(file), line, node_id LIMIT 200",
    "entry_points": f"""WITH {_E}, {_S}, busy AS (SELECT DISTINCT s.project, s.file FROM c JOIN s ON s.node_id = c.caller),
        l AS (SELECT *, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM s WHERE name <> '<module>')
        SELECT project, file AS id, file AS name, file, 'orphan' AS reason FROM busy b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.project = b.project AND r.dst = b.file)
        UNION SELECT project, node_id::VARCHAR, name, file, 'well-known-name:' || name FROM l
          WHERE name = 'main' AND ext IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx', 'mts', 'cts', 'py', 'pyw', 'pyi', 'go', 'rs', 'java', 'kt', 'kts', 'scala', 'c', 'h', 'cpp', 'hpp', 'cc', 'hh', 'cxx', 'swift', 'rb', 'php', 'dart') OR name = 'Main' AND ext = 'cs'
        UNION SELECT l.project, l.node_id::VARCHAR, l.name, l.file, CASE WHEN lower(k.name) = 'route' THEN 'framework:route' ELSE 'framework:http-' || lower(k.name) END FROM c JOIN l ON l.node_id = c.caller JOIN s k ON k.node_id = c.callee
          WHERE lower(k.name) IN ('get', 'post', 'put', 'delete', 'patch', 'head', 'options', 'all', 'use', 'route')
        UNION SELECT project, node_id::VARCHAR, name, file, 'test' FROM l WHERE regexp_matches(name, '^test[_A-Z]|^Test[A-Z_]|^(?:it|describe)$')""",
    "impact_symbol": f"WITH RECURSIVE {_S}, {_reach('node_id % 50 = 0', 'callee', 'caller', 3)} SELECT root, node, hop FROM first WHERE hop > 0",
    "call_flow": f"WITH RECURSIVE {_S}, {_reach('node_id % 50 = 0', 'caller', 'callee', 5)} SELECT root, node, hop FROM first",
    "impact_names": f"""WITH RECURSIVE {_S}, t AS (SELECT DISTINCT name AS target FROM s WHERE node_id % 50 = 0), m AS (SELECT target, count(DISTINCT node_id) AS matches, min(node_id) AS root, min(file) AS own FROM t JOIN s ON s.name = target WHERE name <> '<module>' GROUP BY target),
        w AS (SELECT target, own, root AS node, 0 AS hop FROM m WHERE matches = 1 UNION SELECT w.target, w.own, c.caller, w.hop + 1 FROM w JOIN c ON c.callee = w.node WHERE w.hop < 4), g AS (SELECT target, own, node, min(hop) AS hop FROM w GROUP BY ALL),
        f AS (SELECT target, count(DISTINCT file) FILTER (hop BETWEEN 1 AND 3 AND file <> own) AS files, max(hop) > 3 AS truncated FROM g JOIN s ON s.node_id = g.node GROUP BY target)
        SELECT t.target, CASE WHEN matches IS NULL THEN 'not_found' WHEN matches > 1 THEN 'ambiguous' ELSE 'found' END AS status, coalesce(matches, 0) AS matches, coalesce(files, 0) AS files, coalesce(truncated, false) AS truncated FROM t LEFT JOIN m USING (target) LEFT JOIN f USING (target)""",
    "flow_paths": f"""WITH RECURSIVE {_S}, w AS (SELECT node_id AS root, node_id AS tip, [node_id] AS p, 0 AS hop FROM s WHERE node_id % 50 = 0
        UNION ALL SELECT w.root, c.callee, list_append(w.p, c.callee), w.hop + 1 FROM w JOIN c ON c.caller = w.tip WHERE w.hop < 5 AND NOT list_contains(w.p, c.callee)) SELECT root, array_to_string(p, '>') AS path, hop FROM w""",
    "resolve_calls": f"WITH {_RESOLVE} SELECT * FROM res",
    "unresolved_pct": f"WITH {_RESOLVE} SELECT project, count(*) AS sites, round(100 * avg(CASE WHEN confidence = 'unresolved' THEN 1.0 ELSE 0.0 END), 4) AS unresolved_pct FROM res GROUP BY project",
    "scope_range_join": """WITH c AS (SELECT DISTINCT project || ':' || rel_path AS file, start_line AS a, end_line AS b FROM chunks), p AS (SELECT file, unnest(range(1, greatest(max(b), 1) + 1)) AS line FROM c GROUP BY file),
        j AS (SELECT p.file, line, a, b, row_number() OVER (PARTITION BY p.file, line ORDER BY a DESC, b) AS rn FROM p JOIN c ON c.file = p.file AND line BETWEEN a AND b) SELECT file, line, a AS scope_start, b AS scope_end FROM j WHERE rn = 1""",
    "longest_prefix_join": """WITH f AS (SELECT DISTINCT project, rel_path FROM chunks), m AS (SELECT DISTINCT project, CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS folder FROM f
          WHERE regexp_matches(rel_path, '(?:^|/)(?:package-lock\\.json|[^/]*\\.ya?ml)$')),
        j AS (SELECT f.project, rel_path, folder, row_number() OVER (PARTITION BY f.project, rel_path ORDER BY length(folder) DESC) AS rn FROM f JOIN m ON m.project = f.project AND (folder = '' OR starts_with(rel_path, folder || '/')))
        SELECT f.project, f.rel_path, folder FROM f LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (project, rel_path)""",
    "fallback_calls": """SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)[ \\t\\n\\x0b\\f\\r]*\\(', 1)) AS name FROM documents)
        WHERE name NOT IN ('if', 'for', 'while', 'switch', 'return', 'function', 'def', 'fn', 'func', 'class', 'new') GROUP BY name""",
    "edge_languages": f"WITH {_E} SELECT coalesce(a.l, 'plaintext') AS src_language, coalesce(b.l, 'plaintext') AS dst_language, type, count(*) AS n FROM r LEFT JOIN {_LANG} a(x, l) ON a.x = {_EXT.format('src')} LEFT JOIN {_LANG} b(x, l) ON b.x = {_EXT.format('dst')} GROUP BY ALL",
}
