import random

from pyspark.sql import functions as F

from sedimenta.operators import calls, imports, resolution, symbols

FILES = "project string, rel_path string, language string, content string"


def test_rings_of_reexports_end_and_hide_what_is_not_exported(spark):
    rows = [("p", "a.ts", "typescript", "export * from './b';\nexport function own() {\n}\n"), ("p", "b.ts", "typescript", "export * from './a';\nexport { deep as shown } from './c';\n"), ("p", "c.ts", "typescript", "export function deep() {\n}\nfunction secret() {\n}\n"), (None, "n.ts", None, None), ("p", "e.py", "python", "def (:\n")]
    files = spark.createDataFrame(rows, FILES)
    again = calls.reexports_of(files).withColumn("target", F.concat(F.regexp_extract("source_module", r"(\w)$", 1), F.lit(".ts")))
    asked = spark.createDataFrame([("p", f, n) for f in ("a.ts", "b.ts") for n in ("own", "shown", "deep", "secret", "default")], "project string, file string, name string")
    got = {(r.file, r.name, r.symbol_id) for r in calls.exported_search(asked, calls.symbols_of(files), again).collect()}
    assert got == {(f, "own", "a.ts::own#2") for f in ("a.ts", "b.ts")} | {(f, "shown", "c.ts::deep#1") for f in ("a.ts", "b.ts")}
    assert calls.call_sites(files).count() == 0 and calls.symbols_of(files).where("name = '<module>'").count() == 5


def test_calls_of_many_languages(spark):
    rows = [
        ("p", "a.rb", "ruby", "class A\n  def go(x)\n    work(x) # no(1)\n  end\nend\n"), ("p", "a.sh", "shell", "run() {\n  build one\n}\nrun && build two\n"), ("p", "a.rs", "rust", 'fn f() {\n    g(); println!("h()"); a::b(1);\n}\n'),
        ("p", "A.java", "java", "class A {\n    void f() {\n        new B(1); g(/* h() */ 2);\n    }\n}\n"), ("p", "a.c", "c", "int f(int x) {\n  if (x) return g(x);\n}\n"), ("p", "a.lua", "lua", "local function f()\n  g()\nend\n"),
    ]
    got = {(r.file, r.caller.split("::")[1].split("#")[0], r.callee) for r in calls.call_sites(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {("a.rb", "A.go", "work"), ("a.sh", "run", "build"), ("a.sh", "<module>", "run"), ("a.sh", "<module>", "build"), ("a.rs", "f", "g"), ("a.rs", "f", "println"), ("a.rs", "f", "b"), ("A.java", "A.f", "B"), ("A.java", "A.f", "g"), ("a.c", "f", "g"), ("a.lua", "f", "g")}


def test_resolution_without_files_or_imports(spark):
    files = spark.createDataFrame([], FILES)
    asked = spark.createDataFrame([("p", "a.py", "python", "x", "import"), ("p", "b", None, "y", "import"), (None, None, None, None, None)], "project string, rel_path string, language string, specifier string, kind string")
    assert {(r.specifier, r.target) for r in resolution.resolve_all(asked, files).collect()} == {("x", None), ("y", None)}
    assert resolution.resolve_all(asked.where("false"), files).count() == 0
    assert imports.extract(files.selectExpr("'1' as chunk_id", "*")).count() == 0


def test_flow_trees_against_recursion(spark):
    r = random.Random(3)
    links = sorted({(r.randrange(12), r.randrange(12)) for _ in range(24)})
    nodes = spark.createDataFrame([(i, f"s{i}") for i in range(12)], "node_id long, name string")
    got = {}
    for x in symbols.flow_trees(nodes, spark.createDataFrame(links, "caller long, callee long"), spark.createDataFrame([(0,), (5,), (99,)], "root long"), 3).collect():
        got.setdefault(x.root, []).append((x["at"], x.path, x.truncated))

    def walk(node, path, hop, seen, out):
        why = "cycle" if node in seen else "depth" if hop >= 3 else None
        out.append((len(out), ">".join(map(str, path)), why))
        seen.add(node)
        if why is None:
            for _, y in [x for x in links if x[0] == node]:
                walk(y, [*path, y], hop + 1, seen, out)
        return out

    assert {k: sorted(v) for k, v in got.items()} == {k: walk(k, [k], 0, set(), []) for k in (0, 5)}


def test_impact_states(spark):
    rows = [(1, "a", "f1"), (2, "b", "f2"), (3, "b", "f3"), (4, "c", "f1"), (5, "d", "x/f4"), (6, "e", "f5")]
    s = spark.createDataFrame(rows, "node_id long, name string, file string")
    c = spark.createDataFrame([(4, 1), (5, 1), (2, 5), (6, 2)], "caller long, callee long")
    targets = spark.createDataFrame([("a", None), ("b", None), ("zzz", None), ("d", "f4"), ("c", "other")], "target string, file string")
    files, status = symbols.impact_of(s, c, targets, 2)
    assert {tuple(r) for r in files.collect()} == {("a", 1, "x/f4"), ("a", 2, "f2"), ("d", 1, "f2"), ("d", 2, "f5")}
    assert {(r.target, r.status, r.files, r.truncated) for r in status.collect()} == {("a", "found", 2, True), ("b", "ambiguous", 0, False), ("zzz", "not_found", 0, False), ("d", "found", 2, False), ("c", "not_found", 0, False)}
