import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta import sqlapi
from sedimenta.functions import language, paths, text
from sedimenta.operators import chunking, components, graph, imports, maintenance, search, symbols
from sedimenta.operators.declared import pattern_symbols, python_symbols
from sedimenta.operators.vector_index import VectorIndex
from sedimenta.sources.tables import scan_tree
from sedimenta.streaming import changes


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_paths(spark):
    for raw, want in (("a/./b/../c", "a/c"), ("../x", "../x"), ("a/../../x", "../x"), ("", ""), ("a//b", "a/b"), ("..", "..")):
        assert one(spark, paths.normalized(F.col("p")), p=raw) == want, raw
    assert one(spark, paths.extension(F.col("p")), p="a/B.TSX") == ".tsx" and one(spark, paths.extension(F.col("p")), p="a/.env") == ""
    assert [one(spark, paths.looks_like_path(F.col("p")), p=x) for x in ("a/b", "Auth.login", "name", "x.toolong")] == [True, True, False, False]
    assert one(spark, paths.prefixes(F.col("p")), p="a/b/c.x") == ["", "a", "a/b"]


def test_texts(spark):
    assert one(spark, text.lines(F.col("t")), t="") == [""] and one(spark, F.size(text.lines(F.col("t"))), t="a\n") == 2
    order = ["1.2.3-alpha", "1.2.3", "1.2.10", "v2.0.0"]
    keys = [one(spark, text.version_key(F.col("t")), t=x) for x in order]
    assert keys == sorted(keys) and one(spark, text.version_key(F.col("t")), t="x") is None
    assert one(spark, text.branch_suffix(F.col("t")), t="/feature/a b/") == "feature_a_b"
    assert one(spark, text.html_escape(F.col("t")), t="<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"


def test_sniffing(spark):
    cases = {"#!/usr/bin/env -S python3.11\n": ".py", "#!/bin/bash\n": ".sh", "#!/usr/bin/perl\n": ".txt", "import os\n\ndef f(x):\n  pass\n": ".py", "if [ -n x ]; then\n  y\nfi\n": ".sh", "hello": None, "a\0b": None}
    assert {k: one(spark, language.sniffed_extension(F.col("t")), t=k) for k in cases} == cases


def test_line_windows(spark):
    for n in (1, 10, 11, 18, 19, 100):
        rows = spark.createDataFrame([(n, "\n".join(map(str, range(1, n + 1)))), (n, None), (n, " \n ")], "k int, content string")
        got = sorted((r.start_line, r.end_line, r.chunk) for r in chunking.line_windows(rows, size=10, overlap=2).collect())
        assert len(got) == (1 if n <= 10 else -(-(n - 2) // 8)) and got[0][0] == 1 and got[-1][1] == n
        for a, b, c in got:
            assert c == "\n".join(map(str, range(a, b + 1)))


def test_split_chars():
    r = random.Random(1)
    for most in (1, 2, 5, 40):
        for _ in range(200):
            t = "".join(r.choice("ab\r\n 😀") for _ in range(r.randrange(90)))
            pieces = chunking.split_chars(t, most, "\n ")
            assert "".join(pieces) == t and all(len(p) <= most + 1 for p in pieces)
            assert not any(p.endswith("\r") and q.startswith("\n") for p, q in zip(pieces, pieces[1:])) or most == 1


def test_merge_regions(spark):
    rows = spark.createDataFrame([("f", 1, 5), ("f", 5, 7), ("f", 2, 3), ("f", 9, 10), ("g", 1, 2)], "k string, start_line int, end_line int")
    assert sorted(map(tuple, chunking.merge_regions(rows, ["k"]).collect())) == [("f", 1, 7), ("f", 9, 10), ("g", 1, 2)]


def test_components_against_union_find(spark):
    r = random.Random(5)
    pairs = [(f"n{r.randrange(120):03}", f"n{r.randrange(120):03}") for _ in range(90)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(pairs + [(None, "x")], "a string, b string")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_strongly_connected(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("x", "a"), ("e", "y"), ("c", "f"), ("f", "c")]
    edges = spark.createDataFrame([("p", a, b, "import") for a, b in e] + [("q", "a", "b", "import"), ("p", "z", None, "import")], "project string, src string, dst string, type string")
    got = {(r.project, r.file, r.component) for r in graph.strongly_connected(edges).collect()}
    assert got == {("p", x, "a") for x in "abcf"} | {("p", x, "d") for x in "de"} | {("p", "s", "s")}
    assert graph.strongly_connected(edges.where("project = 'q'")).count() == 0


def test_long_cycles(spark):
    r = random.Random(6)
    ring = [f"r{i:04}" for i in range(1000)]
    r.shuffle(ring)
    links = list(zip(ring, ring[1:] + ring[:1])) + [("a", ring[0]), (ring[5], "z"), ("s", "s"), ("s", "t"), ("t", "u"), ("u", "s"), ("u", "w"), ("w", "x"), ("x", "w"), ("x", "x")]
    edges = spark.createDataFrame([("p", a, b, "import") for a, b in links], "project string, src string, dst string, type string")
    got = {r.file: r.component for r in graph.strongly_connected(edges).collect()}
    assert got == {x: "r0000" for x in ring} | {x: "s" for x in "stu"} | {x: "w" for x in "wx"}
    with pytest.raises(RuntimeError):
        graph.strongly_connected(edges, 2)


def test_cycles_against_reachability(spark):
    r = random.Random(8)
    links = {(f"{k:02}", f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for k in range(12) for _ in range(30 + 3 * k)}
    reach = set(links)
    while more := {(k, a, d) for k, a, b in reach for q, c, d in links if k == q and b == c} - reach:
        reach |= more
    both = {(k, a, b) for k, a, b in reach if (k, b, a) in reach}
    wanted = {(k, a): min(c for q, b, c in both if (q, b) == (k, a)) for k, a, _ in both}
    edges = spark.createDataFrame([(*x, "import") for x in links], "project string, src string, dst string, type string")
    assert {(x.project, x.file): x.component for x in graph.strongly_connected(edges).collect()} == wanted


def test_cycles_in_one_task_and_by_rounds_agree(spark):
    r = random.Random(5)
    rows = [(f"p{k}" if k else None, f"{r.randint(0, 30):03}", f"{r.randint(0, 30):03}", "import") for k in range(4) for _ in range(45)]
    rows += [("ring", f"{i:04}", f"{(i + 1) % 2000:04}", "import") for i in range(2000)]
    edges = spark.createDataFrame(rows, "project string, src string, dst string, type string")
    found = [{(x.project, x.file, x.component) for x in graph.strongly_connected(edges, local_links=n).collect()} for n in (500_000, 1000, 0)]
    assert found[0] == found[1] == found[2] and {(p, c) for p, _, c in found[0] if p == "ring"} == {("ring", "0000")} and sum(p == "ring" for p, _, _ in found[0]) == 2000


def test_reach_and_impact(spark):
    edges = spark.createDataFrame([("p", "b", "a", "import"), ("p", "c", "b", "import"), ("p", "a", "c", "import"), ("p", "d", "c", "import"), ("p", "d", "c", "import")], "project string, src string, dst string, type string")
    got = {(r.node, r.hop) for r in graph.impact(edges, spark.createDataFrame([("p", "a")], "project string, root string"), 2).collect()}
    assert got == {("b", 1), ("c", 2)}


def test_search_operators(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, None), (4, ""), (5, "gamma")], "id long, text string")
    q = spark.createDataFrame([(0, "BETA alpha alpha"), (9, "zzz")], "qid long, text string")
    hits = search.top_k(search.bm25(docs, q, "id", "text"), ["query"], 2).collect()
    assert [(h.query, h.id) for h in sorted(hits, key=lambda h: h["rank"])] == [(0, 1), (0, 2)]
    r = np.random.default_rng(1)
    v = r.normal(size=(57, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(57)] + [(100, [0.0] * 8), (101, [1.0]), (102, None), (103, [float(x) for x in v[0]])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.where("id in (0, 5)").withColumnRenamed("id", "qid")
    got = search.dense_top_k(vectors, asked, 5, block=10).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = sorted(range(57), key=lambda i: (-round(float(u[5] @ u[i]), 6), i))[:5]
    assert [h.id for h in sorted((h for h in got if h.query == 5), key=lambda h: h["rank"])] == want
    assert [h.id for h in sorted((h for h in got if h.query == 0), key=lambda h: h["rank"])][:2] == [0, 103]


def test_bm25_top_k_equals_all_scores(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randint(0, 30))), i % 3) for i in range(400)] + [(1000, None, 0), (None, "w1 w2", 0), (1001, "İ w1,W2\tw3", 0)]
    docs = spark.createDataFrame(rows, "id long, text string, score int").repartition(5)
    asked = docs.where("id % 40 = 0").select(F.col("id").cast("string").alias("qid"), "text").union(spark.createDataFrame([("none", "zzz"), ("empty", "")], "qid string, text string"))
    want = search.top_k(search.bm25(docs.where("id is not null"), asked, "id", "text"), ["query"], 7)
    key = lambda df: sorted((h.query, h["rank"], h.id, round(h.score, 6)) for h in df.collect())
    for block in (3, 1000):
        assert key(search.bm25_top_k(docs, asked, "id", "text", 7, block=block)) == key(want)
    few = search.top_k(search.bm25(docs.where("id is not null"), asked, "id", "text").join(docs.where("score = 1").select("id"), "id"), ["query"], 7)
    assert key(search.bm25_top_k(docs, asked, "id", "text", 7, keep=F.col("score") == 1)) == key(few)
    assert search.bm25_top_k(docs.where("false"), asked, "id", "text", 7).count() == 0 and search.bm25_top_k(docs, asked.where("false"), "id", "text", 7).count() == 0


def test_vector_index(spark):
    r = np.random.default_rng(2)
    middles = r.normal(size=(30, 16))
    rows = [(f"v{i}", [float(x) for x in (middles[i % 30] + 0.3 * r.normal(size=16) if i < 2500 else r.normal(size=16))]) for i in range(3000)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 16), ("empty", [])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(6)
    asked = vectors.where("id like 'v%50' or id in ('null', 'zero')").withColumnRenamed("id", "qid")
    want = {(h.query, h.id) for h in search.dense_top_k(vectors, asked, 10).collect()}
    index = VectorIndex(vectors, sample=1500)
    got = index.search(asked, 10).collect()
    assert len({(h.query, h.id) for h in got} & want) >= 0.9 * len(want) and index.table.count() == 3000 and index.probes < len(index.centres)
    assert max(h["rank"] for h in got) == 10 and all(h.score > 0.999 for h in got if h.query == h.id)
    assert VectorIndex(vectors.where("false")).search(asked).count() == 0


def test_merges(spark):
    hits = spark.createDataFrame([(1, "x", 1, 7, 10, 0.9), (1, "x", 2, 7, 11, 0.5), (1, "y", 1, 7, 12, None), (2, "x", 1, 8, 13, 0.4)], "query int, label string, rank int, key int, id long, score double")
    assert {(r.query, r.label): round(r.score, 6) for r in search.rrf_merge(hits).collect()} == {(1, "x"): round(1 / 61 + 1 / 62, 6), (1, "y"): round(1 / 61, 6), (2, "x"): round(1 / 61, 6)}
    assert {(r.query, r.id) for r in search.cosine_merge(hits).collect()} == {(2, 13)}


def test_imports(spark):
    chunks = spark.createDataFrame(
        [("1", "p", "src/a.ts", 'import { x } from "./b";\nimport y from "pkg";\nexport * from "../c/index";\nconst z = import("./d.js");', None), ("2", "p", "m/x.py", "from . import q\nfrom .y import z\nimport os, json", "python"), ("3", "p", "e", None, None)],
        "chunk_id string, project string, rel_path string, content string, language string",
    )
    files = spark.createDataFrame([("p", f) for f in ("src/b/index.ts", "c/index.js", "src/d.ts", "m/y.py", "m/__init__.py")], "project string, rel_path string")
    found = imports.extract(chunks)
    assert {(r.specifier, r.kind) for r in found.where("chunk_id = '1'").collect()} == {("./b", "import"), ("pkg", "import"), ("../c/index", "re-export"), ("./d.js", "dynamic-import")}
    assert {(r.specifier, r.target) for r in imports.resolve_relative(found, files).collect()} == {("./b", "src/b/index.ts"), ("../c/index", "c/index.js"), ("./d.js", "src/d.ts")}
    assert {(r.specifier, r.target) for r in imports.resolve_modules(found, files).collect()} >= {(".y", "m/y.py"), ("os", None)}


def test_python_import_lists(spark):
    text = "import a, b.c as d, e,f\nfrom g import h, i\nimport j as k\nif x:\n    import l, m, n\n"
    chunks = spark.createDataFrame([("1", "p", "a.py", text, "python")], "chunk_id string, project string, rel_path string, content string, language string")
    assert {(r.specifier, r.n) for r in imports.extract(chunks).collect()} == {(x, 1) for x in ("a", "b.c", "e", "f", "g", "j", "l", "m", "n")}


def test_symbols():
    source = "class A:\n    def __init__(self):\n        def inner(): pass\n    async def m(self): ...\n\ndef f():\n    return 1\n"
    assert [(n, k, a) for n, _, k, a, _ in python_symbols(source)] == [("A", "class", 1), ("__init__", "constructor", 2), ("inner", "function", 3), ("m", "method", 4), ("f", "function", 6)]
    assert python_symbols("def (") is None
    go = "package x\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M() int {\n\treturn 1\n}\n"
    assert [(n, k, a, e) for n, _, k, a, e in pattern_symbols(go, "go")] == [("T", "struct", 3, 5), ("M", "method", 7, 9)]
    ts = "export class K {\n  run(x: number): void {\n    if (x) { }\n  }\n}\n"
    assert [(q, k) for _, q, k, _, _ in pattern_symbols(ts, "typescript")] == [("K", "class"), ("K.run", "method")]


def test_resolution(spark):
    sites = spark.createDataFrame([("p", "a", "f"), ("p", "a", "g"), ("p", "a", "h"), ("p", "a", "k")], "project string, file string, name string")
    known = spark.createDataFrame([("p", "a", "f", "a::f"), ("p", "b", "f", "b::f"), ("p", "b", "g", "b::g"), ("p", "b", "h", "b::h"), ("p", "c", "h", "c::h")], "project string, file string, name string, symbol_id string")
    edges = spark.createDataFrame([("p", "a", "b", "import"), ("p", "a", "c", "import")], "project string, src string, dst string, type string")
    assert {r.name: r.confidence for r in symbols.resolve(sites, known, edges).collect()} == {"f": "local", "g": "unique", "h": "multiple-candidates", "k": "unresolved"}


def test_ignore_rules(spark):
    files = spark.createDataFrame([(x,) for x in ("node_modules/a.js", "x/node_modules/a.js", "dist/y", "src/dist.js", "a/b/c.min.js", "tests/k.py", "src/tests/k.py", "keep.min.js")], "rel_path string")
    rules = [("node_modules/", False), ("dist/", False), ("*.min.js", False), ("/tests/", False), ("keep.min.js", True)]
    got = {r.rel_path for r in maintenance.ignored(files, rules).where("ignored").collect()}
    assert got == {"node_modules/a.js", "x/node_modules/a.js", "dist/y", "a/b/c.min.js", "tests/k.py"}


def test_environments(spark):
    files = spark.createDataFrame([("p", x) for x in ("env/pyvenv.cfg", "env/lib/a.py", "envy/b.py", "c/conda-meta/h.json", "c/d.py")], "project string, rel_path string")
    assert {r.rel_path for r in maintenance.without_environments(files).collect()} == {"envy/b.py"}


def test_scan_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in {"a/x.py": b"import os\n", "a/run": b"#!/bin/sh\necho hi\n", "a/pic": b"\x00\x01", "b.bin": b"x", "c.md": b"# t\n"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.rel_path: r.language for r in scan_tree(spark, f"file://{tmp_path}").collect()}
    assert got == {"a/x.py": "python", "a/run": "shell", "c.md": "markdown"}


def test_stream_of_changes(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2025, 1, 1)
    rows = [(i, "p", f"f{i % 2}", "update", t0 + timedelta(seconds=s)) for i, s in enumerate((0, 1, 1, 10, 11, 500))]
    schema = "change_id long, project string, rel_path string, kind string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = changes.sessions(stream, "project", "ts", "5 seconds", late="10 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("bursts").collect()) == [2, 3]
    seen = []
    query = changes.run_batches(stream, lambda batch, i: seen.append(batch.count()), str(tmp_path / "c2"))
    query.awaitTermination(120)
    assert sum(seen) == 6


def test_sql_surface(spark, tmp_path):
    spark.createDataFrame([("c1", "a.py", "def f():\n  pass", "python"), ("c2", "b.py", "x = 1", "python")], "chunk_id string, rel_path string, content string, language string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert "chunks" in sqlapi.register(spark, str(tmp_path))
    assert spark.sql("SELECT clean_path('./a') AS p, content_hash('x') AS h").first().p == "a"
    rows = spark.sql("SELECT s.name FROM chunks, LATERAL declared_symbols(content, language) s").collect()
    assert [r.name for r in rows] == ["f"]
    assert [r.piece for r in spark.sql("SELECT * FROM split_text('a b c', 2, ' ')").collect()] == ["a ", "b ", "c"]
    assert [r.chunk_id for r in sqlapi.search(spark, spark.table("chunks"), "def f").collect()] == ["c1"]


def test_shebangs_and_signs(spark):
    rows = {
        "#!/usr/bin/env -u HOME python3.11\n": ".py", "#!/usr/bin/sudo -n -u bob nodejs\n": ".js", "#!/bin/nice -n 5 /bin/ash\n": ".sh", "#!/usr/bin/env X=1 ruby\n": ".rb", "#!/opt/odd\n": ".txt",
        "import os, sys\n": ".py", "import it all\n": None, "set -e\necho ${HOME}\n": ".sh", "echo hi\n": None, "def f(x) -> int:\n  pass\n": ".py", "a\x00b": None,
    }
    df = spark.createDataFrame([(k,) for k in rows], "head string")
    assert {r.head: r.ext for r in df.select("head", language.sniffed_extension(F.col("head")).alias("ext")).collect()} == rows


def test_ignore_files_nest(spark):
    rows = [(".gitignore", "# all\n*.log\nbuild/\n\n!keep.log\n"), ("a/.gitignore", "/only.txt\ntmp\n"), ("a/b/.gitignore", "!x.log"), ("x.log", ""), ("keep.log", ""), ("build/o.c", ""), ("a/only.txt", ""), ("a/b/only.txt", ""), ("only.txt", ""), ("a/b/tmp/c.py", ""), ("tmp/c.py", ""), ("a/b/x.log", ""), ("n", None)]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    rules = maintenance.ignore_rules(files)
    got = {r.rel_path for r in maintenance.ignored(files, rules).where("ignored").collect()}
    assert got == {"x.log", "build/o.c", "a/only.txt", "a/b/tmp/c.py"} and maintenance.ignore_rules(files.where("false")) == []
    bare = files.select(paths.without_extension(F.col("rel_path")).alias("p")).union(spark.createDataFrame([("a/b.d.ts",), (".env",), ("x.y/z",)], "p string").select(paths.without_extension(F.col("p"))))
    assert {"a/b", ".env", "x.y/z", "build/o"} <= {r.p for r in bare.collect()}


def test_search_by_any_column(spark):
    chunks = spark.createDataFrame([("1", "a.py", "alpha", "python", "p"), ("2", "b.py", "alpha", "python", "q"), ("3", "c.go", "alpha", "go", "q")], "chunk_id string, rel_path string, content string, language string, project string")
    found = lambda **kw: [r.chunk_id for r in sqlapi.search(spark, chunks, "alpha", **kw).collect()]
    assert found() == ["1", "2", "3"] and found(where={"project": "q"}) == ["2", "3"] and found(language="go", where={"project": "q"}) == ["3"] and found(where={"project": "none"}) == []
