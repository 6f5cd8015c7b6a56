import pytest

from sedimenta import index, sqlapi
from sedimenta.operators import chunking
from sedimenta.operators.embedding import HashedEmbedder, called, embed
from sedimenta.store import Store

FILES = "rel_path string, content string, language string"


def test_store_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", keep=1)
    store.create("a", "k string, v int")
    store.create("a", "k string, v int, other int")
    assert store.read("a").columns == ["k", "v"] and store.collections() == ["a"] and not store.exists("b")
    rows = lambda *xs: spark.createDataFrame(list(xs), "k string, v int")
    store.write("a", rows(("x", 1), ("y", 2)))
    early = store.read("a")
    store.upsert("a", rows(("y", 3), ("z", 4)), ["k"])
    assert {tuple(r) for r in early.collect()} == {("x", 1), ("y", 2)}  # an old generation stays whole
    store.delete("a", rows(("x", 0)), ["k"])
    assert {tuple(r) for r in store.read("a").collect()} == {("y", 3), ("z", 4)}
    assert sum(p.name.startswith("gen-") for p in (tmp_path / "s/a").iterdir()) == 2
    with pytest.raises(Exception, match="boom"):
        store.write("a", rows(("q", 1)).selectExpr("k", "cast(raise_error('boom') as int) as v"))
    assert store.read("a").count() == 2
    store.save_record("m", {"n": 1})
    assert store.record("m") == {"n": 1} and store.record("none") is None
    store.drop_record("m")
    store.drop("a")
    assert store.collections() == [] and store.record("m") is None
    for bad in ("", "../x", "a/b"):
        with pytest.raises(ValueError):
            store.exists(bad)


def test_regions():
    spans = chunking.region_spans
    assert spans(400, [(11, 31), (41, 44), (45, 47), (60, 300)]) == [(1, 10), (11, 46), (47, 146), (137, 236), (227, 299), (300, 400)]
    assert spans(10, [(1, 11)]) == [(1, 10)] and chunking.merged([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]
    body = "\n".join(f"def f{i}():\n" + "\n".join(f"    x{j} = {j}" for j in range(30)) + "\n" for i in range(6))
    cut = chunking.file_spans("import os\n\n" + body, "python")
    assert [c[2].strip().split("(")[0] for c in cut] == ["import os", *(f"def f{i}" for i in range(6))]
    for text in ("", "\n\n", "a" * 9000, "x = 1\n" * 90, "y, " * 3000, body):
        for lo, hi, piece in chunking.file_spans(text, "python"):
            assert piece.strip() and len(piece) <= chunking.MAX_CHARS and 1 <= lo <= hi <= text.count("\n") + 1
    assert "".join(p for _, _, p in chunking.file_spans("a;b " * 2500, None)) == "a;b " * 2500


def test_embedding_retries_and_shapes(spark):
    class Flaky(HashedEmbedder):
        fails = 2

        def __call__(self, texts):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return super().__call__(texts)

    assert called(Flaky(8), ["a b"], wait=0.0) == HashedEmbedder(8)(["a b"])
    with pytest.raises(OSError):
        called(Flaky(8), ["a"], tries=2, wait=0.0)
    with pytest.raises(ValueError):
        called(type("Wrong", (), {"dimensions": 3, "__call__": lambda self, texts: [[1.0]]})(), ["a"], tries=1)
    rows = spark.createDataFrame([("1", "alpha beta"), ("2", None), ("3", "alpha beta gamma")], "id string, text string")
    got = {r.id: r.embedding for r in embed(rows, "id", "text", HashedEmbedder(16, batch=2, context=4, chars_per_token=2.5)).collect()}
    assert got["1"] == got["3"] and set(got["2"]) == {0.0}


def test_index_follows_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    model = HashedEmbedder(32)
    files = lambda *xs: spark.createDataFrame(list(xs), FILES)
    a, b, c = ("a.py", "def alpha():\n    return 1\n", "python"), ("b.md", "words about beta", "markdown"), ("c.txt", "x" * 50, "plaintext")
    assert index.index_status(store, "p") == {"state": "absent", "chunks": 0}
    first = index.update_index(store, "p", files(a, b, ("n", None, None)), model)
    assert (first.added, first.updated, first.removed) == (2, 0, 0) and index.index_status(store, "p")["chunks"] == 2
    again = index.update_index(store, "p", files(a, b), model)
    assert (again.added, again.unchanged) == (0, 2)
    changed = index.update_index(store, "p", files(("a.py", "def gamma():\n    pass\n", "python"), c), model, most_bytes=60)
    assert (changed.added, changed.updated, changed.removed) == (1, 1, 1)
    chunks = index.indexed_chunks(store, "p")
    assert {r.rel_path for r in chunks.collect()} == {"a.py", "c.txt"}
    hits = sqlapi.search(spark, chunks, "gamma", embedder=model).collect()
    assert hits[0].rel_path == "a.py" and len(hits) == 2 and len(sqlapi.search(spark, chunks, "gamma").collect()) == 1
    assert [h.rel_path for h in sqlapi.search(spark, chunks, "gamma", embedder=model, file="c.txt").collect()] == ["c.txt"]

    class Broken(HashedEmbedder):
        def __call__(self, texts):
            raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        index.update_index(store, "p", files(("a.py", "def delta():\n    pass\n", "python"), c), Broken(32))
    assert index.index_status(store, "p")["state"] == "in-progress" and "gamma" in index.indexed_chunks(store, "p").where("rel_path = 'a.py'").first().content
    assert index.update_index(store, "p", files(("a.py", "def delta():\n    pass\n", "python"), c), model).updated == 1
    index.remove_index(store, "p")
    assert index.index_status(store, "p") == {"state": "absent", "chunks": 0}


def test_linked_collections(spark):
    chunk = "chunk_id string, rel_path string, content string, language string"
    one = spark.createDataFrame([("1", "a.py", "alpha beta", "python"), ("2", "a.py", "alpha", "python"), ("3", "b.py", "delta", "python")], chunk)
    two = spark.createDataFrame([("4", "a.py", "alpha alpha", "python"), ("5", "z.py", "omega", "python")], chunk)
    got = sqlapi.search_linked(spark, [("x", one), ("y", two), ("x", two)], "alpha").collect()
    assert [(r["rank"], r.label, r.rel_path) for r in got] == [(1, "x", "a.py"), (2, "y", "a.py")]
    dense = sqlapi.search_linked(spark, [("x", one), ("y", two)], "alpha", limit=3, embedder=HashedEmbedder(32)).collect()
    assert len(dense) == 3 and dense[0].score == pytest.approx(max(r.score for r in dense)) and {r.label for r in dense} == {"x", "y"}
    with pytest.raises(ValueError):
        sqlapi.search_linked(spark, [("x", one)], "  ")
