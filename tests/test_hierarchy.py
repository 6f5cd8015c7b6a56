import random

from sedimenta.operators.hierarchy import code_hierarchies, contract, descendants


def walk(parent: dict[str, str], node: str):
    """Root, depth and state of a node by walking up."""
    seen, path, cur = set(), [node], node
    while cur in parent:
        seen.add(cur)
        cur = parent[cur]
        if cur == node:
            return None, None, -1, None
        if cur in seen:
            return None, None, -2, None
        path.append(cur)
    return cur, len(path) - 1, 0, path[::-1]


def forest(n: int, seed: int) -> dict[str, str]:
    """Random trees, long chains and cycles with trees below them."""
    r = random.Random(seed)
    parent = {f"t{i}": f"t{r.randrange(i)}" for i in range(1, n) if r.random() < 0.9}
    parent |= {f"c{i}": f"c{i - 1}" for i in range(1, n)}
    parent |= {f"y{i}": f"y{(i + 1) % 7}" for i in range(7)} | {f"b{i}": f"y{i % 7}" if i < 9 else f"b{i - 9}" for i in range(40)} | {"self": "self", "below": "self"}
    return parent


def test_against_walking_up(spark):
    parent = forest(150, 3)
    links = spark.createDataFrame([(c, p, 1) for c, p in parent.items()] * 2 + [(None, "x", 1), ("x", None, 1)], "child string, parent string, depth int")
    nodes = spark.createDataFrame([(x,) for x in {*parent, *parent.values(), "alone", None}], "node string")
    got = {r.node: (r.root, r.depth, r.state, r.path) for r in contract(links, nodes, with_path=True).collect()}
    assert set(got) == {*parent, *parent.values(), "alone"}
    assert got == {x: walk(parent, x) for x in got}


def test_without_paths_and_descendants(spark):
    parent = {"b": "a", "c": "b", "d": "b", "e": "c"}
    links = spark.createDataFrame(list(parent.items()), "child string, parent string")
    nodes = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in contract(links, nodes).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2), ("e", 3)}
    pairs = {(r.ancestor, r.node, r.distance) for r in descendants(contract(links, nodes, with_path=True)).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("a", "e", 3), ("b", "c", 1), ("b", "d", 1), ("b", "e", 2), ("c", "e", 1)}


def test_empty_tables(spark):
    links, nodes = spark.createDataFrame([], "child long, parent long"), spark.createDataFrame([], "node long")
    assert contract(links, nodes).count() == 0
    assert [tuple(r) for r in contract(links, spark.createDataFrame([(5,)], "node long")).collect()] == [(5, 5, 0, 0)]


def test_code_tables(spark):
    edges = spark.createDataFrame(
        [("p", "./a.ts", "b\\c.ts", "re-export", "x"), ("p", "a.ts", "b/c.ts", "re-export", "y"), ("p", "b/c.ts", None, "re-export", "z"), ("p", "q", "q", "re-export", "z"), ("p", "a.ts", "no", "import", "z"), ("r", "b/c.ts", "a.ts", "re-export", "z")],
        "project string, src string, dst string, type string, node string",
    )
    flow = spark.createDataFrame([(1, "p", [2, None, 99, 2]), (1, "p", [3]), (2, "p", None), (3, "p", []), (4, None, [4])], "node_id long, project string, children array<long>")
    got = {(r.graph, r.project, r.node, r.root, r.depth) for r in code_hierarchies(edges, flow).collect()}
    assert got == {
        ("edges", "p", "a.ts", "a.ts", 0), ("edges", "p", "b/c.ts", "a.ts", 1), ("edges", "p", "q", "", -1), ("edges", "r", "b/c.ts", "b/c.ts", 0), ("edges", "r", "a.ts", "b/c.ts", 1),
        ("flow_nodes", "p", "1", "1", 0), ("flow_nodes", "p", "2", "1", 1), ("flow_nodes", "p", "3", "1", 1), ("flow_nodes", "", "4", "", -1),
    }
