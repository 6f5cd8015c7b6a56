"""Parent-child links to full hierarchies by parallel tree contraction.

Each round removes two kinds of nodes at once from what is left of the forest:

* *rake*: a node without children is removed; its link to the parent is recorded;
* *compress*: a node with exactly one child, whose random mark of the round exceeds those of its parent and its child, is spliced out:
  its child is linked to its parent, the link keeps how many nodes (or which) lie between.

The rounds needed grow with the logarithm of the node count whatever the depth is, and each round handles geometrically fewer links.
What cannot be contracted any further is a self-loop: the core of a cycle. The recorded contractions are then undone in reverse order,
which gives every removed node its root, depth, path and whether it lies on a cycle (-1) or below one (-2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sedimenta.plans.workspace import Workspace

ON_CYCLE, BELOW_CYCLE = -1, -2
_MAX_ROUNDS = 400


def _mark(key: str, turn: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(turn))


def contract(links: DataFrame, nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """Resolves every node of a forest that may hold cycles.

    links(child, parent), nodes(node): any number of duplicates, other columns are ignored. Rows with a null are dropped. A node with
    several distinct parents keeps the smallest. A child or parent that nodes lacks counts as a node too.

    Returns one row per node: node, root, depth, state (0, -1 on a cycle, -2 below one) and, with_path, path (array from root to node).
    Nodes on or below a cycle have root null, depth null and path null. Empty tables give an empty result.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    kind = links.schema["child"].dataType
    via = F.array().cast(f"array<{kind.simpleString()}>") if with_path else F.lit(1).cast("int")
    first = (
        links.select(F.col("child").alias("child"), F.col("parent").cast(kind).alias("parent"))
        .where("child is not null and parent is not null")
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
        .withColumn("via", via)
    )
    edges, rounds = first, []
    for turn in range(_MAX_ROUNDS):
        seen = Observation()
        marked = _classify(edges, turn).observe(
            seen,
            F.count(F.when(F.col("move") == "rake", 1)).alias("raked"),
            F.count(F.when(F.col("move") == "splice", 1)).alias("spliced"),
            F.count(F.when((F.col("move") == "keep") & (F.col("child") != F.col("parent")), 1)).alias("left"),
        )
        marked = ws.write(marked, f"round{turn}")
        n = seen.get
        rounds.append((marked, n["raked"], n["spliced"]))
        if n["left"] == 0 and n["raked"] == 0 and n["spliced"] == 0:
            break
        edges = _shrink(marked, with_path)
    else:
        raise RuntimeError(f"contraction left links after {_MAX_ROUNDS} rounds")
    return _expand(ws, nodes, rounds, kind, with_path)


def _classify(edges: DataFrame, turn: int) -> DataFrame:
    """Adds to each link whether its child is raked or spliced out in this round, or kept."""
    kids = edges.groupBy(F.col("parent").alias("child")).agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("child").alias("key"), "via")).alias("only")
    )
    lone = (
        (F.col("n") == 1)
        & (F.col("child") != F.col("parent"))
        & (_mark("child", turn) > _mark("parent", turn))
        & (_mark("child", turn) > _mark("only.key", turn))
    )
    move = F.when(F.col("n").isNull(), "rake").when(lone, "splice").otherwise("keep")
    return edges.join(kids, "child", "left").withColumn("move", move)


def _shrink(marked: DataFrame, with_path: bool) -> DataFrame:
    """The links that remain after a round: a child of a spliced node is linked to that node's parent."""
    joined = F.concat("via", F.array("child"), "only.via") if with_path else F.col("via") + F.col("only.via")
    kept = marked.where("move = 'keep'").select("child", F.lit(False).alias("new"), F.struct("parent", "via").alias("link"))
    new = marked.where("move = 'splice'").select(
        F.col("only.key").alias("child"), F.lit(True).alias("new"), F.struct("parent", joined.alias("via")).alias("link")
    )
    return (
        kept.unionByName(new)
        .groupBy("child")
        .agg(F.max_by("link", "new").alias("link"), F.bool_or(~F.col("new")).alias("there"))
        .where("there")  # a raked child of a spliced node is gone
        .select("child", "link.parent", "link.via")
    )


def _expand(ws: Workspace, nodes: DataFrame, rounds: list, kind, with_path: bool) -> DataFrame:
    """Undoes the rounds, the last first: a removed node takes its values from the node it was linked to."""
    links = rounds[0][0]
    everyone = nodes.select(F.col("node").cast(kind)).where("node is not null").union(links.select("parent")).distinct()
    roots = everyone.join(links.select(F.col("child").alias("node")), "node", "left_anti").select(
        "node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(0).alias("state"), *([F.array("node").alias("path")] if with_path else [])
    )
    empty_path = [F.lit(None).cast(f"array<{kind.simpleString()}>").alias("path")] if with_path else []
    cores = rounds[-1][0].where("child = parent").select(
        F.col("child").alias("node"), F.lit(None).cast(kind).alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(ON_CYCLE).alias("state"), *empty_path
    )
    ws.write(roots.unionByName(cores), "known0")
    schema, known = roots.unionByName(cores).schema, ["known0"]

    def settle(rows: DataFrame, name: str) -> None:
        ws.write(rows.select(*schema.names), name)
        known.append(name)

    for turn in range(len(rounds) - 1, -1, -1):
        marked, raked, spliced = rounds[turn]
        for move, count in (("splice", spliced), ("rake", raked)):
            if not count:
                continue
            have = ws.read(schema, *known)
            above = have.select(
                F.col("node").alias("parent"), "root", F.col("depth").alias("above"), F.col("state").alias("upper"), *([F.col("path").alias("head")] if with_path else [])
            )
            gone = marked.where(F.col("move") == move).select(F.col("child").alias("node"), "parent", "via", F.col("only.key").alias("only"))
            rows = gone.join(above, "parent")
            state = F.when(F.col("upper") != 0, BELOW_CYCLE).otherwise(0)
            if move == "splice":  # a node with one child left is on a cycle exactly if that child is
                below = have.where(F.col("state") == ON_CYCLE).select(F.col("node").alias("only"), F.lit(True).alias("loop"))
                rows = rows.join(below, "only", "left")
                state = F.when(F.col("loop"), ON_CYCLE).otherwise(state)
            rows = rows.withColumn("state", state)
            steps = F.size("via") + 1 if with_path else F.col("via")
            fine = F.col("state") == 0
            rows = rows.withColumn("depth", F.when(fine, F.col("above") + steps)).withColumn("root", F.when(fine, F.col("root")))
            if with_path:
                rows = rows.withColumn("path", F.when(fine, F.concat("head", "via", F.array("node"))))
            settle(rows, f"known_{turn}_{move}")
    ws.drop(*(f"round{t}" for t in range(1, len(rounds))))
    return ws.read(schema, *known)


def descendants(paths: DataFrame) -> DataFrame:
    """All pairs (ancestor, node, distance) of resolved nodes; paths is contract(..., with_path=True). As many rows as paths have steps."""
    step = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("level", "ancestor")
    return paths.where("path is not null and size(path) > 1").select("node", "depth", step).select(
        "ancestor", "node", (F.col("depth") - F.col("level")).alias("distance")
    )


def clean_path(path: Column) -> Column:
    """A relative path with forward slashes and without leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def _id(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def reexport_links(edges: DataFrame) -> DataFrame:
    """Parent-child links of the re-export rows of edges, within a project; node names are prefixed with graph and project."""
    rows = edges.where("type = 're-export' and dst is not null and src is not null")
    head = (F.lit("edges"), F.coalesce("project", F.lit("")))
    return rows.select(_id(*head, clean_path(F.col("dst"))).alias("child"), _id(*head, clean_path(F.col("src"))).alias("parent"))


def flow_links(flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and nodes of flow_nodes: rows of one node are united, ids without a row are no nodes."""
    flow = flow.where("node_id is not null")
    project = flow.groupBy("node_id").agg(F.min("project").alias("project"))
    name = _id(F.lit("flow_nodes"), F.coalesce("project", F.lit("")), F.col("node_id").cast("string"))
    nodes = project.select("node_id", name.alias("node"))
    pairs = flow.select(F.col("node_id").alias("up"), F.explode("children").alias("node_id")).where("node_id is not null").distinct()
    named = pairs.join(nodes.withColumnRenamed("node", "child"), "node_id").select("child", F.col("up").alias("node_id"))
    return named.join(nodes.withColumnRenamed("node", "parent"), "node_id").select("child", "parent"), nodes.select("node")


def code_hierarchies(edges: DataFrame, flow: DataFrame, with_path: bool = False) -> DataFrame:
    """Both hierarchies in one contraction: graph, project, node, root, depth (root '' and depth -1 or -2 on or below a cycle), path."""
    tree, nodes = flow_links(flow)
    done = contract(reexport_links(edges).unionByName(tree), nodes, with_path)
    part = lambda c, i: F.split(c, "\x1f", 3)[i]
    bare = lambda c: part(c, 2)
    out = done.select(
        part("node", 0).alias("graph"),
        part("node", 1).alias("project"),
        bare("node").alias("node"),
        F.when(F.col("state") == 0, bare("root")).otherwise("").alias("root"),
        F.when(F.col("state") == 0, F.col("depth")).otherwise(F.col("state")).alias("depth"),
        *([F.transform("path", bare).alias("path")] if with_path else []),
    )
    return out
