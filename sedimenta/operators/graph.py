"""File graphs: edges(project, src, dst, type), one row per link; paths are clean, unresolved links have a null dst."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import paths
from sedimenta.plans.workspace import Workspace


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct rows with clean paths; rows without src are left out."""
    c = {x: paths.clean(F.col(x)) for x in ("src", "dst")}
    return edges.where("src is not null").withColumns(c).select("project", "src", "dst", "type").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select("project", F.col("src").alias("file")).union(edges.select("project", F.col("dst").alias("file")))
    return ends.where("file is not null").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """project, file, imports, imported_by of every node; parallel links of different types count each."""
    real = edges.where("dst is not null")
    ends = real.select("project", F.col("src").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        real.select("project", F.col("dst").alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("project", "file").agg(F.sum("o").alias("imports"), F.sum("i").alias("imported_by"))


def dependencies(edges: DataFrame) -> DataFrame:
    """project, file, direction (imports, imported by), other: both sides of every link."""
    real = edges.where("dst is not null").select("project", "src", "dst").distinct()
    out = real.select("project", F.col("src").alias("file"), F.lit("imports").alias("direction"), F.col("dst").alias("other"))
    return out.union(real.select("project", F.col("dst").alias("file"), F.lit("imported by").alias("direction"), F.col("src").alias("other")))


def stats(edges: DataFrame) -> DataFrame:
    """project, files, links, average of links per file, links that could not be resolved and their percentage, and whether resolution
    is too low to rely on (20 links or more, under 2 % of them resolved)."""
    n = nodes(edges).groupBy("project").agg(F.count("*").alias("files"))
    e = edges.groupBy("project").agg(F.count("dst").alias("links"), F.count("*").alias("declared"))
    return n.join(e, "project").select(
        "project", "files", "links", F.round(F.col("links") / F.col("files"), 6).alias("avg_links"), (F.col("declared") - F.col("links")).alias("unresolved"),
        F.round(100.0 * (F.col("declared") - F.col("links")) / F.col("declared"), 4).alias("unresolved_pct"), ((F.col("declared") >= 20) & (F.col("links") < 0.02 * F.col("declared"))).alias("low_resolution"),
    )


def top_connected(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k files of most links in each project."""
    d = degrees(edges).withColumn("links", F.col("imports") + F.col("imported_by"))
    order = Window.partitionBy("project").orderBy(F.desc("links"), "file")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("project", "file", "links", "rank")


def reach(links: DataFrame, start: DataFrame, depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Breadth-first search from many roots at once: root, node, hop (keys, too) of every node within depth, roots at hop 0.

    links(from, to, keys), start(root, keys). Each hop joins only the newest frontier, drops nodes seen before and writes the result, so
    plans stay short and lost executors cost one hop. Duplicate links and cycles do no harm.
    """
    ws = Workspace(links.sparkSession, "reach")
    key = list(keys)
    step = links.select(*key, F.col("from").alias("node"), "to").where("node is not null and to is not null").distinct()
    step = ws.write(step, "links")
    frontier = start.select(*key, "root", F.col("root").alias("node"), F.lit(0).alias("hop")).distinct()
    schema = ws.write(frontier, "hop0").schema
    done = ["hop0"]
    for hop in range(1, depth + 1):
        last = ws.read(schema, done[-1])
        new = last.join(step, [*key, "node"]).select(*key, "root", F.col("to").alias("node")).distinct()
        new = new.join(ws.read(schema, *done).select(*key, "root", "node"), [*key, "root", "node"], "left_anti")
        if ws.write(new.withColumn("hop", F.lit(hop)), f"hop{hop}").isEmpty():
            break
        done.append(f"hop{hop}")
    return ws.read(schema, *done)


def impact(edges: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """project, root, node, hop of all files that depend on a target (project, root) over at most depth links, without the targets."""
    links = edges.where("dst is not null").select("project", F.col("dst").alias("from"), F.col("src").alias("to"))
    return reach(links, targets, max(1, min(10, depth)), ("project",)).where("hop > 0")


_MAX_ROUNDS = 1_000_000  # more than any table needs; beyond it an error is raised


LOCAL_LINKS = 500_000  # a project of at most so many links is solved in one task


def cycle_members(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of their strongly connected component, -1 for those on no cycle; depth-first search with an
    explicit stack, in time by nodes and links."""
    order = np.argsort(u, kind="stable")
    heads = v[order].tolist()
    first = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]).tolist()
    at, low, index, out = first[:-1].copy(), [0] * n, [0] * n, [-1] * n
    open_, done, count = [], [False] * n, 0
    for root in range(n):
        if index[root]:
            continue
        path = [root]
        while path:
            x = path[-1]
            if not index[x]:
                count += 1
                index[x] = low[x] = count
                open_.append(x)
            if at[x] < first[x + 1]:
                y = heads[at[x]]
                at[x] += 1
                if not index[y]:
                    path.append(y)
                elif not done[y] and index[y] < low[x]:
                    low[x] = index[y]
                continue
            path.pop()
            if path and low[x] < low[path[-1]]:
                low[path[-1]] = low[x]
            if low[x] == index[x]:
                members = [open_.pop()]
                while members[-1] != x:
                    members.append(open_.pop())
                least = min(members)
                for m in members:
                    done[m] = True
                    out[m] = least if len(members) > 1 else -1
    result = np.array(out, np.int64)
    loops = u[u == v]
    result[loops] = np.where(result[loops] < 0, loops, result[loops])
    return result


def strongly_connected(edges: DataFrame, max_rounds: int | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """project, file, component of all files on a cycle of links (a self-link is one); component is the smallest file of it.

    Cycles lie within a project. A project of at most local_links links goes to one task, which finds them in one walk; larger ones are
    solved by rounds of joins. Both are exact. With max_rounds, all are solved by rounds, and an error is raised if so many aren't enough.
    A null project counts as the empty string.
    """
    local_links = local_links if max_rounds is None else 0
    links = edges.where("src is not null and dst is not null").select(F.coalesce("project", F.lit("")).alias("project"), "src", "dst").distinct()
    sizes = links.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") > local_links).select("project")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([group["src"].to_numpy(object), group["dst"].to_numpy(object)]))
        u, v = (np.searchsorted(names, group[c].to_numpy(object)) for c in ("src", "dst"))
        least = cycle_members(len(names), u, v)
        on = np.flatnonzero(least >= 0)
        return pd.DataFrame({"project": group["project"].iloc[0], "file": names[on], "component": names[least[on]]})

    shape = "project string, file string, component string"
    if sizes.isEmpty():
        return links.groupBy("project").applyInPandas(walk, shape)
    found = links.join(sizes, "project", "left_anti").groupBy("project").applyInPandas(walk, shape)
    return found.unionByName(_by_rounds(links.join(sizes, "project", "left_semi"), max_rounds or _MAX_ROUNDS))


def _by_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """strongly_connected by joins.

    First, files without links to or from others of the rest are peeled off until none is left to peel, and files with one link in and one
    out are spliced out, so that a long ring takes rounds by the logarithm of its length; they are put back at the end. Then, in turns, the smallest name
    spreads forward over the rest; what its owner can be reached from, among the files that got its name, is the owner's component and is
    taken out. Every round is one join and one aggregation of what is left; rounds go on until nothing changes, and an error is raised
    if one of the loops hasn't ended after max_rounds.
    """
    ws = Workspace(edges.sparkSession, "scc")
    split = F.concat_ws("\x1f", "project", F.col("src")), F.concat_ws("\x1f", "project", F.col("dst"))
    links = edges.select(split[0].alias("u"), split[1].alias("v")).distinct()
    loops = links.where("u = v").select(F.col("u").alias("node"))
    rest = ws.write(links.where("u <> v"), "rest0")
    turn, size = 0, -1

    def peeled(links: DataFrame) -> DataFrame:
        nonlocal turn, size
        for _ in range(max_rounds):
            n = links.count()
            if n == size or n == 0:
                return links
            size = n
            turn += 1
            for _ in range(3):
                heads, tails = links.select(F.col("v").alias("u")).distinct(), links.select(F.col("u").alias("v")).distinct()
                links = links.join(heads, "u", "left_semi").join(tails, "v", "left_semi").select("u", "v")
            links = ws.write(links, f"rest{turn}")
        raise RuntimeError("peeling did not settle")

    found = []
    rest, spliced = _splice(ws, peeled(rest), max_rounds)
    size = -1
    rest = peeled(rest)
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        color = _spread(ws, rest, rest.select(F.col("u").alias("node")).distinct().withColumn("color", F.col("node")), f"forward{turn}", max_rounds)
        same = rest.join(color.withColumnRenamed("node", "u").withColumnRenamed("color", "cu"), "u").join(color.withColumnRenamed("node", "v").withColumnRenamed("color", "cv"), "v").where("cu = cv")
        back = same.select(F.col("v").alias("u"), F.col("u").alias("v"))
        owners = color.where("node = color").select("node", "color")
        own = _flood(ws, back, owners, f"back{turn}", max_rounds)
        found.append(own)
        gone = own.select("node")
        turn += 1
        left = rest.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti")
        size = -1
        rest = peeled(ws.write(left.select("u", "v"), f"left{turn}"))
    else:
        raise RuntimeError("cycles did not settle")
    out = None
    for f in found:
        out = f.select("node", F.col("color").alias("component")) if out is None else out.union(f.select("node", F.col("color").alias("component")))
    for r in spliced:
        loops = loops.union(r.where("before = after").select(F.col("before").alias("node")))
    alone = loops.distinct().select("node", F.col("node").alias("component"))
    if out is None:
        every = alone
    else:
        big = out.join(out.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component")
        every = big.union(alone.join(big, "node", "left_anti").select("node", "component"))
    for i, r in reversed(list(enumerate(spliced))):
        ends = [every.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("before", "after")]
        back = r.join(ends[0], "before").join(ends[1], "after").where("of_before = of_after").select("node", F.col("of_before").alias("component"))
        every = ws.write(back.union(every.join(back, "node", "left_anti")), f"whole{i}")
    least = every.groupBy("component").agg(F.min("node").alias("least"))
    every = every.join(least, "component").select("node", F.col("least").alias("component"))
    part = lambda c, i: F.split(c, "\x1f", 2)[i]
    return every.select(part(F.col("node"), 0).alias("project"), part(F.col("node"), 1).alias("file"), part(F.col("component"), 1).alias("component"))


def _splice(ws: Workspace, links: DataFrame, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (u, v) without most of the nodes that have one link in and one out, and per round the nodes spliced out (node, before, after).

    A round takes the nodes whose random mark is above those of both neighbours, so no two are linked. Where both neighbours are one
    node, that node is on a cycle, but no link is left of it. It ends when hardly any link goes.
    """
    rounds: list[DataFrame] = []
    for i in range(max_rounds):
        n = links.count()
        if n == 0:
            return links, rounds
        into = links.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("i"), F.min("u").alias("before")).where("i = 1")
        out = links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("o"), F.min("v").alias("after")).where("o = 1")
        mark = {x: F.xxhash64(x, F.lit(i)) for x in ("node", "before", "after")}
        chosen = into.join(out, "node").where((mark["node"] > mark["before"]) & (mark["node"] > mark["after"])).select("node", "before", "after")
        chosen = ws.write(chosen, f"spliced{i}")
        gone = chosen.count()
        if gone:
            rounds.append(chosen)
            left = links.join(chosen.select(F.col("node").alias("u")), "u", "left_anti").join(chosen.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v")
            links = ws.write(left.union(chosen.where("before <> after").select("before", "after")).distinct(), f"splicing{i}")
        if n > 100 and gone < 0.02 * n or not gone and i > 3:
            return links, rounds
    raise RuntimeError("splicing did not settle")


def _spread(ws: Workspace, links: DataFrame, color: DataFrame, name: str, max_rounds: int) -> DataFrame:
    """The smallest color that reaches each node along links; four hops a round."""
    for i in range(max_rounds):
        step = lambda c: c.union(links.join(c, links.u == c.node).select(F.col("v").alias("node"), "color")).groupBy("node").agg(F.min("color").alias("color"))
        new = ws.write(step(step(step(step(color)))), f"{name}-{i}")
        changed = new.join(color.withColumnRenamed("color", "old"), "node").where("old <> color").limit(1).count()
        ws.drop(*[f"{name}-{i - 1}"] * (i > 0))
        color = new
        if not changed:
            return color
    raise RuntimeError("names did not settle")


def _flood(ws: Workspace, links: DataFrame, start: DataFrame, name: str, max_rounds: int) -> DataFrame:
    """All nodes that start (node, color) reaches along links, with the color; four hops a round."""
    seen = ws.write(start, f"{name}-0")
    n = seen.count()
    for i in range(1, max_rounds):
        step = lambda c: c.union(links.join(c, links.u == c.node).select(F.col("v").alias("node"), "color")).distinct()
        seen = ws.write(step(step(step(step(seen)))), f"{name}-{i}")
        before, n = n, seen.count()
        ws.drop(f"{name}-{i - 1}")
        if n == before:
            return seen
    raise RuntimeError("the flood did not settle")


def mermaid(edges: DataFrame, cyclic: DataFrame, most: int | None = None) -> DataFrame:
    """project, diagram: a flowchart of each project's distinct links; links within a cycle and dynamic imports are dotted.

    Node numbers follow the order of names. A diagram is one text per project, as wide as the project is.
    """
    numbered = nodes(edges).withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("file")) - 1)
    label = F.concat(F.lit("  n"), F.col("n"), F.lit('["'), F.replace("file", F.lit('"'), F.lit("'")), F.lit('"]'))
    heads = numbered.select("project", F.lit(0).alias("part"), F.col("n").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), label.alias("line"))
    ring = cyclic.select("project", F.col("file").alias("src"), F.col("component").alias("cs")), cyclic.select("project", F.col("file").alias("dst"), F.col("component").alias("cd"))
    real = edges.where("dst is not null").groupBy("project", "src", "dst").agg(F.bool_or(F.col("type") == "dynamic-import").alias("dynamic"))
    joined = real.join(ring[0], ["project", "src"], "left").join(ring[1], ["project", "dst"], "left")
    joined = joined.join(numbered.select("project", F.col("file").alias("src"), F.col("n").alias("a")), ["project", "src"]).join(numbered.select("project", F.col("file").alias("dst"), F.col("n").alias("b")), ["project", "dst"])
    dotted = F.col("dynamic") | F.coalesce(F.col("cs") == F.col("cd"), F.lit(False))
    line = F.concat(F.lit("  n"), F.col("a"), F.when(dotted, " -.-> n").otherwise(" --> n"), F.col("b"))
    rows = heads.union(joined.select("project", F.lit(1), F.col("a").cast("long"), F.col("b").cast("long"), line))
    body = F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda r: r.line)
    return rows.groupBy("project").agg(F.concat(F.lit("graph LR\n"), F.array_join(body, "\n")).alias("diagram"))


def share_of(column: Column, total: Column) -> Column:
    return F.round(F.try_divide(column, total), 6)
