"""Connected components by alternating stars, with one written table per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sedimenta.plans.workspace import Workspace

_MAX_STEPS = 200


def connected_components(pairs: DataFrame) -> DataFrame:
    """node, component (the smallest node) of every node of pairs(a, b); isolated nodes must be added by the caller.

    Large star links all larger neighbours of a node to its smallest neighbour, small star all others; both are one aggregation and one
    join, and the steps needed grow with the logarithm of a component's diameter. Nulls are dropped, duplicates and self-links ignored.
    """
    ws = Workspace(pairs.sparkSession, "components")
    links = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = ws.write(links, "step0")
    for step in range(1, _MAX_STEPS):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tie = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(tie, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        seen = Observation()
        new = ws.write(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")), f"step{step}")
        now = (seen.get["n"], seen.get["s"])
        ws.drop(f"step{step - 1}")
        if step > 1 and now == before:
            break
        before, links = now, new
    else:
        raise RuntimeError("components did not settle")
    member = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
