"""Mixes sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tokens import TOKENIZER, buckets_for, running_totals, token_counts
from sedimenta.plans.workspace import Workspace


PASSES = 4


@dataclass
class Mixture:
    """taken: doc_id, source, n_tokens, repeats of every text that is taken; shares: one row per target with the share reached."""

    taken: DataFrame
    shares: DataFrame


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER, passes: int = PASSES) -> Mixture:
    """Takes texts so that each source has its weight of all tokens.

    documents: doc_id (unique), text, source; targets: source, weight, max_repeats, one row per source. The weights of targets that have
    texts are scaled to sum to 1. total is the size of the mixture in tokens; by default it is the largest at which every source can
    fill its share with at most max_repeats copies of each text. With a greater total, sources that run out stay below their share.

    Each text gets a hash-random key; sources are ordered by it, and a source's texts are taken in that order, in as many full epochs as
    its budget holds and then up to the budget. As texts stay whole, what remains of a budget is filled in the same way, with new keys, by
    texts that fit, in so many passes in all; shares reports the tokens of a budget that are left unfilled then. Texts of null or other
    sources aren't taken; targets with null or non-positive weight, or max_repeats below 1, take nothing; targets without texts appear in
    shares with 0. Empty texts belong to the mixture like others. Ties of keys are ordered by doc_id.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "mixture")
    goal = targets.where("source is not null").groupBy("source").agg(
        F.max(F.when((F.col("weight") > 0) & (F.col("max_repeats") > 0), F.col("weight"))).alias("weight"), F.max("max_repeats").alias("max_repeats")
    )
    wanted = documents.select("doc_id", "source", "text").join(F.broadcast(goal.where("weight > 0").select("source")), "source", "left_semi")
    sized = ws.write(token_counts(wanted, tokenizer=tokenizer), "sized")
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("docs"))
    # one row per source of the targets
    rows = goal.join(have, "source", "left").select("source", "weight", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("docs", F.lit(0)).alias("docs")).collect()
    live = {r.source: r for r in rows if r.weight and r.available}
    scale = sum(r.weight for r in live.values())
    if total is None:
        total = int(min((r.max_repeats * r.available * scale / r.weight for r in live.values()), default=0))
    plan = []
    for s, r in live.items():
        budget = min(round(total * r.weight / scale), r.max_repeats * r.available)
        plan.append((s, budget // r.available, budget % r.available))
    buckets = buckets_for(max((r.docs for r in rows), default=0))
    budgets = F.broadcast(spark.createDataFrame(plan, "source string, epochs long, rest long"))  # one row per source of the targets
    left, parts = sized, []
    for turn in range(passes):
        fits = left.join(budgets, "source").where(F.col("n_tokens") <= F.col("rest"))
        ordered = running_totals(fits, "source", F.col("n_tokens"), F.xxhash64("doc_id", F.lit(seed + turn)), F.col("doc_id"), buckets)
        part = ordered.where(F.col("before") + F.col("n_tokens") <= F.col("rest")).select("doc_id", "source", "n_tokens")
        parts.append(ws.write(part, f"part{turn}"))
        used = {r[0]: r[1] for r in parts[-1].groupBy("source").agg(F.sum("n_tokens")).collect()}
        plan = [(s, e, rest - used.get(s, 0)) for s, e, rest in plan]
        if turn == passes - 1 or not any(rest for _, _, rest in plan):
            break
        budgets = F.broadcast(spark.createDataFrame(plan, "source string, epochs long, rest long"))
        left = left.join(parts[-1], "doc_id", "left_anti")
    unfilled = spark.createDataFrame([(s, rest) for s, _, rest in plan], "source string, unfilled long")
    whole = sized.join(budgets, "source").where("epochs > 0").select("doc_id", "source", "n_tokens", F.col("epochs").alias("repeats"))
    extra = reduce(DataFrame.union, parts).withColumn("repeats", F.lit(1).cast("long"))
    taken = whole.unionByName(extra).groupBy("doc_id").agg(F.any_value("source").alias("source"), F.any_value("n_tokens").alias("n_tokens"), F.sum("repeats").alias("repeats"))
    taken = ws.write(taken, "taken")
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats"), F.sum("repeats").alias("texts"))
    everything = taken.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] or 0
    shares = (
        goal.join(have, "source", "left")
        .join(got, "source", "left")
        .join(F.broadcast(unfilled), "source", "left")
        .select(
            "source", "weight", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("available", "tokens", "texts", "repeats", "unfilled")),
            F.round(F.col("weight") / F.lit(scale or 1.0), 6).alias("scaled_weight"), F.round(F.coalesce(F.try_divide(F.col("tokens"), F.lit(everything)), F.lit(0.0)), 6).alias("share"),
        )
    )
    return Mixture(taken, shares)


def epochs(taken: DataFrame) -> DataFrame:
    """One row for each copy of a taken text: doc_id, source, n_tokens, epoch (from 1)."""
    return taken.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("epoch"))
