"""Fills containers of fixed capacity by a configuration linear program.

A configuration is a multiset of sizes that fits into a container. The program chooses how often each configuration is used so that every
size of the length histogram is covered by as few containers as possible. It is solved by multiplicative weights: each size has a weight,
the best configurations under the weights are found by knapsack dynamic programming, and the weights of the sizes they cover shrink, until
every size is covered. The fractional solution is rounded in several ways, as far as the histogram holds the configuration and it leaves
no gap to speak of; what is left is packed largest size first, each time filled up as well as possible, and the best of the ways is taken.
Everything works on the histogram, whose size is bounded by the capacity, so the cost doesn't grow with the number of texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tokens import TOKENIZER, buckets_for, running_totals, token_counts
from sedimenta.plans.workspace import Workspace

CAPACITY = 2048


def best_values(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity the greatest value that fits, and the size (its place) taken first for it or -1, by dynamic
    programming."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = fits[c]
        if n:
            v = best[c - sizes[:n]] + values[:n]
            i = int(np.argmax(v))
            if v[i] > best[c]:
                best[c], pick[c] = v[i], i
    return best, pick


def fractional(sizes: np.ndarray, need: np.ndarray, capacity: int, steps: int, eps: float = 0.12) -> tuple[dict[tuple, float], float]:
    """Configurations with how often each is used, by multiplicative weights (fractional covering), and a lower bound of their sum.

    A round prices once and takes, the least covered sizes first, the best configuration with each size as long as its value is within
    eps of the best one: as much of it as covers eps of its scarcest size; weights of covered sizes shrink by the share covered. Rounds
    go on until every size is covered, and from then on until the sum is within eps of the bound, for steps rounds in all at most. The
    sum is scaled at the end so that the least covered size is covered exactly.
    """
    weight = sizes / capacity
    used: dict[tuple, float] = {}
    covered = np.zeros(len(sizes))
    bound, rounds = 0.0, 0
    while True:
        best, pick = best_values(sizes, weight, capacity)
        top, first = best[capacity], pick.tolist()
        bound = max(bound, float(weight @ need / top))
        near = np.flatnonzero(best[capacity - sizes] + weight >= (1 - eps) * top)
        for i in near[np.argsort((covered / need)[near], kind="stable")].tolist():
            counts, c = Counter([i]), capacity - int(sizes[i])
            while c > 0:
                if first[c] >= 0:
                    counts[first[c]] += 1
                    c -= int(sizes[first[c]])
                else:
                    c -= 1
            on = np.array(sorted(counts))
            times = np.array([counts[x] for x in on.tolist()], float)
            if weight[on] @ times < (1 - eps) * top:
                continue
            amount = float(np.min(need[on] / times)) * eps
            key = tuple((int(s), int(n)) for s, n in zip(sizes[on], times, strict=True))
            used[key] = used.get(key, 0.0) + amount
            covered[on] += amount * times
            weight[on] *= np.exp(-amount * times / need[on])
        weight /= weight.max()
        rounds += 1
        level = float(np.min(covered / need))
        if level > 0 and (rounds >= steps or sum(used.values()) / level <= (1 + eps) * bound):
            return {k: v / level for k, v in used.items()}, bound


def fill_up(left: Counter, room: int) -> list[int]:
    """Sizes from left (size -> count) that together fill room as far as possible."""
    reach, history = 1, []
    mask = (1 << (room + 1)) - 1
    for s in sorted((s for s in left if s <= room), reverse=True):
        n, part = min(left[s], room // s), 1
        while n > 0:
            k = min(part, n)
            history.append((s, k, reach))
            reach |= (reach << (s * k)) & mask
            n -= k
            part *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: list[int] = []
    for s, k, before in reversed(history):
        if not before >> at & 1:
            out += [s] * k
            at -= s * k
    return out


def plan_containers(histogram: dict[int, int], capacity: int, steps: int = 200) -> list[tuple[dict[int, int], int]]:
    """Configurations (size -> count) with the number of containers that use them; together they hold the histogram exactly. The program's
    solution is rounded down and up, down alone, or, where it leaves fewer containers, to nothing; what a rounding leaves is filled up."""
    need = Counter({s: n for s, n in histogram.items() if n > 0})
    if any(not 0 < s <= capacity for s in need):
        raise ValueError("sizes must be from 1 to the capacity")
    plan: list[tuple[dict[int, int], int]] = []
    if need.pop(capacity, 0):
        plan.append(({capacity: 1}, histogram[capacity]))
    sizes = np.array(sorted(need), np.int64)
    if not len(sizes):
        return plan
    full: dict[tuple, float] = {}
    if steps:
        solved, _ = fractional(sizes, np.array([need[int(s)] for s in sizes], float), capacity, steps)
        # a configuration with a gap is left to the last step
        full = {k: v for k, v in solved.items() if sum(s * n for s, n in k) >= capacity * 0.995}
    up = lambda amount: math.ceil(amount) - math.floor(amount)
    ways = ([math.floor, up], [math.floor], []) if full else ([],)
    return plan + min((_rounded(need, full, way, capacity) for way in ways), key=lambda p: sum(n for _, n in p))


def _rounded(need: Counter, solved: dict[tuple, float], ways: list[Callable], capacity: int) -> list[tuple[dict[int, int], int]]:
    left, plan = need.copy(), []

    def use(config: dict[int, int], times: int) -> None:
        plan.append((config, times))
        for s, n in config.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]

    for way in ways:
        for key in sorted(solved, key=lambda k: (math.floor(solved[k]) - solved[k], k)):
            times = min([way(solved[key]), *(left[s] // n for s, n in key)])
            if times > 0:
                use(dict(key), times)
    while left:
        top = max(left)
        rest = left.copy()
        rest[top] -= 1
        config = Counter([top, *fill_up(+rest, capacity - top)])
        use(dict(config), min(left[s] // n for s, n in config.items()))
    return plan


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, steps: int = 200) -> DataFrame:
    """Assigns every text to containers: container, doc_id, piece_no, start_token, n_tokens.

    documents: doc_id (unique), text. A text longer than the capacity is cut into full containers and a rest; others stay whole. Empty
    and null texts take the room of one token (n_tokens says 0), so that no container holds endlessly many. An empty table gives none.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ws = Workspace(documents.sparkSession, "packing")
    sized = ws.write(token_counts(documents.select("doc_id", "text"), tokenizer=tokenizer), "sized")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest("n_tokens", F.lit(1)) - 1, F.lit(capacity).cast("long"))
    pieces = sized.select("doc_id", "n_tokens", F.posexplode(starts).alias("piece_no", "start_token")).withColumn(
        "n_tokens", F.least(F.col("n_tokens") - F.col("start_token"), F.lit(capacity))
    )
    pieces = pieces.withColumn("size", F.greatest("n_tokens", F.lit(1)).cast("int"))
    # at most one row per size up to the capacity
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    plan = plan_containers(histogram, capacity, steps)
    # per size: from which place in its order on which containers are used, so many of them per container
    slots: dict[int, list[tuple[int, int, int]]] = {}
    placed: Counter = Counter()
    first = 0
    for config, times in plan:
        for s, n in config.items():
            slots.setdefault(s, []).append((placed[s], first, n))
            placed[s] += n * times
        first += times
    rows = sorted((s, at, start, n) for s, xs in slots.items() for at, start, n in xs)
    keys = np.array([(s << 44) + at for s, at, _, _ in rows], np.int64)
    table = np.array(rows, np.int64).reshape(-1, 4)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i = np.searchsorted(keys, (b["size"].to_numpy(np.int64) << 44) + b["before"].to_numpy(np.int64), side="right") - 1
            container = table[i, 2] + (b["before"].to_numpy(np.int64) - table[i, 1]) // table[i, 3]
            yield b[["doc_id", "piece_no", "start_token", "n_tokens"]].assign(container=container)

    most = max(histogram.values(), default=0)
    ranked = running_totals(pieces, "size", F.lit(1).cast("long"), F.xxhash64("doc_id", "piece_no"), F.struct("doc_id", "piece_no"), buckets_for(most))
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = ranked.select("doc_id", "piece_no", "start_token", "n_tokens", "size", "before").mapInPandas(
        place, f"doc_id {kind}, piece_no int, start_token long, n_tokens long, container long"
    )
    return out.select("container", "doc_id", "piece_no", "start_token", "n_tokens")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the least number of containers possible by size alone, and the share of their room that is used."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n").alias("fullest")).select(
        "containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("at_least"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("used")
    )
