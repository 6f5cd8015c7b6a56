"""Near-duplicate texts by multi-index hashing.

A text's fingerprint is a code of segments x width symbols, each the minimum of one hash function over the set of the text's token runs;
two texts agree in a symbol with the probability of their Jaccard similarity s. The code is cut into segments. Each segment's Hamming
ball of radius one is enumerated (the segment with each symbol in turn left out) into one index; texts that meet in any of them are
candidates. Candidates are verified by the complete distance of their codes, and what stays by that of their sets. With 14 segments of 4 symbols a pair at s = 0.6 stays
undetected with probability 0.0001, one at 0.7 with 0.000001.

A crowded bucket, as boilerplate or a large family makes it, isn't joined as it is: its texts are compared by their complete codes, in
blocks that a task each gets two of, and only pairs that are close enough leave the task. A very large one is parted first by an index
inside, of the balls of radius two of every other segment. A pair at s = 0.6 that met in the bucket agrees in two of four symbols of one of
the 13 other segments but for a probability of 1e-9, so crowding adds nothing to what stays undetected.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.components import connected_components
from sedimenta.plans.workspace import Workspace

_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_KNOWN_TOKENS = 400_000
SEGMENTS, WIDTH = 14, 4
CROWDED = 512
SPLIT, BLOCK = 32_768, 4096  # texts from which on a bucket is parted by an index inside; texts of a block
BROADCAST_ROWS = 200_000  # ids of 36 characters: under 20 MB


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes, so that all bits depend on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RunHasher:
    """The sorted set of hashes of a text's runs of consecutive tokens."""

    def __init__(self, run: int, pattern: re.Pattern = _TOKEN):
        self.run, self.pattern, self.known = run, pattern, {}
        self.weights = _multipliers(run, 11)

    def sequence(self, text: str | None) -> np.ndarray:
        """The hashes of a text's runs in order."""
        tokens = self.pattern.findall(text or "")
        n = len(tokens) - self.run + 1
        if n < 1:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _KNOWN_TOKENS:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t)
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        out = np.zeros(n, np.uint64)
        for i, w in enumerate(self.weights):
            out = _mixed(out + h[i : i + n]) * w
        return _mixed(out)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.sequence(text))


def code_of(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """One row of min-hash symbols for each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), symbols), np.uint64)
    with np.errstate(over="ignore"):
        for k, (m, a) in enumerate(zip(_multipliers(symbols, 12), _multipliers(symbols, 13), strict=True)):
            out[:, k] = np.minimum.reduceat(flat * m + a, starts)
    return out


def ball_keys(code: np.ndarray, segments: int, width: int) -> np.ndarray:
    """The index keys of each code of 16-bit symbols: for every segment, the segment with each symbol in turn left out."""
    with np.errstate(over="ignore"):
        parts = _mixed(code.astype(np.uint64) + np.uint64(1)).reshape(len(code), segments, width)
        weighted = parts * _multipliers(width, 14)
        rest = weighted.sum(axis=2, keepdims=True, dtype=np.uint64) - weighted
        place = _multipliers(segments * width, 15).reshape(segments, width)
        return _mixed(rest + place).reshape(len(code), segments * width)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)))


def _fingerprint(run: int, symbols: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher(run)
        for batch in batches:
            ids, sets = [], []
            for i, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = hasher(text)
                if len(s):
                    ids.append(i.as_py())
                    sets.append(s)
            if not ids:
                continue
            code = (code_of(sets, symbols) & np.uint64(0xFFFF)).astype(np.uint16)
            digest = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(digest, pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "digest", "code"])

    return go


def _keys(segments: int, width: int):
    """Rows num, segment, key of the balls of radius one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = segments * width
        segment = np.repeat(np.arange(segments, dtype=np.int32), width)
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, n)
            keys = ball_keys(code, segments, width)
            num = np.repeat(batch.column(0).to_numpy(), n)
            yield pa.record_batch([pa.array(num), pa.array(np.tile(segment, len(code))), pa.array(keys.ravel().view(np.int64))], names=["num", "segment", "key"])

    return go


def _inner_keys(segments: int, width: int):
    """From rows num, segment, key, code of very large buckets the rows of the indexes inside: for each other segment and each way to leave
    out two of its symbols one, whose key stands for the bucket and what remains of that segment."""
    kept = list(itertools.combinations(range(width), max(1, width - 2)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _multipliers(segments * len(kept), 16).reshape(segments, len(kept))
        weights = _multipliers(width, 17)
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(len(batch), segments, width)
            num, segment, key = (batch.column(i).to_numpy() for i in range(3))
            with np.errstate(over="ignore"):
                weighted = _mixed(code.astype(np.uint64) + np.uint64(1)) * weights
                inner = np.stack([weighted[:, :, list(c)].sum(axis=2, dtype=np.uint64) for c in kept], axis=2)
                inner = _mixed(_mixed(inner + place) + _mixed(key.view(np.uint64))[:, None, None])
            other = np.arange(segments) != segment[:, None]
            times = (segments - 1) * len(kept)
            yield pa.record_batch([pa.array(np.repeat(num, times)), pa.array(np.repeat(segment, times)), pa.array(inner[other].ravel().view(np.int64))], names=["num", "segment", "key"])

    return go


def _compare(segments: int, width: int, least: int):
    """The close pairs of a block with itself (side 0 alone) or of two blocks. A pair is given in the first segment alone in which it meets,
    so that pairs of texts that meet everywhere leave once."""

    def go(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        num = group.column("num").to_numpy()
        code = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint16).reshape(len(num), -1)
        segment = group.column("segment")[0].as_py()
        p = np.flatnonzero(side == 0)
        q = np.flatnonzero(side == 1) if side.any() else p
        found = []
        columns = np.ascontiguousarray(code[q].T)
        for at in range(0, len(p), 256):
            part = code[p[at : at + 256]]
            agree = np.zeros((len(part), len(q)), np.uint8)
            for s, column in enumerate(columns):
                agree += part[:, s, None] == column
            i, j = np.nonzero(agree >= least)
            i, j = p[at + i], q[j]
            on = num[i] < num[j] if q is p else num[i] != num[j]
            i, j = i[on], j[on]
            for lo in range(0, len(i), 50_000):
                x, y = i[lo : lo + 50_000], j[lo : lo + 50_000]
                meets = (code[x] == code[y]).reshape(len(x), segments, width).sum(axis=2) >= width - 1
                first = np.argmax(meets, axis=1) == segment
                found.append(np.stack([num[x[first]], num[y[first]]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return go


def _close(least: int):
    """Keeps pairs (a, b, ca, cb) whose complete codes agree in at least so many symbols."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(batch), -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return go


def _sets(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher(run)
        for batch in batches:
            sets = [hasher(text) for text in batch.column(1).to_pylist()]
            digest = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            yield pa.record_batch([batch.column(0).cast(pa.string()), pa.array(digest, pa.binary()), _lists(sets)], names=["rid", "digest", "members"])

    return go


def _crowded(ws: Workspace, rows: DataFrame, groups: int, crowded: int, name: str) -> DataFrame | None:
    """key, n of the buckets of more than crowded rows; None if there are none. They are looked for among groups of buckets first, whose
    counts add up before the shuffle."""
    group = F.pmod(F.col("key"), F.lit(groups))
    full = ws.write(rows.groupBy(group.alias("group")).count().where(F.col("count") > crowded).select("group"), f"full{name}")
    if full.isEmpty():
        return None
    hot = rows.withColumn("group", group).join(full, "group", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    hot = ws.write(hot, f"hot{name}")
    return None if hot.isEmpty() else hot


def _meet(rows: DataFrame) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.col("a.key") == F.col("b.key")).where("a.num < b.num").select(F.col("a.num").alias("a"), F.col("b.num").alias("b"))


def _candidates(ws: Workspace, coded: DataFrame, segments: int, width: int, crowded: int, least: int, split: int, block: int) -> DataFrame:
    """Distinct pairs a < b of the numbers of coded(num, code) that meet in an index; those of crowded buckets are close already."""
    rows = coded.mapInArrow(_keys(segments, width), "num long, segment int, key long")
    groups = max(1024, coded.count() * segments * width // 64)
    hot = _crowded(ws, rows, groups, crowded, "")
    if hot is None:
        return _meet(rows.select("num", "key")).distinct()
    inside = ws.write(rows.join(hot, "key"), "inside")
    parted = inside.where(F.col("n") > split).join(coded, "num").select("num", "segment", "key", "code").mapInArrow(_inner_keys(segments, width), "num long, segment int, key long")
    parted = ws.write(parted, "parted")
    sizes = parted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    inside = inside.where(F.col("n") <= split).select("num", "segment", "key", "n").unionByName(parted.join(sizes, "key").select("num", "segment", "key", "n"))
    cut = inside.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("num", "segment", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("other") < F.col("own")).cast("int").alias("side"))
    near = cut.join(coded, "num").groupBy("key", "x", "y").applyInArrow(_compare(segments, width, least), "a long, b long")
    return _meet(rows.join(hot, "key", "left_anti").select("num", "key")).unionByName(near).distinct()


class NearDuplicates:
    """Groups of texts with a Jaccard similarity of at least the threshold between sets of token runs.

    texts: id_col (string), text_col and any other columns. Rows with a null id are left out; several rows of one id count once (the
    one of the greatest digest); null, empty and texts of fewer tokens than a run are never similar to anything. Texts with equal sets
    form a class, and only one representative per class is indexed; classes are expanded just where pairs are asked for. Numbers in the
    index are parts of digests: should two classes share one, both are verified.
    """

    def __init__(self, texts: DataFrame, id_col: str, text_col: str, run: int = 5, threshold: float = 0.8, segments: int = SEGMENTS, width: int = WIDTH, crowded: int = CROWDED, split: int = SPLIT, block: int = BLOCK):
        self.ws = Workspace(texts.sparkSession, "near")
        rows = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        prints = self.ws.write(rows.mapInArrow(_fingerprint(run, segments * width), "id string, digest binary, code binary"), "prints")
        one = prints.groupBy("id").agg(F.max("digest").alias("digest"))
        rep = one.groupBy("digest").agg(F.min("id").alias("rid"))
        self.classes = self.ws.write(one.join(rep, "digest").select("id", "rid", "digest"), "classes")
        num = F.conv(F.substring(F.hex("digest"), 2, 15), 16, 10).cast("long").alias("num")
        self.reps = self.classes.where("id = rid").select("rid", "digest", num)
        coded = self.ws.write(prints.groupBy(num).agg(F.any_value("code").alias("code")), "coded")
        self.ws.drop("prints")
        least = self._least(threshold, segments * width)
        met = _candidates(self.ws, coded, segments, width, crowded, least, split, block)
        left, right = coded.select(F.col("num").alias("a"), F.col("code").alias("ca")), coded.select(F.col("num").alias("b"), F.col("code").alias("cb"))
        close = met.join(left, "a").join(right, "b").select("a", "b", "ca", "cb").mapInArrow(_close(least), "a long, b long")
        met = self.ws.write(close, "met")
        self.links = self.ws.write(self._verified(rows, met, run, threshold), "links")
        self.ws.keep("classes", "links")

    @staticmethod
    def _least(threshold: float, symbols: int) -> int:
        """Agreeing symbols that a pair at the threshold has but for one in 10 million: its mean less 5.2 standard deviations."""
        return max(1, int(threshold * symbols - 5.2 * (symbols * threshold * (1 - threshold)) ** 0.5))

    def _verified(self, rows: DataFrame, met: DataFrame, run: int, threshold: float) -> DataFrame:
        """The candidates whose sets are similar enough. Only texts that are in a candidate are read again; their ids are broadcast only
        when counted and few."""
        needed = met.select("a").union(met.select("b")).distinct().withColumnRenamed("a", "num").join(self.reps, "num")
        needed = self.ws.write(needed.select("num", "rid", "digest"), "needed")
        ids = needed.select(F.col("rid").alias("id")).distinct()
        again = rows.join(F.broadcast(ids) if needed.count() <= BROADCAST_ROWS else ids, "id", "left_semi")
        sets = again.mapInArrow(_sets(run), "rid string, digest binary, members array<long>").join(needed, ["rid", "digest"]).dropDuplicates(["rid"])
        sets = self.ws.write(sets.select("num", "rid", "members"), "sets")
        left = sets.select(F.col("num").alias("a"), F.col("rid").alias("ra"), F.col("members").alias("ma"))
        right = sets.select(F.col("num").alias("b"), F.col("rid").alias("rb"), F.col("members").alias("mb"))
        shared, total = F.size(F.array_intersect("ma", "mb")), F.size("ma") + F.size("mb")
        checked = met.join(left, "a").join(right, "b").select("ra", "rb", shared.alias("shared"), total.alias("total"))
        similarity = F.col("shared") / (F.col("total") - F.col("shared"))
        ends = F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")
        return checked.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select(*ends, "similarity")

    def pairs(self) -> DataFrame:
        """All similar pairs of ids, a < b; equal sets have similarity 1. As many rows as there are pairs."""
        c = self.classes
        x, y = c.select(F.col("rid").alias("a"), F.col("id").alias("ia")), c.select(F.col("rid").alias("b"), F.col("id").alias("ib"))
        across = self.links.join(x, "a").join(y, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
        return across.unionByName(self._equal().withColumn("similarity", F.lit(1.0)))

    def _equal(self) -> DataFrame:
        """The pairs of equal texts. Large classes are cut into blocks, and a key of the join stands for two blocks."""
        sizes = self.classes.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1")
        cut = self.classes.join(sizes, "rid").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        cut = cut.select("rid", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
        a = cut.select("rid", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), F.col("id").alias("p"))
        b = cut.select("rid", F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("own").alias("y"), F.col("id").alias("q"))
        return a.join(b, ["rid", "x", "y"]).where("x < y or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    def groups(self) -> DataFrame:
        """One row per text with tokens enough: id, class_id (its representative), n_copies, n_links of the class and group_id (the smallest id linked)."""
        ends = self.links.select("a").union(self.links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("rid")).agg(F.count("*").alias("n_links"))
        part = connected_components(self.links.select("a", "b")).select(F.col("node").alias("rid"), "component")
        copies = self.classes.groupBy("rid").agg(F.count("*").alias("n_copies"))
        return (
            self.classes.join(copies, "rid")
            .join(ends, "rid", "left")
            .join(part, "rid", "left")
            .select("id", F.col("rid").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rid").alias("group_id"))
        )
