"""An index of vectors by cells: searches read a part of the vectors, at a recall measured when the index is fitted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.search import Best, top_k, unit_rows
from sedimenta.plans.workspace import Workspace

SAMPLE = 50_000  # vectors that the cells and the number of probes are fitted on, at most
MOST_CELLS = 4096
SLICE = 50_000  # rows of a cell that a task searches at once


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def centres(m: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit vectors around which the rows of m gather."""
    r = np.random.default_rng(seed)
    c = m[r.choice(len(m), cells, replace=False)]
    for _ in range(rounds):
        near = np.argmax(m @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, m)
        empty = np.bincount(near, minlength=cells) == 0
        sums[empty] = m[r.choice(len(m), int(empty.sum()))]
        c = _unit(sums)
    return c


def probes_for(m: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest cells hold the share recall of the k nearest rows of m, for a fifth of the rows as queries."""
    cell = np.argmax(m @ c.T, axis=1)
    held = m[::5][:1000]
    near = np.argsort(-(held @ c.T), axis=1)
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(len(c))[None, :], axis=1)
    best = np.argsort(-(held @ m.T), axis=1)[:, 1 : k + 1]  # without the row itself
    if not best.size:
        return len(c)
    needed = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


class VectorIndex:
    """Vectors (id, embedding) in cells around centres; every row is indexed, but null, empty and zero vectors and those of another length
    than most of the sample.

    Centres and the number of cells that a search probes are fitted on at most `sample` vectors chosen by hash: as many as hold the share
    `recall` (with a margin) of the nearest vectors of held-out ones. In data without structure that is a large part of all cells.
    """

    def __init__(self, vectors: DataFrame, recall: float = 0.9, k: int = 10, sample: int = SAMPLE, cells: int | None = None):
        self.spark, self.ws = vectors.sparkSession, Workspace(vectors.sparkSession, "vectors")
        rows = vectors.where("id is not null and size(embedding) > 0").select("id", F.col("embedding").cast("array<double>"))
        n = rows.count()
        part = F.pmod(F.xxhash64("id"), F.lit(1_000_000_000))
        picked = rows.where(part < 1e9 * min(1.0, sample / max(1, n))).select(part.alias("p"), "embedding").limit(sample + sample // 10).collect()
        picked = [np.array(r.embedding, float) for r in sorted(picked, key=lambda r: (r.p, r.embedding))]
        self.size = max((len(v) for v in picked), key=[len(v) for v in picked].count, default=0)
        m = np.stack([v for v in picked if len(v) == self.size and np.isfinite(v).all() and v.any()] or [np.zeros(self.size)])
        m = _unit(m)
        self.centres = centres(m, max(1, min(MOST_CELLS, cells or int(2 * n**0.5), len(m))))
        self.probes = probes_for(m, self.centres, k, min(1.0, recall + 0.03))
        self.kind = vectors.schema["id"].dataType.simpleString()
        placed = rows.mapInArrow(self._assign(1), f"id {self.kind}, embedding array<float>, cell int")
        self.table = self.ws.write(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (len(self.centres) * SLICE))))), "cells")
        # one row per cell
        self.slices = {r.cell: 1 + r["count"] // SLICE for r in self.table.groupBy("cell").count().collect()}

    def _assign(self, probes: int):
        size, c = self.size, self.centres

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, at = unit_rows(b.column(1), size)
                if len(m):
                    near = np.argpartition(-(m @ c.T), probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(m), 1))
                    row = np.repeat(np.arange(len(m)), near.shape[1])
                    offsets = pa.array(np.arange(len(row) + 1, dtype=np.int32) * size)
                    vectors = pa.ListArray.from_arrays(offsets, pa.array(m.astype("float32")[row].ravel()))
                    yield pa.record_batch([b.column(0).take(pa.array(at[row])), vectors, pa.array(near.ravel().astype("int32"))], names=["id", "embedding", "cell"])

        return go

    def _slice(self, cell: Column) -> Column:
        pairs = [F.lit(x) for kv in self.slices.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), cell), F.lit(1)) if pairs else F.lit(1)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query, id, score, rank: of the vectors in the cells nearest to each query (qid, embedding) the k of greatest cosine. Queries go to
        the slices of their cells, and k hits per query and slice are merged."""
        kind = queries.schema["qid"].dataType.simpleString()
        asked = queries.where("qid is not null and size(embedding) > 0").select(F.col("qid").alias("id"), F.col("embedding").cast("array<double>"))
        asked = asked.mapInArrow(self._assign(self.probes), f"id {kind}, embedding array<float>, cell int")
        asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), (self._slice(F.col("cell")) - 1).cast("int"))))
        rows = self.table.withColumn("slice", F.pmod(F.xxhash64("id"), self._slice(F.col("cell")).cast("int")).cast("int"))

        def product(x: pa.Table, y: pa.Table) -> pa.Table:
            qids, ids, rows = x.column("id").to_pylist(), y.column("id").combine_chunks(), []
            if qids and len(ids):
                a, b = (t.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(len(t), -1) for t in (x, y))
                best = Best(k)
                for qid, row in zip(qids, np.round(a @ b.T, 6), strict=True):
                    best.add((qid,), row, np.arange(len(row)), ids)
                rows = best.rows()
            return pa.table({"query": pa.array([r[0] for r in rows], x.schema.field("id").type), "id": pa.array([r[1] for r in rows], y.schema.field("id").type), "score": pa.array([r[2] for r in rows], pa.float64())})

        hits = asked.groupBy("cell", "slice").cogroup(rows.groupBy("cell", "slice")).applyInArrow(product, f"query {kind}, id {self.kind}, score double")
        return top_k(hits, ["query"], k)
