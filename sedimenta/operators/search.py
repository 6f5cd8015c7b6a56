"""Lexical and dense retrieval, and merging of ranked lists. Ties always go to the smaller id."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.plans.workspace import Workspace

BLOCK = 1000  # queries that one pass over the documents or vectors answers
_TOKEN = re.compile(r"[a-z0-9_]+")


def top_k(hits: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each group with their rank from 1; Spark prunes each partition to k rows per group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf and dl (tokens of the document) of every document with a token; null texts have none."""
    terms = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("terms")).where("size(terms) > 0")
    each = terms.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, id, score of every document that shares a term with a query (qid, text), whose distinct terms count once each.

    Statistics come from all documents; only postings of terms that occur in queries are joined.
    """
    asked = queries.select(F.col("qid").alias("query"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    entries = postings(docs, id_col, text_col)
    stats = docs.select(F.size(T.tokens(F.col(text_col))).alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("avgdl")).first()
    used = entries.join(asked.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    weighed = used.join(df, "term")
    idf = F.ln(1 + (F.lit(stats.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats.avgdl or 1.0)))
    return weighed.select("term", "id", part.alias("part")).join(asked, "term").groupBy("query", "id").agg(F.round(F.sum("part"), 6).alias("score"))


class Best:
    """The k best hits of each query so far: greatest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, key: tuple, scores: np.ndarray, at: np.ndarray, ids: pa.Array) -> None:
        """Offers the hits at these places of a batch; scores go with at."""
        if len(at) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            on = scores >= least
            scores, at = scores[on], at[on]
        kept = self.kept.get(key, [])
        if len(kept) == self.k:
            on = scores >= -kept[-1][0]
            scores, at = scores[on], at[on]
        if len(at):
            every = kept + [(-s, i) for s, i in zip(scores.tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)]
            self.kept[key] = sorted(every)[: self.k]

    def rows(self) -> list[tuple]:
        return [(*key, i, -s + 0.0) for key, hits in self.kept.items() for s, i in hits]


def _in_blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    """Queries in parts of about a block each, by hash; what is collected at once is one of them."""
    n = max(1, -(-queries.count() // block))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def forward_index(docs: DataFrame, id_col: str, text_col: str, keep: Column | None = None) -> DataFrame:
    """id, kept, dl, terms, tfs: the distinct tokens of every document with a token and how often each occurs. A map over the documents.
    kept says whether keep holds; rows without an id or a text are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.lit(True) if keep is None else keep, F.lit(False)).alias("kept"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [Counter(_TOKEN.findall(t.lower())) for t in b.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, counted)]).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array([t for c in counted for t in c], pa.string()))
            tfs = pa.ListArray.from_arrays(offsets, pa.array([n for c in counted for n in c.values()], pa.int32()))
            dl = pa.array([c.total() for c in counted], pa.int32())
            out = pa.record_batch([b.column(0), b.column(2), dl, terms, tfs], names=["id", "kept", "dl", "terms", "tfs"])
            yield out.filter(pc.greater(dl, 0))

    return rows.where("id is not null and text is not null").mapInArrow(go, f"id {kind}, kept boolean, dl int, terms array<string>, tfs array<int>")


def bm25_top_k(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, keep: Column | None = None, k1: float = 1.2, b: float = 0.75, block: int = BLOCK) -> DataFrame:
    """query, id, score, rank: the k documents of greatest BM25 for each query (qid, text), whose distinct terms count once each.

    Statistics come from all documents; only those for which keep holds (a condition on docs) are scored. The documents are tokenized once
    into a forward index. A block of queries then goes to all of its partitions, which score their documents against it and send on k
    hits per query; postings aren't shuffled, so a term that all documents hold is no hot key.
    """
    ws = Workspace(docs.sparkSession, "bm25")
    index = ws.write(forward_index(docs, id_col, text_col, keep), "index")
    stats = index.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first()
    number, avgdl = stats.docs, stats.avgdl or 1.0
    asked = ws.write(queries.select("qid", F.array_distinct(T.tokens(F.col("text"))).alias("terms")).where("qid is not null and size(terms) > 0"), "asked")
    seen = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    seen = ws.write(seen.join(asked.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi"), "seen")
    kinds = queries.schema["qid"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    scored = index.where("kept").select("id", "dl", "terms", "tfs")
    hits = None
    for part in _in_blocks(asked, block):
        rows = part.collect()
        terms = seen.join(part.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").orderBy("term").collect() if rows else []
        score = _bm25_scores([r.qid for r in rows], [r.terms for r in rows], {r.term: i for i, r in enumerate(terms)}, np.array([r.df for r in terms], float), number, avgdl, k, k1, b)
        found = scored.mapInArrow(score, f"query {kinds[0]}, id {kinds[1]}, score double")
        hits = found if hits is None else hits.unionByName(found)
    return top_k(hits, ["query"], k)


def _bm25_scores(qids: list, queries: list[list[str]], number: dict[str, int], df: np.ndarray, docs: int, avgdl: float, k: int, k1: float, b: float) -> Callable:
    idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
    columns = [np.array(sorted(number[t] for t in q if t in number), np.int64) for q in queries]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, schema = pa.array(list(number), pa.string()), Best(k), None
        for batch in batches:
            schema = schema or batch.schema
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            column = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            tf = batch.column("tfs").flatten().to_numpy().astype(float)
            doc = np.repeat(np.arange(len(batch)), sizes)
            on = column >= 0
            order = np.argsort(column[on], kind="stable")
            column, doc, tf = column[on][order], doc[on][order], tf[on][order]
            dl = batch.column("dl").to_numpy().astype(float)
            weight = idf[column] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
            starts = np.searchsorted(column, np.arange(len(idf) + 1))
            for qid, cols in zip(qids, columns, strict=True):
                spans = [slice(starts[c], starts[c + 1]) for c in cols]
                at = np.concatenate([doc[s] for s in spans]) if spans else np.empty(0, np.int64)
                if len(at):
                    total = np.round(np.bincount(at, np.concatenate([weight[s] for s in spans]), len(batch)), 6)
                    hit = np.flatnonzero(np.bincount(at, minlength=len(batch)))
                    best.add((qid,), total[hit], hit, batch.column("id"))
        yield from _hit_batch(best.rows(), ["query", "id", "score"], schema)

    return go


def _hit_batch(rows: list[tuple], names: list[str], schema: pa.Schema | None) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [pa.array([r[i] for r in rows]) for i in range(len(names))]
        columns[names.index("id")] = columns[names.index("id")].cast(schema.field("id").type)
        yield pa.record_batch(columns, names=names)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; null if lengths differ or a norm is zero."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    same = F.when(F.size(x) == F.size(y), dot(x, y))
    return F.try_divide(same, F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def unit_rows(lists: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a length among lists, normalized, and their places; those with a null or of length 0 are left out."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == size)
    values = lists.take(pa.array(at)).flatten()
    m = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
    norm = np.linalg.norm(m, axis=1)
    real = norm > 0
    return m[real] / norm[real, None], at[real]


def _dense_scores(qids: list, vectors: list[list[float]], k: int) -> Callable:
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_size.setdefault(len(v), []).append(i)
    asked = {n: np.array([vectors[i] for i in rows], float) for n, rows in by_size.items()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, schema = Best(k), None
        for batch in batches:
            schema = schema or batch.schema
            groups = batch.column("grp").dictionary_encode()
            names, code = groups.dictionary.to_pylist(), pc.fill_null(groups.indices, -1).to_numpy(zero_copy_only=False)
            for n, rows in by_size.items():
                m, at = unit_rows(batch.column("embedding"), n)
                a = asked[n]
                norm = np.linalg.norm(a, axis=1)
                scores = np.round((a / np.where(norm > 0, norm, 1)[:, None]) @ m.T, 6)
                for g, name in [*enumerate(names), *([(-1, None)] if (code < 0).any() else [])]:
                    mine = np.flatnonzero(code[at] == g)
                    for p in np.flatnonzero(norm > 0) if len(mine) else ():
                        best.add((qids[rows[p]], name), scores[p, mine], at[mine], batch.column("id"))
        yield from _hit_batch(best.rows(), ["query", "grp", "id", "score"], schema)

    return go


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None, block: int = BLOCK, keep: Column | None = None) -> DataFrame:
    """query, id (, by), score, rank: the k vectors of greatest cosine for each query, within each value of by if given.

    vectors: id, embedding (, by); queries: qid, embedding. An exact search: a block of queries goes to all partitions of the vectors, each
    batch of which is one matrix product, and k hits per query are sent on; vectors aren't shuffled. Null, empty and zero vectors and those
    of another length than the query's are left out, and so are vectors for which keep doesn't hold.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = vectors if keep is None else vectors.where(keep)
    rows = rows.where(usable & F.col("id").isNotNull()).select("id", "embedding", (F.col(by).cast("string") if by else F.lit("")).alias("grp"))
    asked = queries.where(usable & F.col("qid").isNotNull()).select("qid", "embedding")
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    hits = None
    for part in _in_blocks(asked, block):
        q = part.collect()
        found = rows.mapInArrow(_dense_scores([r.qid for r in q], [r.embedding for r in q], k), f"query {kinds[0]}, grp string, id {kinds[1]}, score double")
        hits = found if hits is None else hits.unionByName(found)
    best = top_k(hits, ["query", "grp"], k)
    return best.withColumnRenamed("grp", by) if by else best.drop("grp")


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """query, id, score: reciprocal-rank fusion of lists (query, id, rank from 1)."""
    every = None
    for x in lists:
        x = x.select("query", "id", "rank")
        every = x if every is None else every.unionByName(x)
    return every.groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def rrf_merge(hits: DataFrame, k: int = 60) -> DataFrame:
    """Merges lists of several collections: hits(query, label, rank from 1, key, id). A key that occurs several times in its list
    accumulates; its first occurrence stands for it."""
    return hits.groupBy("query", "label", "key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min_by("id", "rank").alias("id"))


def cosine_merge(hits: DataFrame) -> DataFrame:
    """Like rrf_merge by cosine: the best hit of each key. Only queries of whose hits all have a score are merged."""
    whole = hits.groupBy("query").agg(F.bool_and(F.col("score").isNotNull()).alias("ok")).where("ok")
    return hits.join(whole, "query", "left_semi").groupBy("query", "label", "key").agg(F.max("score").alias("score"), F.max_by("id", F.struct("score", -F.col("id"))).alias("id"))


def at_least(hits: DataFrame, least: float) -> DataFrame:
    """A score threshold, to be applied after the limit; 0 leaves all."""
    return hits.where(F.col("score") >= least) if least else hits


def hashed_embedding(texts: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """A deterministic stand-in for an embedding model: signed hashed term frequencies, normalized to length 1; zero without tokens."""
    kind = texts.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for slots, signs in zip(b["slots"], b["signs"], strict=True):
                v = np.zeros(dims)
                np.add.at(v, np.asarray(slots, dtype=int), np.asarray(signs, dtype=float))
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype("float32"))
            yield pd.DataFrame({"id": b["id"], "embedding": out})

    terms = texts.select(F.col(id_col).alias("id"), F.coalesce(T.tokens(F.col(text_col)), F.array().cast("array<string>")).alias("terms"))
    hashed = terms.select(
        "id",
        F.transform("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(dims))).alias("slots"),
        F.transform("terms", lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("signs"),
    )
    return hashed.mapInPandas(go, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)
