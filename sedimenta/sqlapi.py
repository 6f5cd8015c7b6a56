"""Registers tables, functions and operators, so that all of it can be used from SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sedimenta.functions import text as T
from sedimenta.operators import search as R
from sedimenta.operators.embedding import Embedder, embed, embed_query

_SCALARS = {
    "content_hash": "CREATE OR REPLACE TEMPORARY FUNCTION content_hash(t STRING) RETURNS STRING RETURN substring(sha2(t, 256), 1, 16)",
    "text_lines": "CREATE OR REPLACE TEMPORARY FUNCTION text_lines(t STRING) RETURNS ARRAY<STRING> RETURN split(t, '\\n', -1)",
    "clean_path": r"CREATE OR REPLACE TEMPORARY FUNCTION clean_path(p STRING) RETURNS STRING RETURN regexp_replace(replace(p, '\\', '/'), '^(?:\\./)+', '')",
    "text_tokens": "CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(t), '[^a-z0-9_]+'), x -> x <> '')",
}


def register(spark: SparkSession, folder: str | None = None) -> list[str]:
    """Registers the functions and, if a folder is given, a view for each parquet table in it; returns the names."""
    names = []
    if folder:
        for entry in sorted(os.listdir(folder.removeprefix("file://"))):
            if entry.endswith(".parquet"):
                spark.read.parquet(f"{folder}/{entry}").createOrReplaceTempView(entry[:-8])
                names.append(entry[:-8])
    for name, statement in _SCALARS.items():
        spark.sql(statement)
        names.append(name)
    for udtf in (SplitText, DeclaredSymbols):
        spark.udtf.register(udtf.sql_name, F.udtf(udtf, returnType=udtf.schema))
        names.append(udtf.sql_name)
    return names


class SplitText:
    """split_text(text, most, boundaries): part, piece."""

    sql_name = "split_text"
    schema = StructType([StructField("part", IntegerType()), StructField("piece", StringType())])

    def eval(self, text: str, most: int, boundaries: str):
        from sedimenta.operators.chunking import split_chars

        if text is not None:
            yield from enumerate(split_chars(text, most, boundaries))


class DeclaredSymbols:
    """declared_symbols(content, language): name, qualified_name, kind, line, end_line."""

    sql_name = "declared_symbols"
    schema = StructType([StructField(n, StringType()) for n in ("name", "qualified_name", "kind")] + [StructField(n, IntegerType()) for n in ("line", "end_line")])

    def eval(self, content: str, language: str):
        from sedimenta.operators.declared import pattern_symbols, python_symbols

        if content is not None:
            yield from (python_symbols(content) or [] if language == "python" else pattern_symbols(content, language or ""))


def _once(chunks: DataFrame, terms: dict[str, object]) -> DataFrame:
    """One row for each chunk whose columns equal all terms but those of None."""
    rows = chunks
    for name, value in terms.items():
        rows = rows if value is None else rows.where(F.col(name) == F.lit(value))
    more = [F.any_value("embedding").alias("embedding")] if "embedding" in chunks.columns else []
    return rows.groupBy("chunk_id").agg(F.max("content").alias("content"), F.max("rel_path").alias("rel_path"), *more)


def _hits(spark: SparkSession, once: DataFrame, query: str, limit: int, embedder: Embedder | None, fusion: int, prefix: str) -> DataFrame:
    """query, id, score, rank, cosine (null without a model) of the best chunks."""
    asked = spark.createDataFrame([(0, query)], "qid long, text string")
    if embedder is None:
        return R.bm25_top_k(once, asked, "chunk_id", "content", limit).withColumn("cosine", F.lit(None).cast("double"))
    ahead = max(3 * limit, 30)
    texts = once.withColumn("text", T.document_text(F.col("rel_path"), F.col("content")))
    lexical = R.bm25_top_k(texts, asked, "chunk_id", "text", ahead)
    vectors = once.where("embedding is not null") if "embedding" in once.columns else embed(texts, "chunk_id", "text", embedder)
    vector = spark.createDataFrame([(0, embed_query(query, embedder, prefix))], "qid long, embedding array<double>")
    dense = R.dense_top_k(vectors.select(F.col("chunk_id").alias("id"), "embedding"), vector, ahead)
    fused = R.top_k(R.rrf([lexical, dense], fusion), ["query"], limit)
    return fused.join(dense.select("id", F.col("score").alias("cosine")), "id", "left").select("query", "id", "score", "rank", "cosine")


def search(
    spark: SparkSession, chunks: DataFrame, query: str, limit: int = 10, file: str | None = None, language: str | None = None, min_score: float = 0.0,
    embedder: Embedder | None = None, fusion: int = 60, prefix: str = "search_query: ", where: dict[str, object] | None = None,
) -> DataFrame:
    """Ranked chunks for a query text: rank, chunk_id, rel_path, score, content.

    Equality filters, of file, language and the columns in where, come first. With a model, search is hybrid: the best of BM25 and those of the cosine of vectors (the chunks' column
    embedding, else worked out) are fused by reciprocal ranks; without one it is BM25 alone. Then the limit (1 to 50), then the threshold.
    """
    if not query or not query.strip():
        raise ValueError("the query is empty")
    once = _once(chunks, {"rel_path": file or None, "language": language or None} | (where or {}))
    hits = _hits(spark, once, query, max(1, min(50, limit)), embedder, fusion, prefix)
    return R.at_least(hits, min_score).join(once, F.col("id") == once.chunk_id).select("rank", "chunk_id", "rel_path", "score", "content").orderBy("rank")


def search_linked(spark: SparkSession, collections: list[tuple[str, DataFrame]], query: str, limit: int = 10, embedder: Embedder | None = None, fusion: int = 60) -> DataFrame:
    """Ranked files over several collections (label, chunks): rank, label, rel_path, chunk_id, score.

    The first of two collections of one label counts. Each gives max(2 limit, 20) chunks. Where all hits have a cosine the best chunk of
    each file stands for it by cosine, else the reciprocal ranks of a file's chunks are added up. Ties go to the collection named first.
    """
    if not query or not query.strip():
        raise ValueError("the query is empty")
    limit = max(1, min(50, limit))
    seen: dict[str, DataFrame] = {}
    for label, chunks in collections:
        seen.setdefault(label, chunks)
    every = None
    for place, (label, chunks) in enumerate(seen.items()):
        once = _once(chunks, {})
        hits = _hits(spark, once, query, max(2 * limit, 20), embedder, fusion, "search_query: ").join(once.select(F.col("chunk_id").alias("id"), "rel_path"), "id")
        hits = hits.withColumns({"label": F.lit(label), "place": F.lit(place)})
        every = hits if every is None else every.unionByName(hits)
    if every is None:
        return spark.createDataFrame([], "rank int, label string, rel_path string, chunk_id string, score double")
    whole = every.agg(F.coalesce(F.bool_and(F.col("cosine").isNotNull()), F.lit(False)).alias("ok"))
    ranked = every.crossJoin(whole).groupBy("label", "place", "rel_path").agg(
        F.max("cosine").alias("cosine"), F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"), F.bool_and("ok").alias("ok"),
        F.when(F.bool_and("ok"), F.max_by("id", F.struct("cosine", -F.col("rank")))).otherwise(F.min_by("id", "rank")).alias("chunk_id"),
    )
    scored = ranked.withColumn("score", F.when(F.col("ok"), F.col("cosine")).otherwise(F.round("rrf", 9)))
    best = scored.orderBy(F.desc("score"), "place", "rel_path").limit(limit)
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "place", "rel_path")).alias("rank"), "label", "rel_path", "chunk_id", "score").orderBy("rank")


__all__ = ["DeclaredSymbols", "SplitText", "register", "search", "search_linked"]
