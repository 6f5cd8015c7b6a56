"""Queries p3: near-duplicate chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.near_duplicates import NearDuplicates


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(spark.read.parquet(f"{d}/chunks.parquet"), "chunk_id", "content", run=3, threshold=0.6)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs().select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk: its class of equal sets, its links and its group."""
    return _near(spark, d).groups().withColumnRenamed("id", "chunk_id")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

_PAIRS = r"""
t0 AS (SELECT chunk_id, regexp_extract_all(max(content), '[A-Za-z0-9_]+') AS t FROM chunks GROUP BY chunk_id
), g AS (SELECT DISTINCT chunk_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT chunk_id, t, unnest(range(1, len(t) - 1)) AS i FROM t0)
), n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id
), shared AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL
), pairs AS (SELECT a, b, c / (x.n + y.n - c) AS s FROM shared JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE c / (x.n + y.n - c) >= 0.6)
"""

SQL = {"p3_found": f"WITH {_PAIRS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pairs"}
