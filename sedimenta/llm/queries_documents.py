"""Queries p8, p9 and p10 on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.encoding_repair import repair_encoding
from sedimenta.llm.mixing import epochs, mix_sources
from sedimenta.llm.packing import fill_report, pack


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_documents(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(pack(_documents(spark, d)))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return epochs(mix_sources(_documents(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet")).taken)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_documents(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet")).shares


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_encoding(_documents(spark, d)).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with what could be restored."""
    return repair_encoding(_documents(spark, d)).selectExpr("doc_id", "restored", "complete", "array_join(pairs, ', ') as pairs")


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict = {}
