"""Queries p2, p4, p5 and p7 on source files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.credentials import redact, scan
from sedimenta.llm.provenance import provenance
from sedimenta.llm.source_files import source_files
from sedimenta.llm.splitting import split_oversized
from sedimenta.llm.syntax import check_syntax, syntax_rates


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/chunks.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return check_syntax(source_files(_chunks(spark, d))).where("not valid").select("project", "rel_path")


def p2_causes(spark: SparkSession, d: str) -> DataFrame:
    """Each invalid file with the furthest failure and its cause."""
    return check_syntax(source_files(_chunks(spark, d))).where("not valid").drop("valid")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax_rates(check_syntax(source_files(_chunks(spark, d))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance(source_files(_chunks(spark, d))).where("kind is not null").select("project", "rel_path")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its kind (null: hand-written) and how far its fingerprints recur."""
    return provenance(source_files(_chunks(spark, d))).selectExpr("project", "rel_path", "kind", "round(recurring, 6) as recurring")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan(_chunks(spark, d)).select("chunk_id", F.col("line").alias("line_no")).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The content of each chunk that holds credentials, without them."""
    row = F.max(F.struct("content", "rel_path", "start_line")).alias("row")
    once = _chunks(spark, d).groupBy("chunk_id").agg(row, F.max("language").alias("language")).select("chunk_id", "row.*", "language")
    return redact(once, scan(once))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(_chunks(spark, d)).where("piece_no > 0")
    return pieces.select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    once = _chunks(spark, d).where("length(content) > 2000").dropDuplicates(["chunk_id"])
    return split_oversized(once)


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds, "p5_found": p5_found, "p5_redacted": p5_redacted, "p7_found": p7_found, "p7_pieces": p7_pieces, "p2_found": p2_found, "p2_causes": p2_causes, "p2_rates": p2_rates}
SQL = {"p7_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) > 2000"}
