"""Files of a corpus from tables and from trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import language as L
from sedimenta.functions import paths as P
from sedimenta.functions import text as T


def files_from_documents(documents: DataFrame) -> DataFrame:
    """Each document as a file of the project that is its source."""
    source = F.coalesce("source", F.lit(""))
    return documents.where("text is not null").select(
        F.concat_ws("/", source, F.col("doc_id").cast("string")).alias("rel_path"), source.alias("project"), F.col("text").alias("content"), F.octet_length("text").alias("size"), T.content_hash(F.col("text")).alias("content_hash")
    )


def files_from_chunks(chunks: DataFrame, content: bool = False) -> DataFrame:
    """The files of a chunk table; with content, their text and language: chunks once per id, by start line, joined by newlines."""
    if not content:
        return chunks.select("project", "rel_path").distinct()
    once = chunks.groupBy("project", "rel_path", "chunk_id").agg(F.max("content").alias("content"), F.max("start_line").alias("start_line"), F.max("language").alias("language"))
    parts = F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "content")))
    files = once.groupBy("project", "rel_path").agg(F.array_join(F.transform(parts, lambda p: p.content), "\n").alias("content"), F.max("language").alias("language"))
    return files.withColumn("language", F.coalesce("language", L.language_of(F.col("rel_path"))))


def scan_tree(spark: SparkSession, root: str, max_bytes: int = 5_000_000, extra: tuple[str, ...] = ()) -> DataFrame:
    """Indexable text files below a folder: rel_path, content, size, language, content_hash. Names decide; files without an extension are
    looked into; binaries and files above max_bytes are left out before they are read as text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quoted(base) + "/", "")
    rows = raw.where(F.col("length") <= max_bytes).select(path.alias("rel_path"), F.col("length").alias("size"), "content")
    head = F.decode(F.substring(F.col("content"), 1, T.HEAD_BYTES), "UTF-8")
    seen = F.when(P.extension(F.col("rel_path")) == "", L.sniffed_extension(head))
    rows = rows.withColumn("_seen", seen).where(L.is_indexable(F.col("rel_path"), extra) | F.col("_seen").isNotNull()).where(F.instr(F.hex(F.substring(F.col("content"), 1, T.HEAD_BYTES)), "00") % 2 == 0)
    text = F.decode("content", "UTF-8")
    language = F.when(F.col("_seen").isNotNull(), L.language_of(F.concat(F.lit("x"), "_seen"))).otherwise(L.language_of(F.col("rel_path")))
    return rows.select("rel_path", text.alias("content"), "size", language.alias("language"), T.content_hash(text).alias("content_hash"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)
