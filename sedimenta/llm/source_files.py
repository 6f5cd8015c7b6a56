"""Whole files from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The language of a file name extension.
EXTENSION_LANGUAGE = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "mts": "typescript", "cts": "typescript", "go": "go", "java": "java", "rs": "rust", "sh": "shell", "bash": "shell", "json": "json", "yaml": "yaml", "yml": "yaml",
    "md": "markdown", "txt": "plaintext",
}


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def source_files(chunks: DataFrame) -> DataFrame:
    """project, rel_path, language, text of every file of chunks.

    A file's text is the content of its chunks, one row per chunk_id, by start_line and joined by a newline. Where no row of a file has a
    language, the extension tells it, else it stays null. Null project or rel_path count as the empty string, null content as empty;
    a chunk_id delivered with two contents counts with the greater one.
    """
    part = F.struct("chunk_id", "start_line", F.coalesce("content", F.lit("")).alias("content"))
    files = chunks.groupBy(F.coalesce("project", F.lit("")).alias("project"), F.coalesce("rel_path", F.lit("")).alias("rel_path")).agg(
        F.max("language").alias("language"), F.collect_set(part).alias("parts")
    )
    ordered = F.transform(F.array_sort(F.transform("parts", lambda p: F.struct(p.start_line, p.chunk_id, p.content))), lambda p: p)
    # equal chunk_ids lie side by side unless their start lines differ; of those with one id the last is kept
    kept = F.filter(ordered, lambda p, i: ~F.coalesce(F.get(ordered, i + 1).chunk_id.eqNullSafe(p.chunk_id), F.lit(False)))
    text = F.when(F.size("parts") == 1, F.col("parts")[0].content).otherwise(F.array_join(F.transform(kept, lambda p: p.content), "\n"))
    return files.select("project", "rel_path", F.coalesce("language", language_of(F.col("rel_path"))).alias("language"), text.alias("text"))
