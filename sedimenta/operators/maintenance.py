"""Ignoring, comparing and maintaining what is stored for a corpus."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import paths as P
from sedimenta.functions import text as T


def skip_reasons(files: DataFrame, cap: int) -> DataFrame:
    """How many files are indexed or skipped, by reason."""
    reason = F.when(F.col("size") > cap, "oversized").when(~T.has_text(F.col("content")), "empty").otherwise("indexed")
    return files.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def glob_regex(pattern: str) -> str:
    """The regular expression of an ignore pattern: a leading or inner slash anchors it at the top, a trailing one means folders, ** spans
    folders, everything below a match matches too."""
    folder = pattern.endswith("/")
    body = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    out = ""
    for part in re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", body):
        out += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part.startswith("[") else re.sub(r"([^\w/ -])", r"\\\1", part))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(files: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """Adds whether a file is ignored: of the rules (pattern, keep) that match, the last decides."""
    verdict = reduce(lambda acc, r: F.when(F.col("rel_path").rlike(glob_regex(r[0])), F.lit(not r[1])).otherwise(acc), rules, F.lit(False))
    return files.withColumn("ignored", verdict)


MOST_RULES = 10_000


def ignore_rules(files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[tuple[str, bool]]:
    """The rules (pattern, keep) that the ignore files of a project state, for ignored(): those of outer folders first, by line.

    files: rel_path, content of one project. The patterns of a nested file hold below its folder. Lines that begin with # and empty ones
    are left out, an exclamation mark keeps. There may be MOST_RULES rules, more raise an error.
    """
    path = F.col("rel_path")
    lines = files.where(P.base(path).isin(*names) & F.col("content").isNotNull()).select(P.folder(path).alias("folder"), "rel_path", F.posexplode(F.split("content", "\\r?\\n")).alias("n", "line"))
    kept = lines.where(~F.col("line").rlike(r"^\s*(?:#|$)")).limit(MOST_RULES + 1).collect()
    if len(kept) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rules = []
    for r in sorted(kept, key=lambda r: (r.rel_path.count("/"), r.rel_path, r.n)):
        keep, pattern = r.line.startswith("!"), r.line.lstrip("!").rstrip()
        if r.folder:
            pattern = f"/{r.folder}/" + (pattern.lstrip("/") if "/" in pattern.rstrip("/") else f"**/{pattern}")
        rules.append((pattern, keep))
    return rules


def without_environments(files: DataFrame) -> DataFrame:
    """Files outside of folders that hold an environment's marker; a join on all folders above a file."""
    marker = files.where(F.col("rel_path").rlike(r"(?:^|/)(?:pyvenv\.cfg|conda-meta/[^/]*)$"))
    roots = marker.select("project", F.regexp_replace("rel_path", r"/?(?:pyvenv\.cfg|conda-meta/[^/]*)$", "").alias("folder")).distinct()
    above = files.select("project", "rel_path", F.explode(P.prefixes(F.col("rel_path"))).alias("folder"))
    inside = above.join(roots, ["project", "folder"]).select("project", "rel_path").distinct()
    return files.join(inside, ["project", "rel_path"], "left_anti")


def directory_hashes(files: DataFrame) -> DataFrame:
    """project, folder, files, hash of the sorted names in each folder."""
    path = F.col("rel_path")
    named = files.select("project", P.folder(path).alias("folder"), P.base(path).alias("base")).distinct()
    return named.groupBy("project", "folder").agg(F.count("*").alias("files"), T.content_hash(F.array_join(F.array_sort(F.collect_list("base")), "\x01")).alias("hash"))


def artifact_texts(parts: DataFrame) -> DataFrame:
    """artifact, files, content: an artifact's text files (artifact, path, text) by path, each under a heading, apart by an empty line."""
    real = parts.where("artifact is not null and text is not null").where(~T.is_binary(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("path", "text")))
    joined = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("# "), r.path, F.lit("\n"), r.text)), "\n\n")
    return real.groupBy("artifact").agg(F.count("*").alias("files"), joined.alias("content"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of old whose key isn't in new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def diff(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """keys, status (added, removed, updated, unchanged) of all keys of either side."""
    a, b = new.select(*keys, F.col(hash_col).alias("_new")), old.select(*keys, F.col(hash_col).alias("_old"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("updated")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def reconcile(hashes: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes whose file still has a chunk; an empty store changes nothing."""
    stored = chunks.select(*keys).distinct()
    if stored.isEmpty():
        return hashes
    return hashes.join(stored, keys, "left_semi").select(*hashes.columns)


def inventory(meta: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    m = meta.where("project is not null").groupBy("project").agg(
        F.bool_or(F.col("collection_name").startswith("codebase")).alias("has_chunk_meta"), F.bool_or(F.col("collection_name").startswith("codegraph")).alias("has_graph_meta")
    )
    c = chunks.groupBy("project").agg(F.countDistinct("chunk_id").alias("chunks"))
    e = edges.groupBy("project").agg(F.count("*").alias("links"))
    every = m.join(c, "project", "full_outer").join(e, "project", "full_outer")
    every = every.withColumns({x: F.coalesce(x, F.lit(False)) for x in ("has_chunk_meta", "has_graph_meta")} | {x: F.coalesce(x, F.lit(0)) for x in ("chunks", "links")})
    state = (
        F.when((F.col("chunks") > 0) & ~F.col("has_chunk_meta"), "chunks without record")
        .when((F.col("links") > 0) & ~F.col("has_graph_meta"), "graph without record")
        .when(F.col("has_chunk_meta") & (F.col("chunks") == 0), "record without chunks")
        .otherwise("consistent")
    )
    return every.withColumn("state", state)


def run_state(reports: DataFrame) -> DataFrame:
    """Per run its last report, the batches reached in any of its reports and how many there are."""
    last = Window.partitionBy("run_id").orderBy(F.desc("reported_at"), F.desc(F.coalesce("files_processed", F.lit(-1))), F.desc(F.coalesce("phase", F.lit(""))))
    top = reports.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("run_id", "project", "run_type", "phase", "files_processed", "files_total")
    sums = reports.groupBy("run_id").agg(F.max(F.coalesce("batches_processed", F.lit(0))).alias("batches_processed"), F.countDistinct("reported_at").alias("n_reports"))
    return top.join(sums, "run_id")
