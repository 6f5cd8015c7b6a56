"""Keeps the index of a project: files to chunks to vectors, stored as a whole, brought up to date by what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import maintenance as M
from sedimenta.operators.chunking import chunk_files
from sedimenta.operators.embedding import Embedder, embed
from sedimenta.plans.workspace import Workspace
from sedimenta.store import Store


@dataclass
class Changes:
    added: int
    updated: int
    removed: int
    unchanged: int


def _names(project: str) -> tuple[str, str, str]:
    return f"codebase_{project}", f"hashes_{project}", f"status_{project}"


def update_index(store: Store, project: str, files: DataFrame, embedder: Embedder, most_bytes: int = 5_000_000, prefix: str = "search_document: ") -> Changes:
    """Indexes files (rel_path, content, language) of a project; at the first call all of them, then those whose hash changed.

    Files above most_bytes count as removed. Chunks of changed and removed files are replaced in one new generation, which is published
    before the hashes; a run that dies between the two repeats these files, one that dies before leaves the index as it was. A status of
    in-progress that no run ended makes the next one drop the hashes of files without chunks first.
    """
    chunks, hashes, status = _names(project)
    spark = store.spark
    ws = Workspace(spark, "index")
    usable = files.where(F.col("content").isNotNull() & (F.octet_length("content") <= most_bytes))
    now = usable.select("rel_path", T.content_hash(F.col("content")).alias("hash")).groupBy("rel_path").agg(F.max("hash").alias("hash"))
    empty = spark.createDataFrame([], "rel_path string, hash string")
    old = store.read(hashes) if store.exists(hashes) else empty
    before = store.record(status)
    if before and before["state"] != "completed" and store.exists(chunks):
        old = M.reconcile(old, store.read(chunks), ["rel_path"])
    store.save_record(status, {"state": "in-progress"})
    diff = ws.write(M.diff(old, now, ["rel_path"], "hash"), "diff")
    counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    touched = diff.where("status <> 'unchanged'").select("rel_path")
    if counts.keys() - {"unchanged"} or not store.exists(chunks):
        fresh = usable.dropDuplicates(["rel_path"]).join(diff.where("status in ('added', 'updated')").select("rel_path"), "rel_path", "left_semi")
        cut = ws.write(chunk_files(fresh), "cut")
        text = T.document_text(F.col("rel_path"), F.col("content"), prefix)
        vectors = embed(cut.withColumn("text", text), "chunk_id", "text", embedder)
        new = cut.join(vectors, "chunk_id").withColumn("project", F.lit(project))
        kept = store.read(chunks).join(touched, "rel_path", "left_anti") if store.exists(chunks) else None
        store.write(chunks, new if kept is None else kept.unionByName(new))
        store.write(hashes, now)
    total = sum(counts.get(k, 0) for k in ("added", "updated", "unchanged"))
    store.save_record(status, {"state": "completed", "files": total, "dimensions": embedder.dimensions})
    ws.close()
    return Changes(*(counts.get(k, 0) for k in ("added", "updated", "removed", "unchanged")))


def index_status(store: Store, project: str) -> dict:
    """What is stored of a project: state, files, chunks."""
    chunks, _, status = _names(project)
    record = store.record(status) or {"state": "absent"}
    return record | {"chunks": store.read(chunks).count() if store.exists(chunks) else 0}


def remove_index(store: Store, project: str) -> None:
    chunks, hashes, status = _names(project)
    for name in (chunks, hashes):
        store.drop(name)
    store.drop_record(status)


def indexed_chunks(store: Store, project: str) -> DataFrame:
    return store.read(_names(project)[0])
