"""Change feeds: the same functions serve static tables and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(changes: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """key, start, last, n of each burst of changes: a burst ends when none follows within gap. late is a stream's watermark; on a stream,
    use append mode, which hands a burst on once it has ended."""
    rows = changes.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    burst = F.session_window(time, gap).alias("w")
    return rows.groupBy(key, burst).agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n")).drop("w")


def last_changes(changes: DataFrame, quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """project, rel_path, kind, ts: of each burst of changes to a file the last."""
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy("project", "rel_path", F.session_window("ts", quiet).alias("w"))
    return grouped.agg(F.max_by("kind", F.struct("ts", "change_id")).alias("kind"), F.max("ts").alias("ts")).drop("w")


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, total of value in each window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def relevant(changes: DataFrame, keep) -> DataFrame:
    """Changes to files that are indexed; keep(path column) tells which. Deletions of any file pass."""
    return changes.where((F.col("kind") == "delete") | keep(F.col("rel_path")))


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands a stream's micro-batches to work, one after the other; a batch that failed is repeated from the checkpoint. With once, all that
    is there is processed and the query ends."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
