"""Recomputes only the partitions whose inputs changed since the last successful run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, MapType, StructField, StructType

from sedimenta.plans.workspace import remove

FINGERPRINTS = "part int, source string, n bigint, a bigint, b bigint, c bigint, d bigint"
LAYOUT = "scope string, first int, parts int"
PART_ROWS = 250_000  # input rows that a partition is laid out for
LEAST_PARTS = 16
GROWTH = 4  # a table that outgrows its layout by this gets a new one


def partition_of(buckets: int, *keys: str) -> Column:
    """A partition number from the hash of the whole key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _hash(df: DataFrame, *seed: Column) -> Column:
    """A hash of all columns by name; nulls count, so shifting a value to another column changes it."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        cols += [c.cast("string") if isinstance(f.dataType, MapType) else c, c.isNull()]
    return F.xxhash64(*seed, *cols)


def fingerprints(df: DataFrame, source: str, part: Column) -> DataFrame:
    """Per partition: row count and sums of the halves of two row hashes; a column _part isn't hashed. Sums don't depend on the order of
    rows and combine map-side; halves keep them within 64 bits up to two thousand million rows a partition."""
    rows = df.drop("_part")
    x, y = _hash(rows), _hash(rows, F.lit("second"))
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    halves = (("a", "x", low), ("b", "x", high), ("c", "y", low), ("d", "y", high))
    return df.select(part.alias("part"), x.alias("x"), y.alias("y")).groupBy("part").agg(
        F.lit(source).alias("source"), F.count("*").alias("n"), *(F.sum(half(F.col(h))).alias(name) for name, h, half in halves)
    )


class IncrementalTable:
    """A result table kept partition by partition.

    Partitions follow the first key column, the scope: scopes of few rows share partitions by their hash, those of many get several of
    their own by the hash of the remaining keys. So a change within one scope touches few partitions, and a scope with a third of all
    rows is spread. How many partitions there are comes from the number of rows at the first refresh, and again when the table has grown
    by GROWTH. With buckets, there are so many partitions instead, by the hash of the whole key.

    refresh() compares each partition's fingerprints of every input with those of the last finished run, recomputes the partitions that
    differ and replaces each of them as a whole by dynamic partition overwrite. A partition whose new result is empty is replaced too:
    every replaced partition holds one marker row. Before the overwrite the partitions are noted as an intent, and the fingerprints are
    published last, as a new generation named by one small file. A run that dies at any point thus leaves an intent, whose partitions
    the next run recomputes whatever their fingerprints say, as they may hold rows of the inputs that the dead run saw. One writer at a
    time; what dead runs left is removed by the next one that finishes.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, part_rows: int = PART_ROWS):
        self.spark, self.root, self.buckets, self.part_rows = spark, root.rstrip("/"), buckets, part_rows
        self._jvm = spark.sparkContext._jvm
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("."))
        last = self._last()
        if last and last["buckets"] != buckets:
            raise ValueError(f"the table has {last['buckets']} partitions, not {buckets}")

    def _names(self, prefix: str) -> list[str]:
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path("."))) if n.startswith(prefix))

    def _put(self, name: str, content: dict) -> None:
        """Writes a small file that is there as a whole or not at all."""
        out = self._fs.create(self._path(f"_{name}"), True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.rename(self._path(f"_{name}"), self._path(name))

    def _get(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _last(self) -> dict | None:
        done = self._names("done-")
        return self._get(done[-1]) | {"number": int(done[-1].split("-")[1])} if done else None

    def _lay_out(self, inputs: dict[str, DataFrame], keys: tuple[str, ...], name: str) -> int:
        """Writes which partitions belong to which scope, a row for each scope of more than part_rows rows, of which there are no more than
        partitions, and one with a null scope for all others. Returns the number of rows."""
        rows = reduce(DataFrame.unionByName, [df.select(F.xxhash64(keys[0]).alias("scope")) for df in inputs.values()])
        counted = rows.groupBy("scope").agg(F.count("*").alias("n"))
        few = F.sum(F.when(F.col("n") <= self.part_rows, F.col("n")))
        total, small = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(few, F.lit(0))).first()
        first = max(LEAST_PARTS, min(100_000, 4 * small // self.part_rows))
        layout = [(None, 0, first)]
        for r in counted.where(F.col("n") > self.part_rows).orderBy("scope").collect() if small < total else ():
            layout.append((str(r.scope), first, 1 + r.n // self.part_rows))
            first += layout[-1][2]
        self.spark.createDataFrame(layout, LAYOUT).coalesce(1).write.parquet(f"{self.root}/{name}")
        return int(total)

    def _placed(self, df: DataFrame, keys: tuple[str, ...], layout: str) -> DataFrame:
        """df with the column _part."""
        if self.buckets:
            return df.withColumn("_part", partition_of(self.buckets, *keys))
        table = self.spark.read.schema(LAYOUT).parquet(f"{self.root}/{layout}")
        shared = table.where("scope is null").first().parts
        own = F.broadcast(table.where("scope is not null").select(F.col("scope").alias("_scope"), F.col("first").alias("_first"), F.col("parts").alias("_parts")))
        spread = F.col("_first") + F.pmod(F.xxhash64(*(keys[1:] or keys)), F.col("_parts"))
        part = F.when(F.col("_first").isNull(), F.pmod(F.xxhash64(keys[0]), F.lit(shared))).otherwise(spread)
        joined = df.withColumn("_scope", F.xxhash64(keys[0]).cast("string")).join(own, "_scope", "left")
        return joined.withColumn("_part", part.cast("int")).drop("_scope", "_first", "_parts")

    def _prints(self, inputs: dict[str, DataFrame], keys: tuple[str, ...], layout: str, name: str) -> DataFrame:
        every = [fingerprints(self._placed(df, keys, layout), source, F.col("_part")) for source, df in inputs.items()]
        reduce(DataFrame.unionByName, every).write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(FINGERPRINTS).parquet(f"{self.root}/{name}")

    def refresh(self, inputs: dict[str, DataFrame], keys: tuple[str, ...], compute: Callable[..., DataFrame], changed_only: bool = False) -> DataFrame:
        """Brings the table up to date and returns it.

        inputs: name -> DataFrame with the key columns; compute gets the inputs, reduced to the changed partitions, by name and returns
        rows that hold the key columns. With changed_only, returns just the partitions recomputed in this run. Null keys form an
        ordinary key; empty inputs give an empty table, at the first refresh too.
        """
        last, intents = self._last(), self._names("intent-")
        number = last["number"] + 1 if last else 1
        tag = f"{number:012d}-{uuid.uuid4().hex}"
        layout = last["layout"] if last else f"layout-{tag}"
        laid = last["rows"] if last else self._lay_out(inputs, keys, layout)
        now = self._prints(inputs, keys, layout, f"prints-{tag}")
        total = now.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not self.buckets and total > GROWTH * max(laid, self.part_rows):
            tag, last = f"{number:012d}-{uuid.uuid4().hex}", None
            layout = f"layout-{tag}"
            laid = self._lay_out(inputs, keys, layout)
            now = self._prints(inputs, keys, layout, f"prints-{tag}")
        old = self.spark.read.schema(FINGERPRINTS).parquet(f"{self.root}/{last['prints']}") if last else self.spark.createDataFrame([], FINGERPRINTS)
        same = reduce(lambda p, q: p & q, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("n", "a", "b", "c", "d")))
        differs = now.alias("x").join(old.alias("y"), ["part", "source"], "full_outer").where(~same)
        # at most one number per partition
        changed = {r[0] for r in differs.select("part").distinct().collect()}
        for n in intents:
            left = self._get(n)
            changed |= set(left["parts"]) if left["layout"] == layout else set()
        parts = sorted(changed)
        name, schema = layout.replace("layout", "rows"), last["schema"] if last else None
        if parts:
            chosen = {k: self._placed(df, keys, layout).where(F.col("_part").isin(parts)).drop("_part") if last else df for k, df in inputs.items()}
            rows = compute(**chosen)
            schema = rows.schema.json()
            self._put(f"intent-{tag}", {"layout": layout, "parts": parts})
            rows = self._placed(rows, keys, layout).withColumn("_marker", F.lit(False))
            markers = self.spark.createDataFrame([(p,) for p in parts], "_part int").withColumn("_marker", F.lit(True))
            out = rows.unionByName(markers, allowMissingColumns=True).repartition(len(parts), "_part")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(f"{self.root}/{name}")
        elif schema is None:
            schema = compute(**{k: df.where("false") for k, df in inputs.items()}).schema.json()
        self._put(f"done-{tag}", {"layout": layout, "prints": f"prints-{tag}", "rows": laid, "schema": schema, "buckets": self.buckets})
        kept = {f"prints-{tag}", layout, name, f"done-{tag}"}
        for n in [x for kind in ("intent-", "prints-", "layout-", "rows-", "done-") for x in self._names(kind)]:
            if n not in kept:
                remove(self.spark, f"{self.root}/{n}")
        shape = StructType.fromJson(json.loads(schema))
        if not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], shape)
        extra = [StructField("_marker", BooleanType()), StructField("_part", IntegerType())]
        table = self.spark.read.schema(StructType([*shape.fields, *extra])).parquet(f"{self.root}/{name}")
        table = table.where(F.col("_part").isin(parts)) if changed_only else table
        return table.where(~F.col("_marker")).drop("_marker", "_part")


def checkpointed_hashes(file_hashes: DataFrame, index_runs: DataFrame) -> DataFrame:
    """The rows of file_hashes whose batch the run reported as processed; a run without a report, or with null, reached batch 0."""
    reached = index_runs.groupBy("run_id").agg(F.max("batches_processed").alias("_reached"))
    done = file_hashes.join(reached, "run_id", "left").where(F.col("batch_no") <= F.coalesce("_reached", F.lit(0)))
    return _keyed(done).select("project", "rel_path", "content_hash", "run_id", "batch_no")


def _keyed(df: DataFrame) -> DataFrame:
    """Null project or rel_path counts as the empty string."""
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("project", "rel_path")})


def pending_files(file_changes: DataFrame, checkpointed: DataFrame) -> DataFrame:
    """Files whose current state differs from the indexed one: project, rel_path, action (added, removed, updated), content_hash.

    The current state is the change with the greatest ts, then change_id; the indexed one the checkpointed row of the greatest run.
    Redelivered rows don't matter; a file without rows on one side is absent there. Rows of one run and file that disagree: the greatest
    batch, then the greatest hash counts.
    """
    now = file_changes.groupBy("project", "rel_path").agg(
        F.max(F.struct("ts", "change_id", F.when(F.col("kind") != "delete", F.col("content_hash")).alias("hash"))).alias("last")
    )
    then = checkpointed.groupBy("project", "rel_path").agg(F.max(F.struct("run_id", "batch_no", F.col("content_hash").alias("hash"))).alias("last"))
    sides = now.select("project", "rel_path", F.col("last.hash").alias("now"), F.lit(None).cast("string").alias("then")).unionByName(
        then.select("project", "rel_path", F.lit(None).cast("string").alias("now"), F.col("last.hash").alias("then"))
    )
    both = sides.groupBy("project", "rel_path").agg(F.max("now").alias("content_hash"), F.max("then").alias("_then"))
    action = F.when(F.col("_then").isNull(), "added").when(F.col("content_hash").isNull(), "removed").otherwise("updated")
    return both.where(~F.col("content_hash").eqNullSafe(F.col("_then"))).select("project", "rel_path", action.alias("action"), "content_hash")


def refresh_pending(table: IncrementalTable, file_changes: DataFrame, file_hashes: DataFrame, index_runs: DataFrame, changed_only: bool = False) -> DataFrame:
    """The files the next run has to process, kept up to date in table: only partitions with new or changed input rows are recomputed."""
    changes = _keyed(file_changes).select("project", "rel_path", "kind", "content_hash", "ts", "change_id")
    done = checkpointed_hashes(file_hashes, index_runs)
    compute = lambda changes, done: pending_files(changes, done)
    return table.refresh({"changes": changes, "done": done}, ("project", "rel_path"), compute, changed_only)
