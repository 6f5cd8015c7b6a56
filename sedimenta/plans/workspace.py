"""Lineage cuts that survive the loss of executors: tables written into the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, "Workspace"] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else a folder set before. Only where all runs on one machine (master
    ``local``) and neither is set, a temporary folder of that machine; elsewhere executors could not read it, so an error is raised."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sedimenta-"))
    return sc.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def close_workspaces() -> None:
    """Removes the tables of all queries so far. Results that weren't read or stored before can't be read any more."""
    for ws in list(_OPEN.values()):
        ws.close()


class Workspace:
    """Names tables of one run below the shared folder and drops those that no later plan reads.

    What a returned DataFrame still reads stays until close() or close_workspaces(), which a session calls once it has stored its results.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _OPEN[self.root] = self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as a table of the run and returns the table; its schema is fixed, so an empty table can be read too."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.read(df.schema, name)

    def read(self, schema, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(self.path(n) for n in names))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        remove(self.spark, self.root)
        self.names.clear()
        _OPEN.pop(self.root, None)
