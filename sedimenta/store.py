"""Named collections as generations of tables: a reader sees a generation as a whole, a writer publishes a new one by one small file."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sedimenta.operators.maintenance import upsert as _upsert
from sedimenta.plans.workspace import remove


class Store:
    """Collections below root. Each has generations, folders of parquet files, and a pointer to the current one with its schema; `keep`
    older ones stay for readers that began with them. Records are small JSON documents. One writer of a collection at a time."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("."))

    def _names(self, folder: str = ".") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def _put(self, name: str, content: dict) -> None:
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.delete(self._path(name), False)
        self._fs.rename(draft, self._path(name))

    def _get(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @staticmethod
    def _checked(name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", name):
            raise ValueError(f"no name of a collection: {name!r}")
        return name

    def _last(self, name: str) -> dict | None:
        published = [n for n in self._names(self._checked(name)) if n.startswith("current-") and not n.endswith(".draft")]
        return self._get(f"{name}/{published[-1]}") if published else None

    def exists(self, name: str) -> bool:
        return self._last(name) is not None

    def collections(self) -> list[str]:
        return [n for n in self._names() if not n.endswith((".json", ".draft")) and self.exists(n)]

    def create(self, name: str, schema: str | StructType) -> None:
        """An empty collection, unless there is one of the name."""
        if not self.exists(name):
            self.write(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{self._checked(name)}")

    def read(self, name: str) -> DataFrame:
        """The collection as it is now; the plan goes on reading this generation, whatever is published later."""
        last = self._last(name)
        if last is None:
            raise KeyError(name)
        return self.spark.read.schema(StructType.fromJson(json.loads(last["schema"]))).parquet(f"{self.root}/{name}/{last['generation']}")

    def write(self, name: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        """Publishes rows as the new generation; nothing of it is seen before all of it is there. by: a column to part the files by."""
        last = self._last(name)
        number = last["number"] + 1 if last else 1
        generation = f"gen-{number:010d}-{uuid.uuid4().hex}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}/{generation}")
        self._put(f"{name}/current-{number:010d}", {"number": number, "generation": generation, "schema": rows.schema.json()})
        held = [n for n in self._names(name) if n.startswith("gen-")]
        for old in [n for n in held if n != generation and int(n.split("-")[1]) < number - self.keep]:
            remove(self.spark, f"{self.root}/{name}/{old}")
        for old in [n for n in self._names(name) if n.startswith("current-") and int(n.split("-")[1].split(".")[0]) < number]:
            remove(self.spark, f"{self.root}/{name}/{old}")
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of other keys stay, those of the keys in rows are replaced."""
        return self.write(name, _upsert(self.read(name), rows, keys) if self.exists(name) else rows)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> DataFrame:
        return self.write(name, self.read(name).join(gone.select(*keys).distinct(), keys, "left_anti"))

    def save_record(self, name: str, content: dict) -> None:
        self._put(f"{self._checked(name)}.json", content)

    def record(self, name: str) -> dict | None:
        return self._get(f"{self._checked(name)}.json")

    def drop_record(self, name: str) -> None:
        self._fs.delete(self._path(f"{self._checked(name)}.json"), False)
