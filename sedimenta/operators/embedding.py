"""Vectors of texts by a model that is passed in."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9_]+")


class Embedder(Protocol):
    """What a model must offer; it is sent to the executors, which call it with at most `batch` texts at once. Texts are cut before to what
    fits: `context` tokens of `chars_per_token` characters (None: any length)."""

    dimensions: int
    batch: int
    context: int | None
    chars_per_token: float

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashedEmbedder:
    """A deterministic stand-in for a model: signed hashed term frequencies of length 1; zero for a text without tokens."""

    def __init__(self, dimensions: int = 64, batch: int = 256, context: int | None = None, chars_per_token: float = 3.0):
        self.dimensions, self.batch, self.context, self.chars_per_token = dimensions, batch, context, chars_per_token
        self.known: dict[str, tuple[int, float]] = {}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for token in _TOKEN.findall(text.lower()):
                place = self.known.get(token)
                if place is None:
                    h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                    if len(self.known) > 200_000:
                        self.known.clear()
                    place = self.known[token] = h % self.dimensions, 1.0 if h >> 40 & 1 else -1.0
                v[place[0]] += place[1]
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


def fitting(text: str, embedder: Embedder) -> str:
    return text if embedder.context is None else text[: math.floor(embedder.context * embedder.chars_per_token)]


def called(embedder: Embedder, texts: list[str], tries: int = 3, wait: float = 0.5, long_wait: float = 15.0) -> list[list[float]]:
    """The vectors of a batch. A failed call is repeated, with a pause that doubles; where the model says that too much was asked, with a
    long one. The last failure is raised."""
    for n in range(tries):
        try:
            vectors = embedder(texts)
            if len(vectors) != len(texts) or any(len(v) != embedder.dimensions for v in vectors):
                raise ValueError("the model returned vectors of another number or length")
            return vectors
        except Exception as e:
            if n == tries - 1:
                raise
            busy = re.search(r"429|quota|rate.?limit", str(e), re.I)
            time.sleep(max(long_wait, wait * 2**n) if busy else wait * 2**n)
    return []


def embed(rows: DataFrame, id_col: str, text_col: str, embedder: Embedder, prefix: str = "", tries: int = 3, wait: float = 0.5) -> DataFrame:
    """id_col, embedding of every row; null texts count as empty. A batch that fails for good fails the query: all rows or none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [fitting(prefix + t, embedder) for t in b.column(1).to_pylist()]
            vectors = [v for i in range(0, len(texts), embedder.batch) for v in called(embedder, texts[i : i + embedder.batch], tries, wait)]
            yield pa.record_batch([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return rows.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(go, f"{id_col} {kind}, embedding array<float>")


def embed_query(text: str, embedder: Embedder, prefix: str = "") -> list[float]:
    return called(embedder, [fitting(prefix + text, embedder)])[0]
