"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROWS_PER_BUCKET = 20_000
# Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def counter(tokenizer: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """How many tokens each of some texts has. tokenizer: a file of ranks (.tiktoken) or of the tokenizers library (.json); strings of special
    tokens count as ordinary text. Read once per process."""
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        encode = tiktoken.Encoding(os.path.basename(tokenizer), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda texts: [len(e) for i in range(0, len(texts), 64) for e in t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]


def token_counts(texts: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """texts with a column n_tokens in the place of the text; null text counts as empty."""
    keep = [f for f in texts.schema.fields if f.name not in (text_col, "n_tokens")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            sizes = count([t or "" for t in b.column(len(keep)).to_pylist()])
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*(f.name for f in keep), "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + (", " if keep else "") + "n_tokens bigint"
    return texts.select(*(f"`{f.name}`" for f in keep), text_col).mapInArrow(go, schema)


def running_totals(rows: DataFrame, group: str, value: Column, order: Column, tie: Column, buckets: int) -> DataFrame:
    """rows with `before`: the sum of value over the rows of the same group that come earlier by a uniform hash `order`, then tie.

    A distributed prefix sum: each group is range-partitioned by its hash into buckets; sums of buckets are added up over a table of
    buckets, and rows are ordered within their bucket only, so no group has to fit into a task.
    """
    bucket = F.floor((order.cast("double") / F.lit(2.0**64) + 0.5) * buckets).cast("int")
    keyed = rows.withColumns({"_value": value, "_order": order, "_tie": tie, "_bucket": F.least(bucket, F.lit(buckets - 1))})
    sums = keyed.groupBy(group, "_bucket").agg(F.sum("_value").alias("_sum"))
    up = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return local.join(offsets, [group, "_bucket"]).withColumn("before", F.col("_local") + F.col("_offset")).drop("_value", "_order", "_tie", "_bucket", "_local", "_offset")


def buckets_for(rows: int) -> int:
    return 1 + rows // ROWS_PER_BUCKET
