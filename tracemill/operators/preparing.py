"""Preparing training data: column batches, mini-batches of epochs, completion-only losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.relational import numbered


def collated(df: DataFrame, order: str, size: int) -> DataFrame:
    """(batch, an array of each column): `size` rows a batch, in order, so no array grows with the table."""
    columns = df.columns
    rows = numbered(df, order, name="__row").withColumn("batch", F.floor(F.col("__row") / F.lit(size)))
    packed = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("__row", *columns))).alias("__r"))
    return packed.select("batch", *[F.col(f"__r.{c}").alias(c) for c in columns])


def mini_batches(df: DataFrame, key: str, size: int, epochs: int, seed: int) -> DataFrame:
    """epoch and batch of each row: in every epoch the rows stand in another order, by a hash of seed, epoch and key."""
    out = None
    for epoch in range(epochs):
        shuffled = df.withColumn("__at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key))))
        rows = numbered(shuffled, "__at", key, name="__row")
        part = rows.select(F.lit(epoch).cast("long").alias("epoch"), F.floor(F.col("__row") / F.lit(size)).alias("batch"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


def completion_only(df: DataFrame, messages: str) -> DataFrame:
    """words of a conversation, and loss: 1 on those of its last message if an assistant gave it, else 0."""
    of = lambda m: F.filter(F.split(F.coalesce(m["content"], F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(messages)
    masks = F.transform(messages, lambda m, i: F.array_repeat(F.when((i == n - 1) & (m["role"] == "assistant"), 1).otherwise(0), F.size(of(m))))
    return df.withColumn("words", F.flatten(F.transform(messages, of))).withColumn("loss", F.flatten(masks))
