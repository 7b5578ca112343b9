"""Aggregates over responses, predictions and timings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import md5
from tracemill.session import ship


def step_metrics(df: DataFrame, y: Column, pred: Column) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and the rate of positives, in one pass."""
    n = lambda c: F.sum(c.cast("double"))
    hit, said, true = n((y == 1) & (pred == 1)), n(pred == 1), n(y == 1)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.agg(F.avg((y == pred).cast("double")).alias("accuracy"), zero(hit, said).alias("precision"), zero(hit, true).alias("recall"), zero(2 * hit, said + true).alias("f1"), F.avg((pred == 1).cast("double")).alias("positive_rate"))


def problem_rollup(df: DataFrame, clip: float) -> DataFrame:
    """Per problem: responses, mean score and length, share at the clip; and the mean of the problems' means."""
    per = df.groupBy(F.col("uid").cast("string").alias("problem")).agg(F.count("*").alias("responses"), F.avg("score").alias("acc"), F.avg("len").alias("length"), F.avg((F.col("len") >= clip).cast("double")).alias("clipped"))
    overall = per.agg(F.lit("__OVERALL__").alias("problem"), F.sum("responses").alias("responses"), F.avg("acc").alias("acc"), F.avg("length").alias("length"), F.avg("clipped").alias("clipped"))
    return overall.unionByName(per)


def majority(df: DataFrame, group: str, vote: str, order: str, value: str) -> DataFrame:
    """The most frequent vote of a group (ties: seen first), and the value of its first row."""
    votes = df.groupBy(group, vote).agg(F.count("*").alias("n"), F.min(F.struct(F.col(order), F.col(value))).alias("head"))
    best = F.max_by(F.struct(vote, "n", "head"), F.struct("n", -F.col(f"head.{order}")))
    return votes.groupBy(group).agg(best.alias("b")).select(group, F.col(f"b.{vote}").alias("vote"), F.col("b.n").alias("votes"), F.col(f"b.head.{value}").alias("value"))


def deduplicate_features(df: DataFrame, features: list[str], label: str, order: str, decimals: int) -> DataFrame:
    """One row per rounded feature vector: label by majority (ties: the first row's), and whether labels clash."""
    keys = [F.round(F.col(c), decimals).alias(c) for c in features]
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(label).alias("ones"), F.min_by(label, order).alias("first_label"), F.min(order).alias("first_row"))
    vote = F.when(2 * F.col("ones") > F.col("n"), 1).when(2 * F.col("ones") < F.col("n"), 0).otherwise(F.col("first_label"))
    return g.select(*features, "n", vote.cast("long").alias("label"), ((F.col("ones") > 0) & (F.col("ones") < F.col("n"))).alias("clash"), "first_row")


def buckets_1_2_5(most: int) -> list[int]:
    """1, 2, 5, 10, ... up to most."""
    out, power = [], 1
    while power <= most:
        out += [m * power for m in (1, 2, 5) if m * power <= most]
        power *= 10
    return out


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str] = ()) -> DataFrame:
    """Cumulative counts per bucket, with sum and count: one aggregation, no join to buckets."""
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*sums, F.sum(value).alias("total"), F.count(value).alias("count"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return wide.select(*by, "total", "count", F.explode(rows).alias("h")).select(*by, "total", "count", "h.le", "h.n")


def uniform(*parts) -> Column:
    """A number in (0, 1) that the parts, columns or constants, determine: the first 32 bits of their MD5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def poisson_edges() -> list[tuple[int, float]]:
    """(k, the probability that a Poisson(1) variable is less than k)."""
    out, mass, edge = [], math.exp(-1.0), 0.0
    for k in range(1, 13):
        edge += mass
        out.append((k, edge))
        mass /= k
    return out


def bootstrap(df: DataFrame, value: str, row: str, rounds: int, seed: int = 42) -> DataFrame:
    """Mean and standard deviation of the means of `rounds` resamples with replacement.

    Each row's multiplicity in a round is Poisson(1), drawn from a hash of seed, round and row (0 for a row without key):
    the resample needs no join and no order, and a rerun gives the same. Rows are few bytes and much work, so they are
    dealt to all cores; a task hashes blocks of rows in numpy and gives one row a round.
    """
    spark = df.sparkSession
    ship(spark)
    cuts = poisson_cuts()

    def sums(batches):
        total, number, some = np.zeros(rounds), np.zeros(rounds, np.int64), False
        for table in md5.blocks(batches):
            keys, x = table.column(0), table.column(1)
            some |= x.null_count < len(x)
            values = x.fill_null(0.0).to_numpy()
            for rows, draws in md5.starts(keys, [f"{seed}:{r}:".encode() for r in range(1, rounds + 1)]):
                held = values[rows]
                for r, start in draws:
                    times = poisson(start, cuts)
                    total[r] += (held * times).sum()
                    number[r] += times.sum(dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"round": np.arange(rounds), "total": pa.array(total if some else [None] * rounds, pa.float64()), "number": number})

    dealt = df.select(F.col(row).cast("string").alias("key"), F.col(value).cast("double").alias("x")).repartition(spark.sparkContext.defaultParallelism)
    parts = dealt.mapInArrow(sums, "round long, total double, number long").groupBy("round").agg(F.sum("total").alias("total"), F.sum("number").alias("number"))
    mean = F.when(F.col("total").isNotNull(), F.coalesce(F.try_divide("total", "number"), F.lit(math.nan)))
    return parts.select(mean.alias("m")).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def poisson_cuts() -> list[int]:
    """For each edge the smallest 32-bit number h with (h + 0.5) / 2**32 at or above it."""
    cuts = []
    for _, edge in poisson_edges():
        h = max(0, int(edge * 2**32) - 2)
        while (h + 0.5) / 4294967296.0 < edge:
            h += 1
        cuts.append(h)
    return cuts


def poisson(start: np.ndarray, cuts: list[int]) -> np.ndarray:
    """How many cuts each number reaches; few numbers reach the fourth."""
    times = (start >= cuts[0]).view(np.uint8) + (start >= cuts[1]).view(np.uint8)
    times += (start >= cuts[2]).view(np.uint8)
    far = np.flatnonzero(start >= cuts[3])
    times[far] += np.searchsorted(np.array(cuts[3:], np.int64), start[far].astype(np.int64), "right").astype(np.uint8)
    return times


def _rates(requests, queries, hits, most: int) -> list[float]:
    out, first, sums = [], 0, [0, 0, 0]
    for i, now in enumerate(zip(requests, queries, hits)):
        sums = [a + b for a, b in zip(sums, now)]
        if sums[0] > most:
            sums = [a - b for a, b in zip(sums, (requests[first], queries[first], hits[first]))]
            first += 1
        out.append(sums[2] / sums[1] if sums[1] else 0.0)
    return out


def recent_hit_rate(df: DataFrame, within: str, order: list[str], requests: str, queries: str, hits: str, most: int) -> DataFrame:
    """Hits over queries of a stream's recent batches: whenever these hold more than `most` requests, the oldest one goes,
    one at a time. What has gone depends on all before, so each stream is folded in order."""
    ship(df.sparkSession)
    rows = df.groupBy(within).agg(F.array_sort(F.collect_list(F.struct(*order, requests, queries, hits))).alias("t"))

    @F.pandas_udf("array<double>")
    def rates(r: pd.Series, q: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_rates(*(x.tolist() for x in s), most) for s in zip(r, q, h)])

    rows = rows.withColumn("hit_rate", rates(F.col(f"t.{requests}"), F.col(f"t.{queries}"), F.col(f"t.{hits}")))
    return rows.select(within, F.explode(F.arrays_zip("t", "hit_rate")).alias("z")).select(within, *[F.col(f"z.t.{c}").alias(c) for c in order], F.col("z.hit_rate").alias("hit_rate"))
