"""Advantages, KL terms and losses over token-level records (seq, pos, ...) and response scores (uid, rid, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import ship

#: Fixed values.
EPSILON, WHITEN = 1e-6, 1e-8


def whiten(df: DataFrame, column: str, mask: str = "mask", shift: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + WHITEN) over all valid tokens (sample variance); invalid tokens become 0."""
    stats = df.filter(mask).agg(F.avg(column).alias("__mean"), F.var_samp(column).alias("__var"))  # one row
    x = (F.col(column) - F.col("__mean")) / F.sqrt(F.coalesce(F.col("__var"), F.lit(0.0)) + WHITEN)
    x = x if shift else x + F.col("__mean")
    return df.join(F.broadcast(stats)).withColumn(column, F.when(F.col(mask), x).otherwise(0.0)).drop("__mean", "__var")


def _backward(x: pd.Series, factor: pd.Series) -> pd.Series:
    """value[t] = x[t] + factor[t] * value[t + 1] of each array: one step for all arrays of the batch at a time."""
    lens = np.array([len(v) for v in x], np.int64)
    start = np.cumsum(lens) - lens
    flat, by = (np.concatenate([np.zeros(0), *s]).astype(float) for s in (x, factor))
    order = np.argsort(-lens, kind="stable")
    later = np.zeros(len(lens))
    alive = np.searchsorted(-lens[order], -np.arange(1, (lens.max() if len(lens) else 0) + 1), "right")
    for k, n in enumerate(alive):
        at = start[order[:n]] + lens[order[:n]] - 1 - k
        later[:n] = flat[at] = flat[at] + by[at] * later[:n]
    return pd.Series([flat[a : a + n] for a, n in zip(start, lens)])


def backward(df: DataFrame, x: Column, factor: Column, keep: list[str], name: str) -> DataFrame:
    """A recursion from the last token to the first, x + factor * later: one aggregate per sequence, no join."""
    ship(df.sparkSession)
    rows = df.withColumn("__x", x.cast("double")).withColumn("__f", factor.cast("double")).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", *keep, "__x", "__f"))).alias("t"))
    values = F.pandas_udf(_backward, "array<double>")(F.col("t.__x"), F.col("t.__f"))
    return rows.withColumn("v", values).select("seq", F.explode(F.arrays_zip("t", "v")).alias("z")).select("seq", *[F.col(f"z.t.{c}").alias(c) for c in ["pos", *keep]], F.col("z.v").alias(name))


def gae(df: DataFrame, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage estimation: returns = advantage + value, and adv, the advantage whitened over valid tokens."""
    nxt = F.coalesce(F.lead("value").over(Window.partitionBy("seq").orderBy("pos")), F.lit(0.0))
    df = df.withColumn("delta", F.col("reward") + gamma * nxt - F.col("value"))
    out = backward(df, F.col("delta"), F.lit(gamma * lam), ["delta", "value", "mask"], "adv")
    return whiten(out.withColumn("returns", F.col("adv") + F.col("value")), "adv")


def grpo(df: DataFrame) -> DataFrame:
    """(score - mean) / (std + EPSILON) within a prompt; a single response: mean 0, std 1."""
    w = Window.partitionBy("uid")
    single = F.count("*").over(w) == 1
    mean = F.when(single, 0.0).otherwise(F.avg("score").over(w))
    std = F.when(single, 1.0).otherwise(F.stddev_samp("score").over(w))
    return df.withColumn("adv", (F.col("score") - mean) / (std + EPSILON))


def baseline(df: DataFrame) -> DataFrame:
    """score - mean of the prompt; of a single response: score."""
    w = Window.partitionBy("uid")
    return df.withColumn("adv", F.col("score") - F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg("score").over(w)))


def rloo(df: DataFrame) -> DataFrame:
    """Leave-one-out baseline; a single response keeps its score."""
    w = Window.partitionBy("uid")
    n = F.count("*").over(w)
    loo = F.col("score") * n / (n - 1) - F.avg("score").over(w) * n / (n - 1)
    return df.withColumn("adv", F.when(n > 1, loo).otherwise(F.col("score")))


def baseline_tokens(df: DataFrame, scores: DataFrame) -> DataFrame:
    """The baseline advantage of each response's score on all its valid tokens, whitened over them; tokens: (uid, rid, mask)."""
    placed = df.join(baseline(scores).select("uid", "rid", "adv"), ["uid", "rid"])
    return whiten(placed.withColumn("adv", F.when(F.col("mask"), F.col("adv")).otherwise(0.0)), "adv")


def discounted(df: DataFrame, gamma: float) -> DataFrame:
    """returns: the discounted return, begun anew after masked tokens; adv: whitened over valid tokens."""
    valid = F.when(F.col("mask"), 1.0).otherwise(0.0)
    out = backward(df, F.col("reward") * valid, gamma * valid, ["reward", "mask"], "returns")
    return whiten(out.withColumn("adv", F.col("returns")), "adv")


def remax(df: DataFrame, base: Column) -> DataFrame:
    """Rewards to come minus a baseline on valid tokens."""
    w = Window.partitionBy("seq").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("adv", F.sum("reward").over(w) - F.when(F.col("mask"), base).otherwise(0.0))


def kl(kind: str, logp: Column, ref: Column) -> Column:
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return F.least(F.greatest(F.exp(-d) + d - 1, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(f"unknown KL estimate {kind}")


def adaptive_coefficient(value: float, current: float, target: float, steps: int, horizon: float) -> float:
    """The controller's next coefficient; the error is clipped to a fifth."""
    return value * (1 + max(-0.2, min(current / target - 1, 0.2)) * steps / horizon)


def steered(now: Column, start: float, target: float, steps: int, horizon: float) -> Column:
    """adaptive_coefficient folded over an array of estimates."""
    step = lambda c, x: c * (1 + F.greatest(F.lit(-0.2), F.least(x / target - 1, F.lit(0.2))) * steps / horizon)
    return F.aggregate(now, F.lit(start), step)


def aggregate_loss(df: DataFrame, loss: str, mode: str) -> DataFrame:
    """One value over valid tokens: token-mean, seq-mean-token-sum or seq-mean-token-mean."""
    valid = df.filter("mask")
    if mode == "token-mean":
        return valid.agg(F.avg(loss).alias("loss"))
    each = {"seq-mean-token-sum": F.sum, "seq-mean-token-mean": F.avg}[mode]
    return valid.groupBy("seq").agg(each(loss).alias("x")).agg(F.avg("x").alias("loss"))


def ppo_terms(df: DataFrame, adv: str, clip: float, dual: float) -> DataFrame:
    """pg: the dual-clipped token loss; clipped, clipped_low: whether a bound was at work."""
    ratio = F.exp(F.col("logp") - F.col("ref"))
    a = F.col(adv)
    plain, bound = -a * ratio, -a * F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    top, low = F.greatest(plain, bound), -a * dual
    return df.withColumns({"pg": F.when(a < 0, F.least(low, top)).otherwise(top), "clipped": (bound > plain).cast("double"), "clipped_low": ((top > low) & (a < 0)).cast("double")})


def value_loss(df: DataFrame, pred: Column, clip: float) -> DataFrame:
    bound = F.least(F.greatest(pred, F.col("value") - clip), F.col("value") + clip)
    return df.withColumn("vf", 0.5 * F.greatest((pred - F.col("returns")) ** 2, (bound - F.col("returns")) ** 2))


def entropy_loss(df: DataFrame) -> DataFrame:
    """Mean over valid rows of the entropy of their token distributions; (row, token, logit, mask)."""
    from tracemill.operators.sampling import softmax

    each = softmax(df.filter("mask")).groupBy("row").agg((-F.sum(F.col("p") * F.col("logp"))).alias("h"))
    return each.agg(F.avg("h").alias("loss"))
