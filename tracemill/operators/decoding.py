"""Decoding: masks of logits, verification of drafts, beams, pooling, and arrivals, in long form (row, token, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.aggregates import uniform
from tracemill.operators.relational import numbered

MINUS = float("-inf")


def masked_logits(df: DataFrame, allowed: Column, bias: Column, vocabulary: int, bad: DataFrame, minimum: int, stops: list[int]) -> DataFrame:
    """Logits (row, token, logit, output: tokens so far) with a bias added; -inf for tokens that are not allowed, stop
    tokens before `minimum` tokens, and the last token of a bad word (row, word) that the output is about to end.

    A bias outside the vocabulary is an error. Bad words are few a row and joined by (row, last token).
    """
    known = F.col("token").between(0, vocabulary - 1)
    x = F.when(known, F.col("logit") + F.coalesce(bias, F.lit(0.0))).otherwise(F.raise_error(F.lit("a token is not in the vocabulary")).cast("double"))
    words = bad.select("row", F.element_at("word", -1).alias("token"), F.slice("word", F.lit(1), F.size("word") - 1).alias("lead"))
    hit = df.select("row", "token", "output").join(words, ["row", "token"])
    n, m = F.size("output"), F.size("lead")
    ends = (m <= n) & (F.when(m == 0, F.array().cast("array<bigint>")).otherwise(F.slice("output", F.greatest(n - m + 1, F.lit(1)), F.greatest(m, F.lit(1)))) == F.col("lead"))
    banned = hit.filter(ends).select("row", "token", F.lit(True).alias("__bad")).distinct()
    early = F.col("token").isin(*stops) & (F.size("output") < minimum)
    out = df.withColumn("logit", x).join(banned, ["row", "token"], "left")
    return out.withColumn("logit", F.when(~allowed | early | F.col("__bad").isNotNull(), MINUS).otherwise(F.col("logit"))).drop("__bad")


def accepted_greedy(df: DataFrame) -> DataFrame:
    """(seq, pos, token): the target's tokens up to and with the first that differs from the draft, else all and the
    bonus; from (seq, pos, draft, target, bonus), bonus being the same on all rows of a sequence."""
    first = F.min(F.when(F.col("draft") != F.col("target"), F.col("pos"))).over(Window.partitionBy("seq"))
    kept = df.withColumn("__first", first).filter(F.col("__first").isNull() | (F.col("pos") <= F.col("__first")))
    bonus = df.withColumn("__first", first).filter("__first is null").groupBy("seq").agg((F.max("pos") + 1).alias("pos"), F.first("bonus").alias("token"))
    return kept.select("seq", "pos", F.col("target").alias("token")).unionByName(bonus)


def accepted_random(df: DataFrame, drafts: DataFrame, seed: int) -> DataFrame:
    """(seq, pos, token, kind): rejection sampling of drafts.

    df: (seq, pos, token, p: target's probability, q: draft's); drafts: (seq, pos, token), the last position of a
    sequence without a draft for the bonus. A draft is accepted when p / q reaches a uniform number; the first that is
    not is replaced by a token drawn from max(p - q, 0); after the last one a bonus is drawn from p. Draws are
    exponential races with hashed noise, so reruns agree.
    """
    at = df.join(drafts.select("seq", "pos", F.col("token").alias("draft")), ["seq", "pos"], "left")
    race = -F.log(uniform(seed, "race", F.col("seq"), F.col("pos"), F.col("token")))
    rest = F.greatest(F.col("p") - F.col("q"), F.lit(0.0))
    own = F.col("token") == F.col("draft")
    best = lambda weight: F.max_by("token", F.struct(weight / race, -F.col("token")))
    per = at.groupBy("seq", "pos").agg(
        F.max("draft").alias("draft"), F.max(F.when(own, F.col("p"))).alias("p"), F.max(F.when(own, F.col("q"))).alias("q"), best(rest).alias("recovered"), best(F.col("p")).alias("bonus")
    )
    good = (F.col("q") > 0) & (F.col("p") / F.col("q") >= uniform(seed, "accept", F.col("seq"), F.col("pos")))
    per = per.withColumn("ok", F.coalesce(good, F.lit(False)))
    first = F.min(F.when(~F.col("ok"), F.col("pos"))).over(Window.partitionBy("seq"))
    kept = per.withColumn("__first", first).filter("pos <= __first or __first is null")
    kind = F.when(F.col("ok"), "accepted").when(F.col("draft").isNull(), "bonus").otherwise("recovered")
    token = F.when(F.col("ok"), F.col("draft")).when(F.col("draft").isNull(), F.col("bonus")).otherwise(F.col("recovered"))
    return kept.select("seq", "pos", token.alias("token"), kind.alias("kind"))


def beam_search(start: DataFrame, logps, steps: int, width: int, eos: int, penalty: float = 1.0) -> DataFrame:
    """(seq, rank, tokens, score): the best beams of each sequence.

    start: (seq, tokens, cum); logps(beams) gives (seq, tokens, cum, token, logp) of the 2 * width likeliest next tokens
    of each beam. Beams that end with eos are complete; of the others the best `width` by score go on. score: cum by
    the number of tokens to the power of the penalty, eos not counted. One window a step; only beams are kept.
    """
    done, beams = None, start
    value = lambda n: F.col("cum") / F.pow(n.cast("double"), F.lit(penalty))
    for _ in range(steps):
        grown = logps(beams).select("seq", F.concat("tokens", F.array("token")).alias("tokens"), (F.col("cum") + F.col("logp")).alias("cum"), "token")
        ended = grown.filter(F.col("token") == eos).withColumn("score", value(F.size("tokens") - 1)).drop("token")
        going = grown.filter(F.col("token") != eos).withColumn("score", value(F.size("tokens"))).drop("token")
        best = Window.partitionBy("seq").orderBy(F.desc("score"), "tokens")
        beams = going.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= width).drop("__n")
        done = ended if done is None else done.unionByName(ended)
        last, beams = beams, beams.drop("score")
    best = Window.partitionBy("seq").orderBy(F.desc("score"), "tokens")
    return done.unionByName(last).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= width).select("seq", "rank", "tokens", "score")


def pooled(df: DataFrame, mode: str, step_token: int | None = None) -> DataFrame:
    """States of tokens (seq, pos, token, state) pooled: CLS the first, LAST the last, MEAN their mean (seq, state);
    ALL every one, STEP those of a tag's tokens (seq, pos, state)."""
    if mode == "ALL":
        return df.select("seq", "pos", "state")
    if mode == "STEP":
        return df.filter(F.col("token") == step_token).select("seq", "pos", "state")
    if mode in ("CLS", "LAST"):
        pick = F.min_by if mode == "CLS" else F.max_by
        return df.groupBy("seq").agg(pick("state", "pos").alias("state"))
    if mode == "MEAN":
        dims = df.select("seq", F.posexplode("state").alias("dim", "x")).groupBy("seq", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
        return dims.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("state"))
    raise ValueError(f"unknown pooling {mode}")


def tag_share(hard: Column, easy: Column, low: Column) -> Column:
    """The share of one log-probability in the sum of two, the lowest one known standing in for a missing one; 0.5
    where nothing is known or the sum is 0; within [0, 1]."""
    h, e = F.coalesce(hard, low), F.coalesce(easy, low)
    return F.when(low.isNull() | (h + e == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h / (h + e))))


def oversampled(df: DataFrame, wanted: int, *order: str, seed: int = 0) -> DataFrame:
    """df, and if it has fewer rows than wanted, as many drawn with replacement as are missing; `draw` is null on the
    rows themselves. Drawn positions are hashes, and meet their rows by position."""
    rows = numbered(df, *order, name="__row")
    n = df.count()
    own = df.withColumn("draw", F.lit(None).cast("long"))
    if n == 0 or n >= wanted:
        return own
    draws = df.sparkSession.range(wanted - n).select(F.col("id").alias("draw"), F.least(F.floor(uniform(seed, F.col("id")) * n), F.lit(n - 1)).alias("__row"))
    return own.unionByName(rows.join(draws, "__row").drop("__row"))


def gamma_gaps(df: DataFrame, key: str, rate: float, burstiness: float, seed: int = 0, tries: int = 64) -> DataFrame:
    """gap: seconds to the next arrival, Gamma distributed with shape `burstiness` and mean 1 / rate; an infinite rate
    has none. The whole part of the shape is a sum of exponentials, the rest Johnk's rejection, of which one of many
    tries is accepted but for odds of 1e-40."""
    if rate == float("inf"):
        return df.withColumn("gap", F.lit(0.0))
    if burstiness <= 0:
        raise ValueError("burstiness must be positive")
    u = lambda *parts: uniform(seed, *parts, F.col(key))
    whole, rest = int(burstiness), burstiness - int(burstiness)
    total = sum((-F.log(u("e", i)) for i in range(whole)), F.lit(0.0))
    if rest > 1e-12:
        pairs = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: F.struct(F.pow(u("x", i), F.lit(1 / rest)).alias("x"), F.pow(u("y", i), F.lit(1 / (1 - rest))).alias("y")))
        good = F.try_element_at(F.filter(pairs, lambda p: p["x"] + p["y"] <= 1), F.lit(1))
        total = total - F.log(u("w")) * good["x"] / (good["x"] + good["y"])
    return df.withColumn("gap", total / (rate * burstiness))
