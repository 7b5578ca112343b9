"""Callables over Arrow batches: classifiers and rewards given as Python functions, whose errors count as 0."""

from __future__ import annotations

import functools
import signal
import threading

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.sampling import micro_batches


#: Rows that may go to every worker.
EVERY = 100_000


def apply_rule(df: DataFrame, rule, columns: list[str], name: str) -> DataFrame:
    """df with a column of rule(*columns), a function of numpy or pandas columns that returns one."""

    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(rule(*parts), dtype=float))

    return df.withColumn(name, run(*[F.col(c) for c in columns]))


def apply_guarded(df: DataFrame, rule, column: str, name: str, limit: float | None = 300.0) -> DataFrame:
    """df with rule(value) of each row; rows on which it fails, or takes more than `limit` seconds, get 0."""

    def safe(x) -> float:
        try:
            return float(rule(x))
        except (Exception, TimeoutError):  # noqa: BLE001 - a failing rule is worth nothing, whatever it raised
            return 0.0

    def within(values) -> list[float]:
        if limit is None or threading.current_thread() is not threading.main_thread():
            return [safe(x) for x in values]

        def late(signum, frame):
            raise TimeoutError

        signal.signal(signal.SIGALRM, late)
        out = []
        for x in values:
            signal.setitimer(signal.ITIMER_REAL, limit)
            try:
                out.append(safe(x))
            except TimeoutError:  # came between the rule and the timer's end
                out.append(0.0)
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
        return out

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        # A rule is any function of one value: each distinct value of the batch is scored once.
        codes, distinct = pd.factorize(values, use_na_sentinel=False)
        return pd.Series(np.asarray(within(distinct.tolist()), dtype=float)[codes])

    return df.withColumn(name, run(F.col(column)))


def load_rule(spark: SparkSession, path: str, name: str, **settings):
    """The function `name` of a Python file at any path that Spark reads, with settings filled in."""
    from tracemill.sources.custom import load_names

    return functools.partial(load_names(spark, path)[name], **settings)


def process_logits(df: DataFrame, column: str, processors: list) -> DataFrame:
    """The column's arrays of logits after each processor, a function of one array, in turn."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        def through(x):
            for process in processors:
                x = process(x)
            return x

        return pd.Series([through(np.asarray(r, dtype=float)) for r in rows])

    return df.withColumn(column, run(F.col(column)))


def dispatch(df: DataFrame, rule, schema: str, mode: str, by: list[str] = (), workers: int = 1) -> DataFrame:
    """rule on pandas frames: on "parts" of the rows as they come, on "groups" by columns, or on "every" worker, each of
    which gets all rows (of a table of at most EVERY) and its number. Results are rows of the schema."""
    if mode == "parts":
        return df.mapInPandas(lambda parts: (rule(p) for p in parts), schema)
    if mode == "groups":
        return df.groupBy(*by).applyInPandas(rule, schema)
    if mode == "every":
        rows = df.limit(EVERY + 1).toPandas()
        if len(rows) > EVERY:
            raise ValueError(f"every worker can get {EVERY} rows at most")
        ranks = df.sparkSession.range(workers).repartition(workers, "id")
        return ranks.mapInPandas(lambda parts: (rule(rows, int(r)) for p in parts for r in p["id"]), schema)
    raise ValueError(f"unknown mode {mode}")


def indel_ratio(a: str, b: str) -> int:
    """Share in percent of the characters of both texts that their longest common subsequence covers."""
    if not a and not b:
        return 100
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return round(100 * 2 * common / (len(a) + len(b)))


def fuzzy_option(text: Column, options: dict[str, str]) -> Column:
    """The letter whose option is nearest to the text: as "A: option", "A" or "option", whichever is; the first of equals."""
    forms = [(letter, (f"{letter}: {option}", letter, option)) for letter, option in options.items()]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def nearest(x: str) -> str:
            return max(forms, key=lambda f: max(indel_ratio(x, form) for form in f[1]))[0]

        codes, distinct = pd.factorize(values, use_na_sentinel=False)
        return pd.Series(np.array([nearest(x or "") for x in distinct], dtype=object)[codes])

    return run(text)


def micro_batch_rows(budget: int):
    """(uid, rids, lens) -> batch of each response, as few balanced ones as the token budget allows."""

    def run(batches):
        for pdf in batches:
            out = []
            for uid, rids, lens in zip(pdf["uid"], pdf["rids"], pdf["lens"]):
                of = {i: p for p, members in enumerate(micro_batches([int(x) for x in lens], budget)) for i in members}
                out += [(uid, rid, of[i]) for i, rid in enumerate(rids)]
            yield pd.DataFrame(out, columns=["uid", "rid", "batch"])

    return run


def quantile_places(n: Column, m: int) -> Column:
    """0-based places of m sentences of n, spread evenly and strictly increasing."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        place = F.greatest(F.ceil(i * n / F.lit(float(m + 1))) - 1, acc["last"] + 1)
        return F.struct(place.alias("last"), F.concat(acc["out"], F.array(place)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(m)), start, step, lambda acc: acc["out"])
