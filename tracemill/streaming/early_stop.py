"""Streaming early stop: per-question state over probes that arrive in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, first double, lags string, key string, run long, flips long, emitted long, since long, stopped boolean"
FEATURES = "qid long, step long, n long, velocity double, acceleration double, delta double, run_len long, flips long, stopped boolean"


def online_features(threshold: float, interval: int):
    """State function: features of each probe from the last few values only; stops once a value reaches threshold.

    A probe is looked at when `interval` steps have passed since the last that was; after a stop a question is
    silent.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, lags, last, run_len, flips, _, since, stopped = state.get if state.exists else (0, 0.0, "", "", 0, 0, 0, -(1 << 40), False)
        seen = [float(x) for x in lags.split("|")] if lags else []
        out = []
        rows = pd.concat(list(batches)).sort_values(["step", "event_id"])
        for r in rows.itertuples():
            if stopped or r.step - since < interval:
                continue
            since = int(r.step)
            x = float(r.value)
            n += 1
            first = x if n == 1 else first
            back = lambda k: seen[-k] if len(seen) >= k else None
            velocity = x - back(1) if n > 1 else 0.0
            acceleration = x - 2 * back(1) + back(2) if n > 2 else 0.0
            delta = x - (back(2) if n > 2 else first)
            flips += int(n > 1 and r.answer != last)
            run_len = run_len + 1 if n > 1 and r.answer == last else 1
            last, seen = r.answer, [*seen, x][-4:]
            stopped = x >= threshold
            out.append((key[0], int(r.step), n, velocity, acceleration, delta, run_len, flips, stopped))
        state.update((n, first, "|".join(map(repr, seen)), last, run_len, flips, n, since, stopped))
        yield pd.DataFrame(out, columns=["qid", "step", "n", "velocity", "acceleration", "delta", "run_len", "flips", "stopped"])

    return run


def stream_features(probes: DataFrame, threshold: float = float("inf"), interval: int = 0) -> DataFrame:
    """Streaming features of probes (qid, step, event_id, answer, value); append mode."""
    return probes.groupBy("qid").applyInPandasWithState(online_features(threshold, interval), FEATURES, STATE, "append", GroupStateTimeout.NoTimeout)


SESSION = "text string, since long, begun boolean, done boolean"
EVENTS = "qid long, step long, kind string, cause string"
#: What ends thinking in a text.
OPEN, CLOSE = "<final_answer>", "</final_answer>"


def session_states(threshold: float, interval: int):
    """State function of a question's texts and probes: what ends it, in this order: a complete final answer, a closing
    tag (a hard stop), the end of the text, a probe of at least the threshold. The first thing said of a question is its
    baseline, before any text (step -1). After an end it is silent. Of the text only what may still become a tag, or
    stands after an opening one, is kept.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, since, begun, done = state.get if state.exists else ("", -(1 << 40), False, False)
        out = [] if begun else [(key[0], -1, "baseline", None)]
        rows = pd.concat(list(batches)).sort_values(["step", "event_id"])
        columns = [rows[c].tolist() for c in ("step", "delta", "finished", "value")]
        for step, delta, finished, value in zip(*columns):
            if done:
                break
            text += delta or ""
            opened = text.lower().find(OPEN)
            closed = text.lower().find(CLOSE, opened + len(OPEN) if opened >= 0 else 0)
            if opened >= 0 and closed >= 0:
                kind = cause = "think_final"
            elif closed >= 0:
                kind = cause = "hard_stop"
            elif finished:
                kind = cause = "finished"
            elif step - since >= interval:
                since, kind, cause = int(step), "interval", "early_stop" if value >= threshold else None
            else:
                kind = cause = None
            if kind:
                out.append((key[0], int(step), kind, cause))
            done = cause is not None
            text = text[opened:] if opened >= 0 else text[-len(CLOSE) :]
        state.update(("" if done else text, since, True, done))
        yield pd.DataFrame(out, columns=["qid", "step", "kind", "cause"])

    return run


def sessions(events: DataFrame, threshold: float, interval: int) -> DataFrame:
    """(qid, step, kind, cause) of a stream of (qid, step, event_id, delta, finished, value); append mode."""
    return events.groupBy("qid").applyInPandasWithState(session_states(threshold, interval), EVENTS, SESSION, "append", GroupStateTimeout.NoTimeout)


def paced(spark: SparkSession, schema, path: str, files: int) -> DataFrame:
    """A stream of a folder's files, so many a batch: what is in work at a time is bounded, the rest waits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def output_rows(df: DataFrame, by: str, order: list[str], text: str, kind: str) -> DataFrame:
    """Cumulative texts as they are, what each adds, or only the last of each key."""
    if kind == "cumulative":
        return df
    if kind == "delta":
        return deltas(df, by, order, text).withColumn(text, F.col("delta")).drop("delta")
    if kind == "final":
        last = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
        return df.withColumn("__n", last).filter("__n = 1").drop("__n")
    raise ValueError(f"unknown kind of output {kind}")


def deltas(df: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """Cumulative texts -> what each adds."""
    before = F.coalesce(F.length(F.lag(text).over(Window.partitionBy(by).orderBy(*order))), F.lit(0))
    return df.withColumn("delta", F.substring(F.col(text), before + 1, F.length(text)))


def throughput(events: DataFrame, ts: str, count: str, every: str) -> DataFrame:
    """Tokens per second of each interval, for batch or stream (give a stream a watermark first)."""
    w = F.window(ts, every)
    seconds = F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))
    return events.groupBy(w.alias("w")).agg(F.sum(count).alias("tokens")).select(F.col("w.start").alias("start"), "tokens", (F.col("tokens") / seconds).alias("per_second"))
