"""Queries of callables, terminal states and smaller operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tracemill.operators import rewards, rules
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import logits, probes, responses, sql, table, traces
from tracemill.session import ship, work_dir
from tracemill.streaming import early_stop


def logistic(value):
    return 1 / (1 + np.exp(-(value - 100.0) / 50.0))


def leading_number(text):
    return float(text[0]) / (int(text[0]) - 3)


def udf_1(s, d):
    ship(s)
    return rules.apply_rule(table(s, d, "events"), logistic, ["value"], "prob").select("event_id", F.round("prob", 6).alias("prob"))


def rwd_14(s, d):
    ship(s)
    return rules.apply_guarded(table(s, d, "orders"), leading_number, "o_orderpriority", "score").select("o_orderkey", F.round("score", 6).alias("score"))


def bal_3(s, d):
    ship(s)
    rows = responses(s, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rid", "len"))).alias("r"))
    return rows.select("uid", F.col("r.rid").alias("rids"), F.col("r.len").alias("lens")).mapInPandas(rules.micro_batch_rows(60), "uid long, rid long, batch long")


def streamed(s, d, threshold: float, interval: int):
    """Steps that the streaming state function looks at, over a stream fed from files of the shared folder."""
    ship(s)
    home = f"{work_dir(s)}/stream-{uuid.uuid4().hex}"
    source = probes(s, d).select("qid", "step", "event_id", "answer", "value")
    source.repartition("qid").write.parquet(f"{home}/in")
    stream = early_stop.stream_features(s.readStream.schema(source.schema).parquet(f"{home}/in"), threshold, interval)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{home}/out").select("qid", "step", "stopped")


register("UDF-1", udf_1, "SELECT event_id, round(1 / (1 + exp(-(value - 100.0) / 50.0)), 6) AS prob FROM events")
register("RWD-14", rwd_14, "SELECT o_orderkey, round(CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 0.0::DOUBLE ELSE substr(o_orderpriority, 1, 1)::DOUBLE / (substr(o_orderpriority, 1, 1)::INT - 3) END, 6) AS score FROM orders")
register("BAL-3", bal_3)
register("STM-2", lambda s, d: streamed(s, d, float("inf"), 120).select("qid", "step"), sql("SELECT qid, step FROM probes WHERE step % 150 = 0"))
register("MTH-6", lambda s, d: logits(s, d).filter("token in (3, 5)").groupBy("row").agg(F.max(F.when(F.col("token") == 3, F.col("logit"))).alias("h"), F.max(F.when(F.col("token") == 5, F.col("logit"))).alias("e")).select("row", F.round(F.coalesce(1 / (1 + F.exp(F.col("e") - F.col("h"))), F.lit(1.0)), 6).alias("hard")), sql("SELECT row, round(1 / (1 + exp(max(logit) FILTER (token = 5) - max(logit) FILTER (token = 3))), 6) AS hard FROM logits GROUP BY row"))
register("PRB-5", lambda s, d: rewards.chosen_step(probes(s, d), F.lit(False), F.col("k") % 5).select("qid", "step"), sql("SELECT qid, step FROM probes QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k % 5 DESC, step DESC) = 1"))
register("STR-18", lambda s, d: traces(s, d).select("doc_id", F.array_join(rules.quantile_places(F.size(F.split("trace", r"\. ")), 4), ",").alias("places")), sql("+n AS (SELECT doc_id, len(string_split(trace, '. ')) AS n FROM traces) SELECT doc_id, array_to_string(list_transform(range(1, 5), lambda i: list_max(list_transform(range(1, i + 1), lambda j: (ceil(j * n / 5.0::DOUBLE) - 1 + i - j)::BIGINT))), ',') AS places FROM n"))
register("STR-26", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.transform(F.split(F.replace("text", F.lit(". "), F.lit("->")), "->", -1), lambda p: F.trim(p)), " -> ").alias("joined")), "SELECT doc_id, array_to_string(list_transform(string_split(replace(text, '. ', '->'), '->'), lambda p: trim(p)), ' -> ') AS joined FROM documents")
