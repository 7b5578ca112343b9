"""Queries of sources, streams and classifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators import learning
from tracemill.operators import trajectory as T
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import probes, sql, table
from tracemill.session import ship, work_dir
from tracemill.sources import readers
from tracemill.streaming import early_stop


def round_trip(name: str, df: DataFrame, write) -> tuple[SparkSession, str]:
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    return df.sparkSession, path


def src_csv(s, d):
    df = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return readers.read_csv(*round_trip("csv", df, readers.write_results)).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


def src_json(s, d):
    df = table(s, d, "customer").select("c_custkey", "c_name")
    return readers.read_json(*round_trip("json", df, readers.write_probe_log)).select("c_custkey", "c_name")


def src_probe_log(s, d):
    rows = probes(s, d).select(
        F.col("qid").cast("string").alias("qid"),
        F.struct(F.col("step").cast("int").alias("step"), F.lit("interval").alias("kind"), F.col("answer").alias("probe_text"), F.create_map(F.lit("step"), F.col("step").cast("string")).alias("feats"), F.lit("openqa").alias("qa_mode"), F.col("hit").cast("string").alias("early_stop_triggered")).alias("probe_record"),
    )
    return readers.read_probe_log(*round_trip("probes", rows, readers.write_probe_log)).select("qid", F.col("step").cast("long").alias("step"), "probe_answer", "early_stop")


def snk_resume(s, d):
    df = table(s, d, "supplier").select(F.col("s_suppkey").alias("_id"), "s_name")
    path = f"{work_dir(s)}/resume-{uuid.uuid4().hex}"
    readers.append_missing(df.filter("_id % 3 = 0"), path)
    readers.append_missing(df, path)
    return s.read.json(path).select("_id", "s_name")


def stm_features(s, d):
    """The stream is fed from files in the shared folder and run to the end; its rows equal the batch features."""
    ship(s)
    home = f"{work_dir(s)}/stream-{uuid.uuid4().hex}"
    source = probes(s, d).select("qid", "step", "event_id", "answer", "value")
    source.repartition("qid").write.parquet(f"{home}/in")
    stream = s.readStream.schema(source.schema).parquet(f"{home}/in")
    query = early_stop.stream_features(stream).writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = s.read.parquet(f"{home}/out")
    return out.select("qid", "step", (F.round("velocity", 6) + F.lit(0.0)).alias("velocity"), (F.round("acceleration", 6) + F.lit(0.0)).alias("acceleration"), (F.round("delta", 6) + F.lit(0.0)).alias("delta"), "run_len", "flips")


def ml_1(s, d):
    df = T.final_answers(probes(s, d)).withColumn("velocity", T.velocity(F.col("value"), T.per_question("event_id")))
    features = ["step", "value", "velocity", "k"]
    model = learning.fit(df.filter("qid % 5 <> 0"), features, "y")
    return learning.score(model, df.filter("qid % 5 = 0"), features).select("qid", "step", "y", "prob")


register("SRC-1", lambda s, d: readers.read_any(s, f"{d}/customer.parquet").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer")
register("SRC-2", src_json, "SELECT c_custkey, c_name FROM customer")
register("SRC-3", src_probe_log, sql("SELECT qid::VARCHAR AS qid, step, answer AS probe_answer, hit AS early_stop FROM probes"))
register("SRC-4", src_csv, "SELECT c_custkey, c_name, c_mktsegment FROM customer")
register("SRC-5", lambda s, d: s.read.parquet(f"{d}/nation.parquet", f"{d}/nation.parquet").groupBy("n_name").agg(F.count("*").alias("n")), "SELECT n_name, 2::BIGINT AS n FROM nation")
register("SNK-5", snk_resume, "SELECT s_suppkey AS _id, s_name FROM supplier")
register(
    "STM-1",
    lambda s, d: early_stop.deltas(table(s, d, "documents").select("doc_id", F.posexplode(F.array(F.substring("text", 1, 50), F.substring("text", 1, 120), F.col("text"))).alias("i", "text")), "doc_id", ["i"], "text").select("doc_id", F.col("i").cast("long").alias("i"), F.length("delta").cast("long").alias("chars")),
    "SELECT doc_id, i, length(t[i + 1]) - CASE WHEN i > 0 THEN length(t[i]) ELSE 0 END AS chars FROM (SELECT doc_id, [substr(text, 1, 50), substr(text, 1, 120), text] AS t, unnest(range(3)) AS i FROM documents)",
)
register(
    "STM-3",
    stm_features,
    sql(
        "+b AS (SELECT qid, step, event_id, round(coalesce(value - lag(value) OVER w, 0.0), 6) + 0.0 AS velocity, round(coalesce(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 0.0), 6) + 0.0 AS acceleration, round(value - coalesce(lag(value, 2) OVER w, first_value(value) OVER (PARTITION BY qid ORDER BY step, event_id ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS delta, coalesce((answer <> lag(answer) OVER w)::BIGINT, 0) AS ch FROM probes WINDOW w AS (PARTITION BY qid ORDER BY step, event_id)), "
        "i AS (SELECT *, (sum(ch) OVER (PARTITION BY qid ORDER BY step, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS flips FROM b) SELECT qid, step, velocity, acceleration, delta, row_number() OVER (PARTITION BY qid, flips ORDER BY step, event_id) AS run_len, flips FROM i"
    ),
)
register("STM-5", lambda s, d: probes(s, d).filter("hit and valid").groupBy("qid").agg(F.min("step").alias("stopped_at")), sql("SELECT qid, min(step) AS stopped_at FROM probes WHERE hit AND valid GROUP BY qid"))
register("STM-8", lambda s, d: early_stop.throughput(table(s, d, "events").withColumn("n", F.lit(1)), "ts", "n", "1 day").select(F.col("start").cast("string").alias("start"), "tokens", F.round("per_second", 6).alias("per_second")), "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS tokens, round(count(*) / 86400.0::DOUBLE, 6) AS per_second FROM events GROUP BY 1")
register("ML-1", ml_1)
