"""Domain tables derived from the given tables, once as DataFrames and once as SQL with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIT = 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, step, event_id, answer, value, l_sum, k, valid, hit): the probe trajectory of each question."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("qid"),
        ((F.row_number().over(order) - 1) * 50).cast("long").alias("step"),
        "event_id",
        F.col("event_type").alias("answer"),
        "value",
        (-F.col("value")).alias("l_sum"),
        k.alias("k"),
        (k % 5 != 0).alias("valid"),
        (F.col("value") >= HIT).alias("hit"),
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, step, a, b, c, d): four scores of each probe."""
    v, k = F.col("value"), F.col("k").cast("double")
    return probes(spark, sf_dir).select("qid", "step", (v / 100).alias("a"), (k / 50).alias("b"), (1 - v / 200).alias("c"), ((v + k) / 300).alias("d"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, rid, score, len, logp, ref): responses of a prompt."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.row_number().over(order).cast("long").alias("rid"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("len"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, reward, value, logp, ref, old): token-level records of a response, pos from 1."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"), F.row_number().over(order).cast("long").alias("pos"), F.col("l_discount").alias("reward"), F.col("l_tax").alias("value"),
        (-F.col("l_quantity") / 50).alias("logp"), (-F.col("l_quantity") / 50 + F.col("l_tax") - F.col("l_discount")).alias("ref"), (F.col("l_linenumber") % 7 != 0).alias("mask"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, arrival, queued, first, last, n): seconds of the events of a request, and its tokens."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("rid"), at.alias("at"), F.row_number().over(order).alias("rn"))
    pick = lambda n: F.min(F.when(F.col("rn") == n, F.col("at")))
    return rows.groupBy("rid").agg(pick(1).alias("arrival"), pick(2).alias("queued"), pick(3).alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, token, logit): a distribution over 64 tokens for each row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("token", "logit")).select("row", F.col("token").cast("long").alias("token"), F.col("logit").cast("double").alias("logit"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, trace): a reasoning text with an answer box, in four shapes."""
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit("<think> "), F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 0, F.concat(head, F.lit(" </think> \\boxed{\\frac{"), i, F.lit("}{7}} end")))
        .when(F.col("doc_id") % 4 == 1, F.concat(head, F.lit(" \\boxed{"), i, F.lit("} then \\boxed{x{"), i, F.lit("}y}")))
        .when(F.col("doc_id") % 4 == 2, F.concat(head, F.lit(" </think> \\boxed{"), i, F.lit(" open")))
        .otherwise(F.concat(head, F.lit(" </think> "), i))
        .alias("trace"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p): a label and a predicted probability."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return joined.select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("y"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p"), F.col("source"))


SQL = r"""
probes AS (
  SELECT user_id AS qid, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 50 AS step, event_id, event_type AS answer, value, -value AS l_sum,
    regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, regexp_extract(props, '([0-9]+)', 1)::BIGINT % 5 <> 0 AS valid, value >= 150.0 AS hit FROM events
),
slots AS (SELECT qid, step, value / 100 AS a, k::DOUBLE / 50 AS b, 1 - value / 200 AS c, (value + k::DOUBLE) / 300 AS d FROM probes),
responses AS (
  SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rid, l_discount AS score, l_quantity AS len FROM lineitem
),
tokens AS (
  SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_discount AS reward, l_tax AS value,
    -l_quantity / 50 AS logp, -l_quantity / 50 + l_tax - l_discount AS ref, l_linenumber % 7 <> 0 AS mask FROM lineitem
),
timed AS (SELECT user_id AS rid, epoch_us(ts) / 1e6::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
requests AS (
  SELECT rid, min(sec) FILTER (rn = 1) AS arrival, min(sec) FILTER (rn = 2) AS queued, min(sec) FILTER (rn = 3) AS "first", max(sec) AS "last", count(*) AS n FROM timed GROUP BY rid
),
logits AS (SELECT vec_id AS row, i - 1 AS token, embedding[i]::DOUBLE AS logit FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
traces AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<think> ' || text || ' </think> \boxed{\frac{' || doc_id || '}{7}} end'
    WHEN 1 THEN '<think> ' || text || ' \boxed{' || doc_id || '} then \boxed{x{' || doc_id || '}y}'
    WHEN 2 THEN '<think> ' || text || ' </think> \boxed{' || doc_id || ' open'
    ELSE '<think> ' || text || ' </think> ' || doc_id END AS trace FROM documents
),
predictions AS (SELECT doc_id AS id, quality::BIGINT AS y, (n_chars % 1000) / 1000.0::DOUBLE AS p, source FROM labels JOIN documents USING (doc_id))
"""


def sql(body: str) -> str:
    """A query over the derived tables; unused ones cost nothing."""
    return f"WITH {SQL.strip()}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().removeprefix('+')}"
