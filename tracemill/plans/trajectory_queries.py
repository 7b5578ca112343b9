"""Queries over probe trajectories, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import relational as R
from tracemill.operators import trajectory as T
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import probes, slots, sql



# Columns exist only while a session runs, so whatever builds them is a function.
def W():
    return T.per_question("event_id")


def r6(c: str, digits: int = 6):
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


def feature(name: str, columns, sql_columns: str, digits: int = 6):
    """A query of probes with the given feature columns."""
    register(
        name,
        lambda s, d: (lambda c: probes(s, d).withColumns(c).select("qid", "step", *[r6(x, digits) for x in c]))(columns(F.col("value"), F.col("l_sum"), W())),
        sql(f"SELECT qid, step, {sql_columns} FROM probes WINDOW w AS (PARTITION BY qid ORDER BY step, event_id), f AS (PARTITION BY qid ORDER BY step, event_id ROWS UNBOUNDED PRECEDING)"),
    )


CUM = r"""+soft AS (SELECT *, greatest(a, b, c, d) AS m FROM slots),
ex AS (SELECT *, exp(a - m) AS ea, exp(b - m) AS eb, exp(c - m) AS ec, exp(d - m) AS ed FROM soft),
cum AS (SELECT qid, step, sum(ln(ea / (ea + eb + ec + ed + 1e-12) + 1e-9)) OVER w AS cum_a, sum(ln(eb / (ea + eb + ec + ed + 1e-12) + 1e-9)) OVER w AS cum_b,
  sum(ln(ec / (ea + eb + ec + ed + 1e-12) + 1e-9)) OVER w AS cum_c, sum(ln(ed / (ea + eb + ec + ed + 1e-12) + 1e-9)) OVER w AS cum_d FROM ex WINDOW w AS (PARTITION BY qid ORDER BY step ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT *, list_reverse_sort([{'s': cum_a, 'l': 'A'}, {'s': cum_b, 'l': 'B'}, {'s': cum_c, 'l': 'C'}, {'s': cum_d, 'l': 'D'}]) AS r FROM cum),
topped AS (SELECT qid, step, cum_a, cum_b, cum_c, cum_d, r[1].l AS cum_top, r[1].s - r[2].s AS cum_margin FROM ranked)
"""
FOUR = ("a", "b", "c", "d")


def cumulated(s, d):
    return T.cumulative_scores(slots(s, d), FOUR, T.per_question())


register("WIN-1", lambda s, d: cumulated(s, d).select("qid", "step", *[r6(f"cum_{c}") for c in FOUR]), sql(CUM + "SELECT qid, step, round(cum_a, 6) AS cum_a, round(cum_b, 6) AS cum_b, round(cum_c, 6) AS cum_c, round(cum_d, 6) AS cum_d FROM cum"))
register("WIN-2", lambda s, d: T.top_letter(cumulated(s, d), FOUR).select("qid", "step", "cum_top", r6("cum_margin")), sql(CUM + "SELECT qid, step, cum_top, round(cum_margin, 6) AS cum_margin FROM topped"))
register(
    "WIN-3",
    lambda s, d: T.runs(probes(s, d), "answer", W()).select("qid", "step", "run_len", "flips"),
    sql("+marked AS (SELECT *, coalesce((answer <> lag(answer) OVER (PARTITION BY qid ORDER BY step, event_id))::BIGINT, 0) AS ch FROM probes), isl AS (SELECT *, (sum(ch) OVER (PARTITION BY qid ORDER BY step, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS flips FROM marked) SELECT qid, step, row_number() OVER (PARTITION BY qid, flips ORDER BY step, event_id) AS run_len, flips FROM isl"),
)
feature("WIN-4", lambda x, y, w: {"delta_recent": T.delta_recent(x, w)}, "round(value - coalesce(lag(value, 2) OVER w, first_value(value) OVER f), 6) + 0.0 AS delta_recent")
feature("WIN-5", lambda x, y, w: {"slope_recent": T.slope_recent(x, w)}, "round(CASE WHEN row_number() OVER w > 1 THEN (value - first_value(value) OVER f) / (row_number() OVER w - 1) ELSE 0.0 END, 11) + 0.0 AS slope_recent", 11)
feature(
    "WIN-6",
    lambda x, y, w: {"curv": T.curvature(x, w)},
    "round(CASE WHEN row_number() OVER w >= 5 THEN (2 * value - lag(value, 1) OVER w - 2 * lag(value, 2) OVER w - lag(value, 3) OVER w + 2 * lag(value, 4) OVER w) / 7 WHEN row_number() OVER w = 4 THEN (value - lag(value, 1) OVER w - lag(value, 2) OVER w + lag(value, 3) OVER w) / 2 WHEN row_number() OVER w = 3 THEN value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w ELSE 0.0 END, 6) + 0.0 AS curv",
)
register(
    "WIN-7",
    lambda s, d: T.step_energy(probes(s, d), "l_sum", W()).select("qid", "step", r6("s_es"), r6("h_es")),
    sql("+e AS (SELECT *, coalesce(l_sum - lag(l_sum) OVER (PARTITION BY qid ORDER BY step, event_id), 0.0) AS s FROM probes) SELECT qid, step, round(s, 6) + 0.0 AS s_es, round(coalesce(s - lag(s) OVER (PARTITION BY qid ORDER BY step, event_id), 0.0), 6) + 0.0 AS h_es FROM e"),
)
feature("WIN-8", lambda x, y, w: {"vel_l": T.velocity(y, w), "acc_l": T.acceleration(y, w)}, "round(coalesce(l_sum - lag(l_sum) OVER w, 0.0), 6) + 0.0 AS vel_l, round(coalesce(l_sum - 2 * lag(l_sum) OVER w + lag(l_sum, 2) OVER w, 0.0), 6) + 0.0 AS acc_l")
register(
    "WIN-9",
    lambda s, d: T.sticky_runs(probes(s, d).withColumn("key", F.when(F.col("valid"), F.col("answer"))), "key", W()).select("qid", "step", "changed_prev", "run_len", "flips"),
    sql("+kd AS (SELECT *, CASE WHEN valid THEN answer END AS key FROM probes), b AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY qid ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kd), c AS (SELECT *, coalesce((key IS NOT NULL AND before IS NOT NULL AND key <> before)::BIGINT, 0) AS changed_prev FROM b), i AS (SELECT *, (sum(changed_prev) OVER (PARTITION BY qid ORDER BY step, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS flips FROM c) SELECT qid, step, changed_prev, greatest(count(key) OVER (PARTITION BY qid, flips ORDER BY step, event_id ROWS UNBOUNDED PRECEDING), 1) AS run_len, flips FROM i"),
)
feature("WIN-10", lambda x, y, w: {"delta_recent_l": T.delta_recent(y, w), "slope_recent_l": T.slope_recent(y, w)}, "round(l_sum - coalesce(lag(l_sum, 2) OVER w, first_value(l_sum) OVER f), 11) + 0.0 AS delta_recent_l, round(CASE WHEN row_number() OVER w > 1 THEN (l_sum - first_value(l_sum) OVER f) / (row_number() OVER w - 1) ELSE 0.0 END, 11) + 0.0 AS slope_recent_l", 11)
FINAL = "+fin AS (SELECT qid, arg_max(answer, {'s': step, 'e': event_id}) AS final_answer FROM probes WHERE valid GROUP BY qid)"
register("WIN-12", lambda s, d: T.final_answers(probes(s, d)).select("qid", "final_answer").distinct(), sql(FINAL + " SELECT qid, final_answer FROM (SELECT DISTINCT qid FROM probes) LEFT JOIN fin USING (qid)"))
LABELLED = "SELECT qid, step, coalesce(valid AND final_answer <> '' AND answer = final_answer, false)::BIGINT AS y FROM probes LEFT JOIN fin USING (qid)"
register("WIN-13", lambda s, d: T.final_answers(probes(s, d)).select("qid", "step", "y"), sql(f"{FINAL} {LABELLED}"))
register(
    "WIN-14",
    lambda s, d: probes(s, d).filter("hit").groupBy("qid").agg(F.min("step").alias("step"), F.min_by("answer", F.struct("step", "event_id")).alias("answer")),
    sql("SELECT qid, min(step) AS step, arg_min(answer, {'s': step, 'e': event_id}) AS answer FROM probes WHERE hit GROUP BY qid"),
)
register(
    "WIN-15",
    lambda s, d: probes(s, d).groupBy("qid").agg(F.max("step").alias("step"), F.max_by("answer", F.struct("step", "event_id")).alias("answer")),
    sql("SELECT qid, max(step) AS step, arg_max(answer, {'s': step, 'e': event_id}) AS answer FROM probes GROUP BY qid"),
)
register(
    "WIN-16",
    lambda s, d: T.final_answers(probes(s, d)).withColumn("k", F.row_number().over(W())).groupBy("qid").agg(F.min(F.when(F.col("y") == 1, F.col("k"))).cast("long").alias("first_match"), F.count("*").alias("prefixes")).withColumn("score", F.round(F.coalesce(1 - F.col("first_match") / F.col("prefixes"), F.lit(0.0)), 6)),
    sql(f"{FINAL}, lab AS ({LABELLED}), num AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY step) AS kk FROM lab) SELECT qid, min(kk) FILTER (y = 1) AS first_match, count(*) AS prefixes, round(coalesce(1 - min(kk) FILTER (y = 1) / count(*)::DOUBLE, 0.0), 6) AS score FROM num GROUP BY qid"),
)
# Contiguous shards of ceil(total / 8) rows: positions by range, not by one global sort task.
register(
    "WIN-17",
    lambda s, d: (lambda t, n: R.numbered(t.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.floor(F.col("row") / F.lit(-(-n // 8))).alias("shard")))(*(lambda t: (t, t.count()))(s.read.parquet(f"{d}/orders.parquet"))),
    "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT (count(*) + 7) // 8 FROM orders))::BIGINT AS shard FROM orders",
)
register("PRJ-9", lambda s, d: T.one_hot(T.top_letter(cumulated(s, d), FOUR)).select("qid", "step", "is_a", "is_b", "is_c", "is_d"), sql(CUM + "SELECT qid, step, (cum_top = 'A')::DOUBLE AS is_a, (cum_top = 'B')::DOUBLE AS is_b, (cum_top = 'C')::DOUBLE AS is_c, (cum_top = 'D')::DOUBLE AS is_d FROM topped"))
register(
    "AGG-4",
    lambda s, d: T.early_stop_report(probes(s, d)),
    sql(
        "+per AS (SELECT qid, arg_max(answer, {'s': step, 'e': event_id}) AS la, arg_min(answer, {'s': step, 'e': event_id}) FILTER (hit) AS ha, min(step) FILTER (hit) AS hs, arg_max(answer, {'s': step, 'e': event_id}) FILTER (valid) AS fa FROM probes GROUP BY qid) "
        "SELECT count(*) AS questions, count(hs) AS stopped, round(avg((hs IS NOT NULL)::INT), 6) AS coverage, round(avg((ha = fa)::INT) FILTER (hs IS NOT NULL), 6) AS acc_when_stop, round(avg(hs), 6) AS avg_stop, round(avg((la = fa)::INT), 6) AS acc_last_step, round(avg(CASE WHEN hs IS NOT NULL THEN (ha = fa)::INT ELSE (la = fa)::INT END), 6) AS acc_blended FROM per WHERE fa IS NOT NULL"
    ),
)
register("FLT-6", lambda s, d: probes(s, d).withColumn("m", F.max("step").over(Window.partitionBy("qid"))).filter("step < m").select("qid", "step", "answer"), sql("SELECT qid, step, answer FROM probes QUALIFY step < max(step) OVER (PARTITION BY qid)"))
register("FLT-8", lambda s, d: probes(s, d).filter("answer <> '' and valid").select("qid", "step"), sql("SELECT qid, step FROM probes WHERE answer <> '' AND valid"))
register("AGG-3", lambda s, d: probes(s, d).filter("hit").agg(F.countDistinct("qid").alias("questions")), sql("SELECT count(DISTINCT qid) AS questions FROM probes WHERE hit"))
