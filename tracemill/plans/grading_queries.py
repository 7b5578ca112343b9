"""Queries of graded answers, answer tags, closed questions and their training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import answers as G
from tracemill.functions import text as X
from tracemill.operators import closed_qa as Q
from tracemill.operators import rewards as R
from tracemill.operators import trajectory as T
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import probes, slots, sql, table, traces
from tracemill.session import ship


def r6(c, name):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def settled(c: str):
    """Rounded a little above: sums of decimals may stand exactly between two roundings, and err in the last bit."""
    return (F.round(F.col(c) + 1e-9, 6) + F.lit(0.0)).alias(c)


def shipped(query):
    def run(s, d):
        ship(s)
        return query(s, d)

    return run


part = lambda s, d: table(s, d, "part")
# --- forms and grading
def forms(s, d):
    n = F.col("p_size").cast("string")
    return part(s, d).select(
        "p_partkey",
        G.plain_text(F.concat(F.lit("{"), n, F.lit(" 1/2 meters}"))).alias("form"),
        G.plain_text(F.concat(F.lit("\\frac{"), n, F.lit("}{2} \\cdot \\sqrt{3}"))).alias("latex"),
        G.plain_text(F.concat(F.lit("\\text{"), n, F.lit(",000.0 dollars}"))).alias("worded"),
        G.plain_text(F.concat(n, F.lit(",000"))).alias("whole"),
    )


register("STR-6", shipped(forms), "SELECT p_partkey, p_size || '+1/2' AS form, p_size || '/2*sqrt(3)' AS latex, p_size || ',000.0dollars' AS worded, p_size || '000' AS whole FROM part")


def parts_of_answers(s, d):
    n = F.col("p_size").cast("string")
    return part(s, d).select(
        "p_partkey",
        F.array_join(X.tuple_parts(F.concat(F.lit("("), n, F.lit(", "), F.col("p_brand"), F.lit(")"))), "|").alias("parts"),
        X.is_fraction(F.concat(n, F.lit("/"), F.col("p_partkey") % 2)).alias("fraction"),
        X.is_whole(F.concat(n, F.lit(",000."), F.col("p_partkey") % 2)).alias("whole"),
        X.mixed_number(F.concat(n, F.lit("  1/2"))).alias("mixed"),
    )


register("STR-8", parts_of_answers, "SELECT p_partkey, p_size || '|' || p_brand AS parts, p_partkey % 2 = 1 AS fraction, p_partkey % 2 = 0 AS whole, p_size || '+1/2' AS mixed FROM part")


def graded(s, d):
    flag = F.floor(F.col("p_partkey") / 4) % 2
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + flag).cast("string")
    shape = F.col("p_partkey") % 4
    given = F.when(shape == 0, F.concat(n, F.lit("/7"))).when(shape == 1, F.concat(F.lit("2*"), n, F.lit("+x"))).when(shape == 2, F.concat(F.lit("sqrt("), n, F.lit(")"))).otherwise(F.concat(F.lit("(1, x+"), n, F.lit(")")))
    truth = F.when(shape == 0, F.concat(F.lit("\\dfrac{"), m, F.lit("}{7}"))).when(shape == 1, F.concat(F.lit("x + "), (2 * F.col("p_size") + flag).cast("string"))).when(shape == 2, F.concat(F.lit("\\sqrt{"), m, F.lit("}"))).otherwise(F.concat(F.lit("(1,"), m, F.lit("+x)")))
    return part(s, d).select("p_partkey", G.graded(given, truth).alias("right"))


register("STR-9", shipped(graded), "SELECT p_partkey, p_partkey // 4 % 2 = 0 AS right FROM part")
# --- scores of final answers
register(
    "RWD-8",
    lambda s, d: traces(s, d).withColumn("truth", F.when(F.col("doc_id") % 8 == 0, F.concat(F.col("doc_id"), F.lit("/7"))).when(F.col("doc_id") % 8 == 1, F.concat(F.lit("x{"), F.col("doc_id"), F.lit("}y"))).otherwise("0")).select("doc_id", G.boxed_score(F.col("trace"), F.col("truth")).alias("score")),
    sql("SELECT doc_id, (doc_id % 8 < 2)::INT::DOUBLE AS score FROM traces"),
)


def worded(s, d):
    text = F.concat(F.lit("Answer: 1\n"), F.repeat(F.lit("and so on "), F.lit(40)), F.lit("Answer: 7\nAnswer: x = $"), F.format_number("o_custkey", 0), F.lit("$ dollars"))
    scored = G.worded_score(text, (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string"))
    return table(s, d, "orders").select("o_orderkey", scored["score"].alias("score"), scored["pred"].alias("pred"))


register("RWD-9", worded, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS score, o_custkey::VARCHAR AS pred FROM orders")


def announced(s, d):
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + F.col("p_partkey") % 2).cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Step 2: the answer is \\boxed{"), n, F.lit("/7}. Done"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("We get "), n, F.lit(".00"))).otherwise(F.concat(n, F.lit("00% is the answer")))
    truth = F.when(F.col("p_partkey") % 3 == 0, F.concat(m, F.lit("/7"))).otherwise(m)
    shape = F.concat(F.lit("<think>hm</think> so \\boxed{"), n, F.lit("}"))
    return part(s, d).select("p_partkey", G.announced_score(said, truth).alias("score"), r6(G.geometry_score(shape, m), "geometry"))


register("RWD-10", shipped(announced), "SELECT p_partkey, (p_partkey % 2 = 0)::INT::DOUBLE AS score, round(0.9::DOUBLE * (p_partkey % 2 = 0)::INT + 0.1::DOUBLE, 6) AS geometry FROM part")
# --- answer tags
LETTER = "substr('ABCD', doc_id % 4 + 1, 1)"
GOLD = "substr('ABCD', doc_id // 4 % 4 + 1, 1)"


def tagged_texts(s, d):
    letter = F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    gold = F.substring(F.lit("ABCD"), (F.floor(F.col("doc_id") / 4) % 4 + 1).cast("int"), F.lit(1))
    text = F.concat(F.lit("<think> "), F.col("text"), F.lit(". (<answer>B</answer>) more <answer>"), letter, F.lit("</answer> tail</think> <final_answer>"), gold, F.lit("</final_answer> end"))
    return table(s, d, "documents").select("doc_id", text.alias("t"), gold.alias("gold"))


TAGGED = f"+tg AS (SELECT doc_id, length(text) AS n, {LETTER} AS letter, {GOLD} AS gold, regexp_matches(regexp_replace(text, '[A-Za-z]', '', 'g'), '\\p{{L}}') OR regexp_matches(text, ' {{10,}}') AS unfair, text FROM documents), w AS (SELECT *, 1 - (n + 4) / (n + 16)::DOUBLE AS w1, 1 - (n + 11) / (n + 16)::DOUBLE AS w2 FROM tg), sc AS (SELECT *, (w1 * (gold = 'B')::INT + w2 * (gold = letter)::INT) / (w1 + w2) AS score FROM w)"
register("RWD-4", shipped(lambda s, d: tagged_texts(s, d).withColumn("r", G.tagged(F.col("t"), F.col("gold"))).select("doc_id", r6("r.score", "score"), "r.tags")), sql(f"{TAGGED} SELECT doc_id, round(score, 6) + 0.0 AS score, 2::INT AS tags FROM sc"))
register("RWD-5", shipped(lambda s, d: tagged_texts(s, d).withColumn("r", G.sentence_tagged(F.col("t"), F.col("gold"))).select("doc_id", r6("r.score", "score"), "r.tags")), sql("+tg AS (SELECT doc_id, length(text) AS n, " + GOLD + " AS gold FROM documents) SELECT doc_id, round(CASE WHEN gold = 'B' THEN (1 - (n + 3) / (n + 20)::DOUBLE) / 2 ELSE 0.0 END, 6) + 0.0 AS score, 2::INT AS tags FROM tg"))


def tag_rewards(s, d):
    rows = tagged_texts(s, d).withColumn("r", G.tagged(F.col("t"), F.col("gold")))
    plain = R.tag_reward(F.col("t"), F.col("r.score"), F.col("doc_id") % 3 == 0)
    steps = F.size(X.thought_steps(F.col("t"))).cast("double")
    long = R.tag_reward(F.col("t"), F.col("r.score"), F.col("doc_id") % 3 == 0, X.length_match(steps, F.lit(10.0), F.lit(1.0)))
    return rows.select("doc_id", r6(plain, "score"), r6(long, "with_length"))


STEPS = r"len(list_filter(string_split_regex('<think> ' || text || '. (<answer>B</answer>) more <answer>' || letter || '</answer> tail</think> <final_answer>' || gold || '</final_answer> end', '->|[.!?\n]'), lambda p: trim(p) <> ''))"
BASE = "score / 8 + (doc_id % 3 = 0)::INT / 8.0::DOUBLE + (NOT unfair)::INT / 2.0::DOUBLE"
register("RWD-3", shipped(tag_rewards), sql(f"{TAGGED} SELECT doc_id, round({BASE} + (NOT unfair)::INT / 16.0::DOUBLE, 6) + 0.0 AS score, round({BASE} + (NOT unfair)::INT / 8.0::DOUBLE + least(1.0::DOUBLE, {STEPS} / 10.0::DOUBLE) / 8, 6) + 0.0 AS with_length FROM sc"))
# --- closed questions
F4 = "abcd"
over = lambda *c: ", ".join(x.format(c=k) for x in c for k in F4)
QID = "PARTITION BY qid ORDER BY step"
CURVE = "CASE WHEN n >= 5 THEN (2 * {x} - lag({x}, 1) OVER o - 2 * lag({x}, 2) OVER o - lag({x}, 3) OVER o + 2 * lag({x}, 4) OVER o) / 7 WHEN n = 4 THEN ({x} - lag({x}, 1) OVER o - lag({x}, 2) OVER o + lag({x}, 3) OVER o) / 2 WHEN n = 3 THEN {x} - 2 * lag({x}, 1) OVER o + lag({x}, 2) OVER o ELSE 0.0 END"
PAIRS = [(x, y) for i, x in enumerate(F4) for y in F4[i:]]
CELLS = ", ".join(f"avg({f'q_{x}' if x == y else '0'} - q_{x} * q_{y}) OVER l AS f_{x}{y}" for x, y in PAIRS)
OFF = " + ".join(f"2 * f_{x}{y} * f_{x}{y}" for x, y in PAIRS if x != y)
DOT = " + ".join("v_{c} * s_{c}".format(c=c) for c in F4)
SQUARE = " + ".join("v_{c} * v_{c}".format(c=c) for c in F4)
CLOSED = (
    "+mx AS (SELECT *, greatest(a, b, c, d) AS mm FROM slots), ee AS (SELECT *, " + over("exp({c} - mm) AS e_{c}") + " FROM mx), "
    "pp AS (SELECT *, " + over("e_{c} / (e_a + e_b + e_c + e_d + 1e-12) AS p_{c}") + " FROM ee), cc AS (SELECT *, " + over("sum(ln(greatest(p_{c}, 1e-12))) OVER f AS cum_{c}") + f", row_number() OVER o AS n, count(*) OVER (PARTITION BY qid) AS m FROM pp WINDOW o AS ({QID}), f AS ({QID} ROWS UNBOUNDED PRECEDING)), "
    "rk AS (SELECT *, list_reverse_sort([" + ", ".join(f"{{'s': cum_{c}, 'l': '{c.upper()}'}}" for c in F4) + "]) AS r FROM cc), tp AS (SELECT *, r[1].l AS cum_top, r[1].s - r[2].s AS cum_margin FROM rk), "
    f"cg AS (SELECT *, coalesce((cum_top <> lag(cum_top) OVER ({QID}))::BIGINT, 0) AS ch FROM tp), fl AS (SELECT *, (sum(ch) OVER ({QID} ROWS UNBOUNDED PRECEDING))::BIGINT AS flips FROM cg), "
    "vv AS (SELECT *, row_number() OVER (PARTITION BY qid, flips ORDER BY step) AS run_len, " + over("cum_{c} - lag(cum_{c}) OVER o AS v_{c}", "cum_{c} - 2 * lag(cum_{c}) OVER o + lag(cum_{c}, 2) OVER o AS s_{c}", "greatest(p_{c}, 1e-12) / (greatest(p_a, 1e-12) + greatest(p_b, 1e-12) + greatest(p_c, 1e-12) + greatest(p_d, 1e-12)) AS q_{c}") + f" FROM fl WINDOW o AS ({QID})), "
    f"ff AS (SELECT *, {CELLS}, avg(-(" + " + ".join(f"q_{c} * ln(q_{c} + 1e-12)" for c in F4) + ")) OVER l AS fi_entropy, "
    f"cum_margin - coalesce(lag(cum_margin, 2) OVER o, first_value(cum_margin) OVER f) AS delta_recent, CASE WHEN n > 1 THEN (cum_margin - first_value(cum_margin) OVER f) / (n - 1) ELSE 0.0 END AS slope_recent, {CURVE.format(x='cum_margin')} AS curv_margin2, " + ", ".join(f"{CURVE.format(x=f'cum_{c}')} AS curv_{c}2" for c in F4) + f", {SQUARE} AS sq, {DOT} AS dt FROM vv WINDOW o AS ({QID}), f AS ({QID} ROWS UNBOUNDED PRECEDING), l AS ({QID} ROWS 4 PRECEDING)), "
    "kk AS (SELECT *, n / m::DOUBLE AS step_ratio, CASE WHEN n >= 3 THEN sqrt(sq) ELSE 0.0 END AS vel_norm, CASE WHEN n >= 3 THEN sqrt(" + " + ".join("s_{c} * s_{c}".format(c=c) for c in F4) + ") ELSE 0.0 END AS acc_norm, CASE WHEN n >= 3 THEN sqrt(" + " + ".join(f"pow(s_{c} - dt / (sq + 1e-9) * v_{c}, 2)" for c in F4) + ") / (sq + 1e-9) ELSE 0.0 END AS kappa, "
    f"f_aa + f_bb + f_cc + f_dd AS fi_trace, sqrt({OFF}) AS fi_offdiag FROM ff)"
)
SHOWN = [c for c in Q.FEATURES if c != "fi_lmax"]
WHOLE = ("run_len", "flips")
register("WIN-11", lambda s, d: Q.featured(slots(s, d)).select("qid", "step", *[F.col(c) if c in WHOLE else settled(c) for c in SHOWN]), sql(f"{CLOSED} SELECT qid, step, " + ", ".join(c if c in WHOLE else f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in SHOWN) + " FROM kk"))
register("WIN-11-lmax", lambda s, d: Q.featured(slots(s, d)).select("qid", "step", r6("fi_lmax", "fi_lmax")))


def letters(s, d):
    k = F.col("p_partkey")
    first, second = F.when(k % 4 == 0, "B) x").otherwise("the"), F.when(k % 4 == 1, " (c").otherwise("end")
    text, hint = F.when(k % 4 == 2, "answer: d"), F.when(k % 8 == 3, "A").otherwise("E")
    return part(s, d).select("p_partkey", Q.probe_letter(first, second, text, hint).alias("p")).select("p_partkey", "p.letter", "p.eligible")


register("PRB-3", letters, "SELECT p_partkey, l AS letter, l IS NOT NULL AS eligible FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'B' WHEN p_partkey % 4 = 1 THEN 'C' WHEN p_partkey % 4 = 2 THEN 'D' WHEN p_partkey % 8 = 3 THEN 'A' END AS l FROM part)")


def trained(s, d):
    said = F.nullif(F.substring(F.lit("abcdX"), (F.col("k") % 5 + 1).cast("int"), F.lit(1)), F.lit("X"))
    rows = slots(s, d).join(probes(s, d).select("qid", "step", said.alias("pred")), ["qid", "step"])
    last = rows.groupBy("qid").agg(F.max_by("pred", "step").alias("final"))
    out = Q.training_rows(rows.join(last, "qid"), "pred", "final")
    return out.select("qid", "k", "m", "gold", "pred", "y", F.size("x").cast("long").alias("n_features"), r6(F.col("x")[4], "margin"))


SAID = "nullif(substr('abcdX', k % 5 + 1, 1), 'X')"
register(
    "PRB-6",
    trained,
    sql(f"{CLOSED}, sd AS (SELECT qid, step, {SAID} AS pred, row_number() OVER ({QID}) AS k2 FROM probes), fn AS (SELECT qid, upper(coalesce(last(pred ORDER BY step), '')) AS gold FROM sd GROUP BY qid) SELECT sd.qid, k2 AS k, m, gold, pred, coalesce(gold <> '' AND upper(pred) = gold, false)::BIGINT AS y, 30::BIGINT AS n_features, round(cum_margin, 6) + 0.0 AS margin FROM sd JOIN fn USING (qid) JOIN kk ON kk.qid = sd.qid AND kk.step = sd.step"),
)
