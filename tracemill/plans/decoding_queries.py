"""Queries of logit masks, draft verification, beams, pooling, arrivals, oversampling and pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import decoding as D
from tracemill.operators import relational as R
from tracemill.operators import sampling as S
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import logits, responses, sql, table


def r6(c, name):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def uniform(*parts: str) -> str:
    """SQL of operators.aggregates.uniform over SQL expressions."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


# --- masks of logits: two bad words a row, of which one ends the output; stop token 2 is too early
def masked(s, d):
    rows = logits(s, d).withColumn("output", F.array(F.col("row") % 64, F.lit(7).cast("long")))
    word = F.explode(F.array(F.array(F.lit(7).cast("long"), F.col("row") % 10 + 10), F.array(F.col("row") % 64 + 100, F.lit(3).cast("long")), F.array(F.lit(9).cast("long"))))
    bad = table(s, d, "embeddings").select(F.col("vec_id").alias("row")).select("row", word.alias("word"))
    out = D.masked_logits(rows, F.col("token") % 5 != 0, F.when(F.col("token") == 7, 1.5), 64, bad, 3, [2])
    return out.filter(F.col("logit") > float("-inf")).select("row", "token", r6("logit", "logit"))


register("LGT-4", masked, sql("SELECT row, token, round(logit + CASE WHEN token = 7 THEN 1.5 ELSE 0.0 END, 6) + 0.0 AS logit FROM logits WHERE token % 5 <> 0 AND token <> 2 AND token <> 9 AND token <> row % 10 + 10"))


# --- drafts
def greedy(s, d):
    rows = responses(s, d).select(F.col("uid").alias("seq"), F.col("rid").alias("pos"), F.col("rid").alias("draft"), (F.col("rid") + (F.col("len") % 7 == 0).cast("long")).alias("target"), F.lit(99).cast("long").alias("bonus"))
    return D.accepted_greedy(rows)


register(
    "LGT-6",
    greedy,
    sql("+dr AS (SELECT uid AS seq, rid AS pos, rid AS draft, rid + (len % 7 = 0)::BIGINT AS target FROM responses), f AS (SELECT seq, min(pos) FILTER (draft <> target) AS f, max(pos) AS top FROM dr GROUP BY seq) SELECT seq, pos, target AS token FROM dr JOIN f USING (seq) WHERE f IS NULL OR pos <= f UNION ALL SELECT seq, top + 1, 99::BIGINT FROM f WHERE f IS NULL"),
)


def random_drafts(s, d):
    soft = S.softmax(logits(s, d)).select("row", "token", "p")
    other = soft.select((F.col("row") - 1).alias("row"), "token", F.col("p").alias("q"))
    rows = soft.join(other, ["row", "token"]).select(F.floor(F.col("row") / 4).alias("seq"), (F.col("row") % 4 + 1).alias("pos"), "token", "p", "q")
    drafts = rows.filter("pos <= 3").groupBy("seq", "pos").agg(F.max_by("token", F.struct("q", -F.col("token"))).alias("token"))
    return D.accepted_random(rows, drafts, 5)


RACE, ACCEPT = uniform("'5'", "'race'", "seq", "pos", "token"), uniform("'5'", "'accept'", "seq", "pos")
register(
    "LGT-6-random",
    random_drafts,
    sql(
        "+z AS (SELECT *, logit - max(logit) OVER (PARTITION BY row) AS sh FROM logits), sm AS (SELECT row, token, exp(sh - ln(sum(exp(sh)) OVER (PARTITION BY row))) AS p FROM z), "
        "pq AS (SELECT a.row // 4 AS seq, a.row % 4 + 1 AS pos, a.token, a.p, b.p AS q FROM sm a JOIN sm b ON b.row = a.row + 1 AND b.token = a.token), "
        f"rc AS (SELECT *, -ln({RACE}) AS race FROM pq), per AS (SELECT seq, pos, CASE WHEN pos <= 3 THEN arg_max(token, {{'q': q, 't': -token}}) END AS draft, arg_max(p, {{'q': q, 't': -token}}) AS dp, max(q) AS dq, arg_max(token, {{'w': greatest(p - q, 0) / race, 't': -token}}) AS recovered, arg_max(token, {{'w': p / race, 't': -token}}) AS bonus FROM rc GROUP BY seq, pos), "
        f"ok AS (SELECT *, draft IS NOT NULL AND dp / dq >= {ACCEPT} AS ok FROM per), f AS (SELECT *, min(pos) FILTER (NOT ok) OVER (PARTITION BY seq) AS f FROM ok) "
        "SELECT seq, pos, CASE WHEN ok THEN draft WHEN draft IS NULL THEN bonus ELSE recovered END AS token, CASE WHEN ok THEN 'accepted' WHEN draft IS NULL THEN 'bonus' ELSE 'recovered' END AS kind FROM f WHERE f IS NULL OR pos <= f"
    ),
)


# --- beams: the log-probability of a token is a fixed function of sequence, last token, place and token
def next_logp(last, size):
    return -((F.col("seq") * 7 + last * 5 + F.col("token") * 3 + size * 11) % 13 + 1) / 4.0


def beams(s, d):
    start = table(s, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.array(F.lit(1).cast("long")).alias("tokens"), F.lit(0.0).alias("cum"))

    def step(found):
        grown = found.withColumn("token", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("logp", next_logp(F.element_at("tokens", -1), F.size("tokens")))
        likeliest = Window.partitionBy("seq", "tokens").orderBy(F.desc("logp"), "token")
        return grown.withColumn("n", F.row_number().over(likeliest)).filter("n <= 4").drop("n")

    found = D.beam_search(start, step, 3, 2, 0, 0.8)
    return found.select("seq", "rank", F.array_join("tokens", ",").alias("tokens"), r6("score", "score"))


def beams_sql(steps: int = 3, width: int = 2) -> str:
    out, last = ["b0 AS (SELECT s_suppkey AS seq, [1::BIGINT] AS tokens, 0.0::DOUBLE AS cum FROM supplier)"], "b0"
    ended = []
    for i in range(1, steps + 1):
        out.append(f"g{i} AS (SELECT seq, tokens, cum, token, -((seq * 7 + tokens[-1] * 5 + token * 3 + len(tokens) * 11) % 13 + 1) / 4.0::DOUBLE AS logp FROM {last}, range(6) t(token) QUALIFY row_number() OVER (PARTITION BY seq, tokens ORDER BY logp DESC, token) <= 4)")
        out.append(f"n{i} AS (SELECT seq, list_append(tokens, token) AS tokens, cum + logp AS cum, token, (cum + logp) / pow((len(tokens) + (token <> 0)::INT)::DOUBLE, 0.8::DOUBLE) AS score FROM g{i})")
        out.append(f"b{i} AS (SELECT seq, tokens, cum, score FROM n{i} WHERE token <> 0 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, tokens) <= {width})")
        ended.append(f"SELECT seq, tokens, score FROM n{i} WHERE token = 0")
        last = f"b{i}"
    every = " UNION ALL ".join([*ended, f"SELECT seq, tokens, score FROM {last}"])
    return f"WITH {', '.join(out)}, every AS ({every}) SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY score DESC, tokens) AS rank, array_to_string(tokens, ',') AS tokens, round(score, 6) + 0.0 AS score FROM every QUALIFY rank <= {width}"


register("SRT-8", beams, beams_sql())


# --- pooling
def states(s, d):
    return table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("pos"), F.col("label").alias("token"), F.col("embedding").alias("state"))


def pooling(s, d):
    parts = []
    for mode in ("CLS", "LAST", "MEAN", "ALL", "STEP"):
        got = D.pooled(states(s, d), mode, 3)
        pos = F.col("pos") if "pos" in got.columns else F.lit(None).cast("long")
        parts.append(got.select(F.lit(mode).alias("mode"), "seq", pos.alias("pos"), r6(F.col("state")[0].cast("double"), "x0"), r6(F.col("state")[63].cast("double"), "x63")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


X0 = "round(({0})::DOUBLE, 6) + 0.0 AS x0, round(({1})::DOUBLE, 6) + 0.0 AS x63"
ST = "WITH st AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS pos, label AS token, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS z FROM embeddings) "
register(
    "POOL-1",
    pooling,
    ST + f"SELECT 'CLS' AS mode, seq, NULL::BIGINT AS pos, {X0.format('arg_min(a, pos)', 'arg_min(z, pos)')} FROM st GROUP BY seq UNION ALL SELECT 'LAST', seq, NULL, {X0.format('arg_max(a, pos)', 'arg_max(z, pos)')} FROM st GROUP BY seq UNION ALL SELECT 'MEAN', seq, NULL, {X0.format('avg(a)', 'avg(z)')} FROM st GROUP BY seq "
    f"UNION ALL SELECT 'ALL', seq, pos, {X0.format('a', 'z')} FROM st UNION ALL SELECT 'STEP', seq, pos, {X0.format('a', 'z')} FROM st WHERE token = 3",
)


# --- shares of log-probabilities, oversampling, arrivals
def shares(s, d):
    best = R.top(S.softmax(logits(s, d)), 20, [F.desc("logit"), F.col("token")], ["row"])
    pick = lambda t: F.max(F.when(F.col("token") == t, F.col("logp")))
    return best.groupBy("row").agg(pick(3).alias("h"), pick(5).alias("e"), F.min("logp").alias("low")).select("row", r6(D.tag_share(F.col("h"), F.col("e"), F.col("low")), "share"))


register(
    "MTH-5",
    shares,
    sql("+z AS (SELECT *, logit - max(logit) OVER (PARTITION BY row) AS sh FROM logits), sm AS (SELECT row, token, logit, sh - ln(sum(exp(sh)) OVER (PARTITION BY row)) AS logp FROM z), bs AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY row ORDER BY logit DESC, token) <= 20), pr AS (SELECT row, min(logp) AS low, coalesce(max(logp) FILTER (token = 3), min(logp)) AS h, coalesce(max(logp) FILTER (token = 5), min(logp)) AS e FROM bs GROUP BY row) SELECT row, round(CASE WHEN h + e = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, h / (h + e))) END, 6) + 0.0 AS share FROM pr"),
)
register(
    "SMP-1",
    lambda s, d: D.oversampled(table(s, d, "supplier").select("s_suppkey"), 3000, "s_suppkey", seed=3),
    f"WITH n AS (SELECT count(*) AS n FROM supplier), own AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier), dr AS (SELECT id AS draw, least(floor({uniform(chr(39) + '3' + chr(39), 'id')} * n), n - 1)::BIGINT AS row FROM n, range(3000) t(id) WHERE id < 3000 - n) SELECT s_suppkey, NULL::BIGINT AS draw FROM own UNION ALL SELECT s_suppkey, draw FROM dr JOIN own USING (row)",
)
U9 = lambda *parts: uniform("'9'", *parts, "id")
register(
    "SMP-3",
    lambda s, d: D.gamma_gaps(s.range(1000), "id", 10.0, 1.5, 9).select("id", r6("gap", "gap")),
    f"WITH t AS (SELECT id, list_filter(list_transform(range(1, 65), lambda i: {{'x': pow({U9(chr(39) + 'x' + chr(39), 'i')}, 2.0), 'y': pow({U9(chr(39) + 'y' + chr(39), 'i')}, 2.0)}}), lambda p: p.x + p.y <= 1)[1] AS g FROM range(1000) r(id)) SELECT id, round((-ln({U9(chr(39) + 'e' + chr(39), '0')}) - ln({U9(chr(39) + 'w' + chr(39))}) * g.x / (g.x + g.y)) / 15.0::DOUBLE, 6) + 0.0 AS gap FROM t",
)


# --- pairs: one query against all, and rows by position
def pairs(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "embedding")
    one = R.paired(rows.filter("vec_id = 0").select(F.col("embedding").alias("query")), rows, "vec_id", "vec_id")
    back = rows.select((-F.col("vec_id")).alias("place"), F.col("embedding").alias("query"))
    many = R.paired(back, rows, "place", "vec_id")
    return one.select(F.lit("1:N").alias("kind"), "vec_id", r6(S.cosine(F.col("query"), F.col("embedding")), "score")).unionByName(many.select(F.lit("N:N").alias("kind"), "vec_id", r6(S.cosine(F.col("query"), F.col("embedding")), "score")))


COS = "round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) + 0.0 AS score"
register(
    "JOIN-6",
    pairs,
    f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER (ORDER BY vec_id) AS up, row_number() OVER (ORDER BY vec_id DESC) AS down FROM embeddings) SELECT '1:N' AS kind, a.vec_id, {COS} FROM e a JOIN e b ON b.vec_id = 0 UNION ALL SELECT 'N:N', a.vec_id, {COS} FROM e a JOIN e b ON b.down = a.up",
)
