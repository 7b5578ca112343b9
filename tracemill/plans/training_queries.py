"""Queries of advantages, losses, token distributions, prefixes, pooling and dataset preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import advantages as V
from tracemill.operators import relational as R
from tracemill.operators import sampling as S
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import logits, probes, responses, sql, table, tokens
from tracemill.session import ship


def r6(c, name):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def r10(c, name):
    return (F.round(F.col(c), 10) + F.lit(0.0)).alias(name)


# --- advantages
DELTA = "+del AS (SELECT *, reward + 0.93::DOUBLE * coalesce(lead(value) OVER (PARTITION BY seq ORDER BY pos), 0.0) - value AS delta FROM tokens), adv AS (SELECT a.seq, a.pos, any_value(a.value) AS value, any_value(a.mask) AS mask, sum(b.delta * pow(0.93::DOUBLE * 0.97::DOUBLE, b.pos - a.pos)) AS adv FROM del a JOIN del b ON a.seq = b.seq AND b.pos >= a.pos GROUP BY a.seq, a.pos)"
register("ADV-1", lambda s, d: V.gae(tokens(s, d), 0.93, 0.97).select("seq", "pos", r6("adv", "adv"), r10("returns", "returns")), sql(DELTA + ", st AS (SELECT avg(adv) AS m, var_samp(adv) AS v FROM adv WHERE mask) SELECT seq, pos, round(CASE WHEN mask THEN (adv - m) / sqrt(v + 1e-8) ELSE 0 END, 6) + 0.0 AS adv, round(adv + value, 10) + 0.0 AS returns FROM adv, st"))
register("AGG-23", lambda s, d: V.whiten(tokens(s, d), "reward").select("seq", "pos", r6("reward", "white")), sql("+st AS (SELECT avg(reward) AS m, var_samp(reward) AS v FROM tokens WHERE mask) SELECT seq, pos, round(CASE WHEN mask THEN (reward - m) / sqrt(v + 1e-8) ELSE 0 END, 6) + 0.0 AS white FROM tokens, st"))
GROUP = "count(*) OVER (PARTITION BY uid)"
register("ADV-2", lambda s, d: V.grpo(responses(s, d)).select("uid", "rid", F.round("adv", 4).alias("adv") + F.lit(0.0)).toDF("uid", "rid", "adv"), sql(f"SELECT uid, rid, round(CASE WHEN {GROUP} = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER (PARTITION BY uid)) / (stddev_samp(score) OVER (PARTITION BY uid) + 1e-6) END, 4) + 0.0 AS adv FROM responses"))
register("WIN-20", lambda s, d: V.grpo(responses(s, d)).groupBy("uid").agg(r6(F.avg("adv"), "mean_adv"), F.count("*").alias("n")).filter("n > 1").select("uid", F.abs("mean_adv").alias("mean_adv")), sql(f"SELECT uid, 0.0::DOUBLE AS mean_adv FROM responses GROUP BY uid HAVING count(*) > 1"))



def baseline_tokens(s, d):
    scores = responses(s, d)
    places = scores.select("uid", "rid", "len", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pos"))
    return V.baseline_tokens(places.withColumn("mask", F.col("pos") <= F.col("len") % 3 + 1), scores).select("uid", "rid", F.col("pos").cast("long").alias("pos"), r6("adv", "adv"))


register(
    "ADV-3",
    baseline_tokens,
    sql(f"+b AS (SELECT uid, rid, len, score - CASE WHEN {GROUP} = 1 THEN 0 ELSE avg(score) OVER (PARTITION BY uid) END AS adv FROM responses), t AS (SELECT uid, rid, pos, adv, pos <= len % 3 + 1 AS mask FROM b, range(1, 4) r(pos)), st AS (SELECT avg(adv) AS m, var_samp(adv) AS v FROM t WHERE mask) SELECT uid, rid, pos, round(CASE WHEN mask THEN (adv - m) / sqrt(v + 1e-8) ELSE 0 END, 6) + 0.0 AS adv FROM t, st"),
)
register("ADV-4", lambda s, d: V.rloo(responses(s, d)).select("uid", "rid", r6("adv", "adv")), sql(f"SELECT uid, rid, round(CASE WHEN {GROUP} > 1 THEN (score - avg(score) OVER (PARTITION BY uid)) * {GROUP} / ({GROUP} - 1) ELSE score END, 6) + 0.0 AS adv FROM responses"))
DISCOUNTED = "+z AS (SELECT *, sum((NOT mask)::INT) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM tokens), ret AS (SELECT a.seq, a.pos, any_value(a.mask) AS mask, CASE WHEN any_value(a.mask) THEN sum(b.reward * pow(0.93::DOUBLE, b.pos - a.pos)) FILTER (b.mask AND b.part = a.part) ELSE 0 END AS returns FROM z a JOIN z b ON a.seq = b.seq AND b.pos >= a.pos GROUP BY a.seq, a.pos), st AS (SELECT avg(returns) AS m, var_samp(returns) AS v FROM ret WHERE mask)"
register("ADV-5", lambda s, d: V.discounted(tokens(s, d), 0.93).select("seq", "pos", r10("returns", "returns"), r6("adv", "adv")), sql(f"{DISCOUNTED} SELECT seq, pos, round(returns, 10) + 0.0 AS returns, round(CASE WHEN mask THEN (returns - m) / sqrt(v + 1e-8) ELSE 0 END, 6) + 0.0 AS adv FROM ret, st"))
register("ADV-6", lambda s, d: V.remax(tokens(s, d), F.col("value")).select("seq", "pos", r6("adv", "adv")), sql("SELECT seq, pos, round(sum(reward) OVER (PARTITION BY seq ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) - CASE WHEN mask THEN value ELSE 0 END, 6) + 0.0 AS adv FROM tokens"))
register("ADV-7", lambda s, d: tokens(s, d).select("seq", "pos", F.when(F.col("mask"), F.first("reward").over(Window.partitionBy("seq").orderBy("pos"))).otherwise(0.0).alias("adv")), sql("SELECT seq, pos, CASE WHEN mask THEN first_value(reward) OVER (PARTITION BY seq ORDER BY pos) ELSE 0.0::DOUBLE END AS adv FROM tokens"))
register(
    "KL-1",
    lambda s, d: tokens(s, d).select("seq", "pos", *[r6(V.kl(k, F.col("logp"), F.col("ref")), k) for k in ("kl", "abs", "mse", "low_var_kl")]),
    sql("SELECT seq, pos, round(logp - ref, 6) + 0.0 AS kl, round(abs(logp - ref), 6) AS abs, round(0.5 * (logp - ref) * (logp - ref), 6) AS mse, round(least(greatest(exp(ref - logp) - (ref - logp) - 1, -10.0), 10.0), 6) + 0.0 AS low_var_kl FROM tokens"),
)
register("KL-2", lambda s, d: tokens(s, d).select("seq", "pos", r6(F.col("reward") - 0.1 * V.kl("kl", F.col("logp"), F.col("ref")) * F.col("mask").cast("double"), "reward")), sql("SELECT seq, pos, round(reward - 0.1::DOUBLE * (logp - ref) * mask::INT, 6) + 0.0 AS reward FROM tokens"))



def controlled(s, d):
    """The penalty's coefficient after ten batches, each steered by its mean estimate."""
    each = tokens(s, d).filter("mask").groupBy((F.col("seq") % 10).alias("batch")).agg(F.avg(V.kl("kl", F.col("logp"), F.col("ref"))).alias("now"))
    return each.groupBy().agg(F.array_sort(F.collect_list(F.struct("batch", "now"))).alias("b")).select(r6(V.steered(F.col("b.now"), 0.1, -0.2, 60, 1000.0), "coefficient"))


register("KL-2-controller", controlled, sql("+e AS (SELECT seq % 10 AS batch, avg(logp - ref) AS now FROM tokens WHERE mask GROUP BY 1), l AS (SELECT list(now ORDER BY batch) AS b FROM e) SELECT round(list_reduce([0.1::DOUBLE] || b, lambda c, x: c * (1 + greatest(-0.2::DOUBLE, least(x / (-0.2::DOUBLE) - 1, 0.2::DOUBLE)) * 60 / 1000.0::DOUBLE)), 6) + 0.0 AS coefficient FROM l"))
RATIO = "exp(logp - ref)"
PG = f"+tm AS (SELECT *, reward - value AS a, -(reward - value) * {RATIO} AS pl, -(reward - value) * least(greatest({RATIO}, 0.8::DOUBLE), 1.2::DOUBLE) AS bd, -(reward - value) * 3 AS lo FROM tokens WHERE mask), pg AS (SELECT *, greatest(pl, bd) AS tp FROM tm)"
register(
    "LOS-1",
    lambda s, d: V.ppo_terms(tokens(s, d).withColumn("adv", F.col("reward") - F.col("value")), "adv", 0.2, 3.0).filter("mask").agg(r6(F.avg("pg"), "loss"), r6(F.avg("clipped"), "clipped"), r6(F.avg("clipped_low"), "clipped_low")),
    sql(PG + " SELECT round(avg(CASE WHEN a < 0 THEN least(lo, tp) ELSE tp END), 6) + 0.0 AS loss, round(avg((bd > pl)::INT), 6) AS clipped, round(avg((tp > lo AND a < 0)::INT), 6) AS clipped_low FROM pg"),
)



def losses(s, d):
    value = V.value_loss(tokens(s, d).withColumn("returns", F.col("reward")), F.col("value") * 2, 0.03).filter("mask").agg(r6(F.avg("vf"), "loss"))
    entropy = V.entropy_loss(logits(s, d).withColumn("mask", F.col("row") % 3 != 0)).select(r6("loss", "loss"))
    return value.select(F.lit("value").alias("kind"), "loss").unionByName(entropy.select(F.lit("entropy").alias("kind"), "loss"))


register(
    "LOS-2",
    losses,
    sql("+z AS (SELECT *, logit - max(logit) OVER (PARTITION BY row) AS sh FROM logits WHERE row % 3 <> 0), sm AS (SELECT row, sh - ln(sum(exp(sh)) OVER (PARTITION BY row)) AS logp FROM z), h AS (SELECT row, -sum(exp(logp) * logp) AS h FROM sm GROUP BY row) SELECT 'value' AS kind, round(avg(0.5 * greatest(pow(2 * value - reward, 2), pow(least(greatest(2 * value, value - 0.03::DOUBLE), value + 0.03::DOUBLE) - reward, 2))), 6) AS loss FROM tokens WHERE mask UNION ALL SELECT 'entropy', round(avg(h), 6) FROM h"),
)
register("AGG-24", lambda s, d: V.aggregate_loss(tokens(s, d), "reward", "token-mean").select(F.lit("token-mean").alias("mode"), r6("loss", "loss")).unionByName(V.aggregate_loss(tokens(s, d), "reward", "seq-mean-token-sum").select(F.lit("seq-mean-token-sum").alias("mode"), r6("loss", "loss"))).unionByName(V.aggregate_loss(tokens(s, d), "reward", "seq-mean-token-mean").select(F.lit("seq-mean-token-mean").alias("mode"), r6("loss", "loss"))), sql("+x AS (SELECT seq, sum(reward) AS s, avg(reward) AS a FROM tokens WHERE mask GROUP BY seq) SELECT 'token-mean' AS mode, round(avg(reward), 6) AS loss FROM tokens WHERE mask UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM x UNION ALL SELECT 'seq-mean-token-mean', round(avg(a), 6) FROM x"))
# --- masks and places


def stop():
    return (F.col("pos") % 4 == 0).cast("int")


register("WIN-18", lambda s, d: tokens(s, d).select("seq", "pos", (F.sum(stop()).over(Window.partitionBy("seq").orderBy("pos")) - stop() == 0).cast("long").alias("mask")), sql("SELECT seq, pos, (sum((pos % 4 = 0)::INT) OVER (PARTITION BY seq ORDER BY pos) - (pos % 4 = 0)::INT = 0)::BIGINT AS mask FROM tokens"))
register("WIN-19", lambda s, d: tokens(s, d).select("seq", "pos", F.greatest(F.sum(F.col("mask").cast("long")).over(Window.partitionBy("seq").orderBy("pos")) - 1, F.lit(0)).alias("position")), sql("SELECT seq, pos, greatest(sum(mask::BIGINT) OVER (PARTITION BY seq ORDER BY pos) - 1, 0)::BIGINT AS position FROM tokens"))


def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


register("WIN-21", lambda s, d: table(s, d, "events").select("user_id", "event_id", (micros() - F.lag(micros()).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap_us")), "SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
register("RWD-12", lambda s, d: tokens(s, d).select("seq", "pos", F.when(F.col("pos") == F.max("pos").over(Window.partitionBy("seq")), F.col("reward")).otherwise(0.0).alias("reward")), sql("SELECT seq, pos, CASE WHEN pos = max(pos) OVER (PARTITION BY seq) THEN reward ELSE 0.0 END AS reward FROM tokens"))
register("RWD-13", lambda s, d: responses(s, d).select("uid", "rid", r6(F.least(-(F.col("len") - 30.0) / 10.0 * 0.5, F.lit(0.0)), "penalty")), sql("SELECT uid, rid, round(least(-(len - 30.0) / 10.0 * 0.5, 0.0), 6)::DOUBLE + 0.0 AS penalty FROM responses"))
# --- token distributions
SOFT = "+z AS (SELECT *, logit - max(logit) OVER (PARTITION BY row) AS sh FROM logits), sm AS (SELECT *, sh - ln(sum(exp(sh)) OVER (PARTITION BY row)) AS logp FROM z)"
register("MTH-1", lambda s, d: logits(s, d).withColumn("m", F.max("logit").over(Window.partitionBy("row"))).groupBy("row").agg(r6(F.max("m") + F.log(F.sum(F.exp(F.col("logit") - F.col("m")))), "lse")), sql("+z AS (SELECT *, max(logit) OVER (PARTITION BY row) AS m FROM logits) SELECT row, round(max(m) + ln(sum(exp(logit - m))), 6) AS lse FROM z GROUP BY row"))
register("MTH-2", lambda s, d: S.softmax(logits(s, d)).select("row", "token", r6("logp", "logp"), r6("p", "p")), sql(SOFT + " SELECT row, token, round(logp, 6) + 0.0 AS logp, round(exp(logp), 6) AS p FROM sm"))
register("LGT-1", lambda s, d: S.min_p(logits(s, d), 0.8, 0.7).select("row", "token"), sql("+lt AS (SELECT row, token, logit / 0.7::DOUBLE AS logit FROM logits), z AS (SELECT *, logit - max(logit) OVER (PARTITION BY row) AS sh FROM lt) SELECT row, token FROM z WHERE exp(sh) >= 0.8"))
register("LGT-2", lambda s, d: S.top_k_top_p(logits(s, d), 20, 0.7).select("row", "token"), sql("+k AS (SELECT * FROM logits QUALIFY rank() OVER (PARTITION BY row ORDER BY logit DESC) <= 20), z AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY row) AS p FROM k), c AS (SELECT *, sum(p) OVER (PARTITION BY row ORDER BY logit, token DESC ROWS UNBOUNDED PRECEDING) AS cp, row_number() OVER (PARTITION BY row ORDER BY logit DESC, token) AS n FROM z) SELECT row, token FROM c WHERE cp > 0.3 OR n = 1"))
register("LGT-3", lambda s, d: S.penalised(logits(s, d), (F.col("token") * 7 + F.col("row")) % 3, 1.2, 0.1, 0.05).select("row", "token", r6("logit", "logit")), sql("+c AS (SELECT *, (token * 7 + row) % 3 AS n FROM logits) SELECT row, token, round(CASE WHEN n > 0 AND logit > 0 THEN logit / 1.2::DOUBLE WHEN n > 0 THEN logit * 1.2::DOUBLE ELSE logit END - 0.1::DOUBLE * n - 0.05::DOUBLE * (n > 0)::INT, 6) + 0.0 AS logit FROM c"))
register("LGT-5", lambda s, d: logits(s, d).groupBy("row").agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("token")), sql("SELECT row, token FROM logits QUALIFY row_number() OVER (PARTITION BY row ORDER BY logit DESC, token) = 1"))
register("LGT-5-random", lambda s, d: S.race(logits(s, d), 11))
register("LGT-7", lambda s, d: tokens(s, d).groupBy("seq").agg(r6(F.sum("logp"), "cumulative")), sql("SELECT seq, round(sum(logp), 6) + 0.0 AS cumulative FROM tokens GROUP BY seq"))
# --- prefixes
BLOCKS = r"""+w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), bl AS (SELECT doc_id, list_transform(range(0, len(w) // 16), lambda i: array_to_string(w[i * 16 + 1 : i * 16 + 16], ' ')) AS b FROM w)"""


def blocks(s, d):
    return table(s, d, "documents").select("doc_id", S.word_blocks(F.col("text"), 16).alias("blocks"))


register("PFX-1", lambda s, d: blocks(s, d).select("doc_id", F.size("blocks").cast("long").alias("n"), S.last_hash(F.col("blocks")).alias("hash")), sql(BLOCKS + " SELECT doc_id, len(b) AS n, list_reduce([''] || b, lambda acc, x: sha256(acc || '|' || x)) AS hash FROM bl"))
register("WIN-22", lambda s, d: S.cached_prefix(blocks(s, d), "doc_id", "blocks"), sql(BLOCKS + ", pr AS (SELECT doc_id, len(b) AS n, i, md5(array_to_string(b[1:i], '|')) AS h FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM bl)), f AS (SELECT h, min(doc_id) AS f FROM pr GROUP BY h), hit AS (SELECT doc_id, max(i) AS cached FROM pr JOIN f USING (h) WHERE f < doc_id AND i < n GROUP BY doc_id) SELECT doc_id, coalesce(cached, 0)::BIGINT AS cached FROM documents LEFT JOIN hit USING (doc_id)"))
register("SMP-2", lambda s, d: s.range(200).select(F.col("id").alias("request"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.col("id") * 13 + j) % 50257), ",").alias("ids")), "SELECT id AS request, array_to_string(list_transform(range(8), lambda j: (id * 13 + j) % 50257), ',') AS ids FROM range(200) r(id)")
# --- pooling and vectors
VECTORS = lambda s, d: table(s, d, "embeddings")
register("POOL-2", lambda s, d: VECTORS(s, d).select("vec_id", F.slice("embedding", 1, 16).alias("e")).withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).select("vec_id", F.posexplode("e").alias("dim", "x"), "n").select("vec_id", F.col("dim").cast("long").alias("dim"), r6(F.col("x").cast("double") / F.col("n"), "x")), sql("+e AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, i - 1 AS dim, round(e[i] / sqrt(list_inner_product(e, e)), 6) + 0.0 AS x FROM (SELECT vec_id, e, unnest(range(1, 17)) AS i FROM e)"))
PAIR = "SELECT a.vec_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) + 0.0 AS score FROM e a JOIN e b ON b.vec_id = {}"
DOUBLES = "+e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) "
register("VEC-1", lambda s, d: VECTORS(s, d).select("vec_id", "embedding").join(VECTORS(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", r6(S.cosine(F.col("embedding"), F.col("other")), "score")), sql(DOUBLES + PAIR.format("a.vec_id + 1")))
# --- dataset preparation
CONV = "conversations"


def n_words():
    return F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


register(
    "DSP-2",
    lambda s, d: table(s, d, CONV).withColumn("n", n_words()).withColumn("stop", F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", (F.col("stop") - F.col("n")).alias("start"), "stop", (F.col("role") == "assistant").cast("long").alias("loss")),
    r"SELECT conv_id, turn, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop, (role = 'assistant')::BIGINT AS loss FROM (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
register("DSP-1", lambda s, d: table(s, d, "part").select("p_partkey", F.size(F.split("p_name", " ")).alias("a"), F.size(F.split("p_type", " ")).alias("b")).select("p_partkey", F.array_join(R.padded(F.concat(F.array_repeat(F.lit(0), F.col("a") - 1), F.array_repeat(F.lit(1), F.col("b") + 0), F.array(F.lit(1))), 8, 0), "").alias("loss_mask")), "SELECT p_partkey, (repeat('0', (len(string_split(p_name, ' ')) - 1)::BIGINT) || repeat('1', (len(string_split(p_type, ' ')) + 1)::BIGINT) || '00000000')[1:8] AS loss_mask FROM part")
register("DSP-3", lambda s, d: R.top(responses(s, d), 1, [F.desc("score"), F.col("rid")], ["uid"]).select("uid", F.col("rid").alias("chosen")).join(R.top(responses(s, d), 1, [F.col("score"), F.desc("rid")], ["uid"]).select("uid", F.col("rid").alias("rejected")), "uid").filter("chosen <> rejected"), sql("SELECT * FROM (SELECT uid, first(rid ORDER BY score DESC, rid) AS chosen, first(rid ORDER BY score, rid DESC) AS rejected FROM responses GROUP BY uid) WHERE chosen <> rejected"))


def bal_1(s, d):
    ship(s)
    rows = responses(s, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rid", "len"))).alias("r"))
    return rows.select("uid", F.col("r.rid").alias("rids"), F.col("r.len").alias("lens")).mapInPandas(S.balance_rows, "uid long, rid long, part long")


def ngr_1(s, d):
    ship(s)
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("token"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")).alias("pos"))
    rows = rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t")).select("seq", F.col("t.token").alias("tokens"))
    return rows.mapInPandas(S.draft_rows, "seq long, draft string")


register("BAL-1", bal_1)
register("BAL-2", lambda s, d: responses(s, d).groupBy((F.col("uid") % 8).alias("part")).agg(F.sum("len").alias("total")).agg(F.min("total").alias("least"), F.max("total").alias("most"), r6(F.max("total") / F.avg("total"), "imbalance")), sql("SELECT min(t) AS least, max(t) AS most, round(max(t) / avg(t), 6) AS imbalance FROM (SELECT uid % 8 AS part, sum(len) AS t FROM responses GROUP BY ALL)"))
register("NGR-1", ngr_1)
