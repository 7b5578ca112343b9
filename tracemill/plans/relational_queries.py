"""Queries of row operators, joins, set operations, sorts and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import aggregates as A
from tracemill.operators import relational as R
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import logits, predictions, probes, requests, responses, sql, table, tokens


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name) if name else F.round(c, 6) + F.lit(0.0)


def t(name):
    return lambda s, d: table(s, d, name)


orders, customer, part, nation, region, supplier, lineitem, documents, conversations = map(t, ("orders", "customer", "part", "nation", "region", "supplier", "lineitem", "documents", "conversations"))

# --- projection
register("PRJ-1", lambda s, d: customer(s, d).select("c_custkey", "c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer")
register("PRJ-2", lambda s, d: (lambda x: R.numbered(x[0].withColumn("k", F.col("p_partkey")), "k").join(R.numbered(x[1], "p_partkey"), "row").select("row", "k", "p_name"))((part(s, d).select("p_partkey"), R.pop(part(s, d), "p_brand", "p_type")[1])), "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_partkey AS k, p_name FROM part")
register("PRJ-3", lambda s, d: R.rename(nation(s, d), ["n_nationkey", "n_name"], ["key", "name"]).select("key", "name"), "SELECT n_nationkey AS key, n_name AS name FROM nation")
register(
    "PRJ-4",
    lambda s, d: R.numbered(documents(s, d), "doc_id").select(F.lit("docs").alias("data_source"), F.concat(F.lit("user: "), F.col("text")).alias("prompt"), F.lit("rule").alias("style"), F.col("doc_id").cast("string").alias("ground_truth"), F.lit("train").alias("split"), F.col("row").alias("index")),
    "SELECT 'docs' AS data_source, 'user: ' || text AS prompt, 'rule' AS style, doc_id::VARCHAR AS ground_truth, 'train' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents",
)
register("PRJ-5", lambda s, d: supplier(s, d).select(F.col("s_suppkey"), F.col("s_acctbal").alias("balance_thinking")), "SELECT s_suppkey, s_acctbal AS balance_thinking FROM supplier")
register("PRJ-6", lambda s, d: probes(s, d).select("qid", "step", F.concat_ws(",", F.coalesce(F.when(F.col("valid"), F.col("k")), F.lit(0)).cast("string"), F.coalesce("k", F.lit(0)).cast("string")).alias("vector")), sql("SELECT qid, step, (CASE WHEN valid THEN k ELSE 0 END) || ',' || k AS vector FROM probes"))
# --- filters
register("FLT-1", lambda s, d: R.numbered(customer(s, d), "c_custkey").filter("row >= 100 and row < 400 and row % 3 = 0").select("row", "c_custkey"), "SELECT row, c_custkey FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, c_custkey FROM customer) WHERE row >= 100 AND row < 400 AND row % 3 = 0")
register("FLT-2", lambda s, d: documents(s, d).filter(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")) <= 200).select("doc_id"), r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) <= 200")
register("FLT-3", lambda s, d: responses(s, d).withColumn("p", F.col("rid") * 3).filter("p >= 4 and len >= 4 and p <= 1024 and p + len <= 2048").select("uid", "rid"), sql("SELECT uid, rid FROM responses WHERE rid * 3 >= 4 AND len >= 4 AND rid * 3 <= 1024 AND rid * 3 + len <= 2048"))
register("FLT-4", lambda s, d: conversations(s, d).groupBy("conv_id").agg(F.count("*").alias("turns")).filter("turns >= 2"), "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
register("FLT-5", lambda s, d: orders(s, d).filter("o_orderstatus = 'F' and o_totalprice > 0").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0")
register("FLT-7", lambda s, d: documents(s, d).filter(F.length("text") > 0).filter(F.col("lang").isNotNull()).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE length(text) > 0 AND lang IS NOT NULL")
# --- joins
register("JOIN-1", lambda s, d: orders(s, d).join(customer(s, d), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
register("JOIN-2", lambda s, d: customer(s, d).join(orders(s, d).groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order")), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "last_order"), "SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
register("JOIN-3", lambda s, d: R.zip_join(R.numbered(part(s, d).select("p_partkey", "p_name"), "p_partkey"), R.numbered(part(s, d).select("p_partkey", "p_size"), "p_partkey")).select("row", "p_partkey", "p_name", "p_size"), "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_partkey, p_name, p_size FROM part")
register("JOIN-4", lambda s, d: R.overwrite(customer(s, d).select("c_custkey", "c_acctbal"), orders(s, d).filter("o_orderkey % 10 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")), "c_custkey", "c_acctbal"), "SELECT c_custkey, coalesce(n, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders WHERE o_orderkey % 10 = 0 GROUP BY o_custkey) ON o_custkey = c_custkey")
register("JOIN-5", lambda s, d: customer(s, d).join(orders(s, d), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
register("JOIN-7", lambda s, d: documents(s, d).select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("k", "prefix")).select("doc_id", F.col("k").cast("long").alias("k"), F.length("prefix").cast("long").alias("chars")), "SELECT doc_id, k, length(p[k + 1]) AS chars FROM (SELECT doc_id, string_split(text, '. ') AS p, unnest(range(0, len(string_split(text, '. ')))) AS k FROM documents)")
# --- sets and shapes
register("SET-1", lambda s, d: customer(s, d).select(F.col("c_custkey").alias("k")).unionByName(supplier(s, d).select(F.col("s_suppkey").alias("k"))), "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
register("SET-2", lambda s, d: (lambda x, n: R.chunks(R.numbered(x, "n_nationkey"), 5, n).select("n_nationkey", "chunk"))(*(lambda x: (x, x.count()))(nation(s, d))), "SELECT n_nationkey, ((row_number() OVER (ORDER BY n_nationkey) - 1) // 5)::BIGINT AS chunk FROM nation")
register("SET-3", lambda s, d: R.repeat(R.numbered(nation(s, d), "n_nationkey"), 3, 25, False).select("row", "n_nationkey"), "SELECT c * 25 + row_number() OVER (PARTITION BY c ORDER BY n_nationkey) - 1 AS row, n_nationkey FROM nation, range(3) r(c)")
register("SET-4", lambda s, d: R.pad_to_divisor(R.numbered(region(s, d), "r_regionkey"), 8, 5).select("row", "r_name"), "SELECT row, r_name FROM (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS row, r_name FROM region) UNION ALL SELECT row + 5, r_name FROM (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS row, r_name FROM region) WHERE row < 3")
register("SET-5", lambda s, d: tokens(s, d).groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("reward").cast("decimal(4,2)").cast("string").alias("r")))), lambda x: x["r"]), "|").alias("rewards")), sql("SELECT seq, string_agg(reward::DECIMAL(4,2)::VARCHAR, '|' ORDER BY pos) AS rewards FROM tokens GROUP BY seq"))
register(
    "SET-6",
    lambda s, d: R.transposed(responses(s, d).withColumn("score", F.col("score").cast("decimal(4,2)")), "uid", "rid", "score", 4096).select("rid", "block", F.array_join("values", "|").alias("scores")),
    sql("SELECT rid, uid // 4096 AS block, string_agg(score::DECIMAL(4,2)::VARCHAR, '|' ORDER BY uid) AS scores FROM responses GROUP BY ALL"),
)
register("SET-7", lambda s, d: supplier(s, d).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.concat_ws("_", "s_suppkey", "j").alias("_id"), "s_name"), "SELECT s_suppkey || '_' || j AS _id, s_name FROM supplier, range(4) r(j)")
def ids():
    return F.transform(F.split("p_name", " "), lambda w: F.length(w).cast("long"))


register("SET-8", lambda s, d: part(s, d).select("p_partkey", F.array_join(R.padded(ids(), 4, 0), ",").alias("right_ids"), F.array_join(R.padded(ids(), 4, 0, left=True), ",").alias("left_ids")), "SELECT p_partkey, array_to_string((i || [0, 0, 0, 0])[1:4], ',') AS right_ids, array_to_string(list_reverse((list_reverse(i) || [0, 0, 0, 0])[1:4]), ',') AS left_ids FROM (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: length(w)) AS i FROM part)")
register("SET-9", lambda s, d: tokens(s, d).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "mask"))).alias("t")).select("seq", F.array_join(F.transform(F.filter("t", lambda x: x["mask"]), lambda x: x["pos"]), ",").alias("kept")), sql("SELECT seq, coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (mask), '') AS kept FROM tokens GROUP BY seq"))
register("SET-10", lambda s, d: documents(s, d).select("lang", "source").distinct(), "SELECT DISTINCT lang, source FROM documents")
# --- sorts and limits
register("SRT-1", lambda s, d: R.numbered(probes(s, d), "qid", "step", "event_id").select("row", "qid", "step"), sql("SELECT row_number() OVER (ORDER BY qid, step, event_id) - 1 AS row, qid, step FROM probes"))
register("SRT-2", lambda s, d: R.top(logits(s, d), 64, [F.when(F.col("token") % 2 == 0, F.col("token")).asc_nulls_last(), F.desc("logit"), F.col("token")], ["row"]).select("row", "token", "rank"), sql("SELECT row, token, row_number() OVER (PARTITION BY row ORDER BY CASE WHEN token % 2 = 0 THEN token END NULLS LAST, logit DESC, token) AS rank FROM logits"))
register("SRT-3", lambda s, d: orders(s, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
register("SRT-4", lambda s, d: R.top(logits(s, d), 20, [F.desc("logit"), F.col("token")], ["row"]).withColumn("as_good", F.count("*").over(Window.partitionBy("row").orderBy(F.desc("logit")).rangeBetween(Window.unboundedPreceding, 0))).select("row", "token", "rank", "as_good"), sql("SELECT row, token, rank, count(*) OVER (PARTITION BY row ORDER BY logit DESC RANGE UNBOUNDED PRECEDING) AS as_good FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY logit DESC, token) AS rank FROM logits) WHERE rank <= 20"))
register("SRT-5", lambda s, d: R.top(responses(s, d), 2, [F.desc("score"), F.col("rid")], ["uid"]).select("uid", "rid", "rank"), sql("SELECT uid, rid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, rid) AS rank FROM responses QUALIFY rank <= 2"))
register("SRT-6", lambda s, d: documents(s, d).orderBy(F.md5(F.concat_ws(":", F.lit("7"), "doc_id")), "doc_id").limit(100).select("doc_id"), "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
register("SRT-7", lambda s, d: R.reorder(R.numbered(nation(s, d), "n_nationkey"), s.range(25).select(F.col("id").alias("old"), ((F.col("id") * 7) % 25).alias("new"))).select("row", "n_name"), "SELECT ((row_number() OVER (ORDER BY n_nationkey) - 1) * 7) % 25 AS row, n_name FROM nation")
# --- aggregates
register("AGG-1", lambda s, d: predictions(s, d).agg(r6(F.avg(((F.col("p") >= 0.5).cast("long") == F.col("y")).cast("double")), "accuracy")), sql("SELECT round(avg(((p >= 0.5)::BIGINT = y)::INT), 6) + 0.0 AS accuracy FROM predictions"))
register("AGG-2", lambda s, d: orders(s, d).agg(r6(F.avg(F.expr("try_cast(substr(o_orderpriority, 1, 1) as double)")), "mean")), "SELECT round(avg(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE)), 6) + 0.0 AS mean FROM orders")
register(
    "AGG-5",
    lambda s, d: A.step_metrics(predictions(s, d), F.col("y"), (F.col("p") >= 0.5).cast("long")).select(*[r6(c, c) for c in ("accuracy", "precision", "recall", "f1", "positive_rate")]),
    sql("+c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (p >= 0.5)::DOUBLE AS sd, count(*) FILTER (y = 1)::DOUBLE AS tr, count(*) FILTER ((y = 1) = (p >= 0.5))::DOUBLE AS ok FROM predictions) SELECT round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(sd, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tr, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(sd + tr, 0), 0), 6) AS f1, round(sd / n, 6) AS positive_rate FROM c"),
)
register(
    "AGG-6",
    lambda s, d: A.problem_rollup(responses(s, d), 40.0).select("problem", "responses", r6("acc", "acc"), r6("length", "length"), r6("clipped", "clipped")),
    sql("+per AS (SELECT uid::VARCHAR AS problem, count(*) AS responses, avg(score) AS acc, avg(len) AS length, avg((len >= 40)::INT) AS clipped FROM responses GROUP BY uid) SELECT problem, responses, round(acc, 6) + 0.0 AS acc, round(length, 6) AS length, round(clipped, 6) AS clipped FROM per UNION ALL SELECT '__OVERALL__', sum(responses)::BIGINT, round(avg(acc), 6) + 0.0, round(avg(length), 6), round(avg(clipped), 6) FROM per"),
)
register(
    "AGG-7",
    lambda s, d: responses(s, d).withColumn("source", F.col("uid") % 4).groupBy("source", "uid").agg(F.count("*").alias("n"), F.avg("score").alias("m")).groupBy("source", F.concat(F.lit("mean@"), F.col("n")).alias("metric")).agg(r6(F.avg("m"), "value")),
    sql("SELECT source, 'mean@' || n AS metric, round(avg(m), 6) + 0.0 AS value FROM (SELECT uid % 4 AS source, uid, count(*) AS n, avg(score) AS m FROM responses GROUP BY ALL) GROUP BY ALL"),
)
register("AGG-8", lambda s, d: responses(s, d).groupBy((F.col("uid") % 4).alias("source"), "rid").agg(F.count("*").alias("n")).select(F.concat_ws("/", F.lit("val-aux"), F.col("source"), F.concat(F.lit("mean@"), F.col("rid"))).alias("key"), "n"), sql("SELECT 'val-aux/' || (uid % 4) || '/mean@' || rid AS key, count(*) AS n FROM responses GROUP BY ALL"))
register("AGG-9", lambda s, d: responses(s, d).groupBy("uid").agg(F.avg("score").alias("m")).groupBy((F.col("uid") % 3).alias("source")).agg(r6(F.avg("m"), "value")), sql("SELECT uid % 3 AS source, round(avg(m), 6) + 0.0 AS value FROM (SELECT uid, avg(score) AS m FROM responses GROUP BY uid) GROUP BY ALL"))
HASHED = "('0x' || substr(md5({}), 1, 8))::BIGINT"
TIMES = " ".join(f"WHEN u >= {edge!r}::DOUBLE THEN {k}" for k, edge in reversed(A.poisson_edges()))
register(
    "AGG-10",
    lambda s, d: A.bootstrap(orders(s, d), "o_totalprice", "o_orderkey", 1000).select(F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std")),
    f"WITH u AS (SELECT r, o_totalprice AS x, ({HASHED.format("'42:' || r || ':' || o_orderkey")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM orders, range(1, 1001) t(r)), n AS (SELECT r, x, CASE {TIMES} ELSE 0 END AS n FROM u), m AS (SELECT r, sum(x * n) / sum(n) AS m FROM n GROUP BY r) SELECT round(avg(m), 3) AS mean, round(stddev_pop(m), 3) AS std FROM m",
)
register("AGG-11", lambda s, d: A.majority(responses(s, d), "uid", "score", "rid", "len"), sql("+v AS (SELECT uid, score, count(*) AS n, min(rid) AS f, arg_min(len, rid) AS value FROM responses GROUP BY ALL) SELECT uid, score AS vote, n AS votes, value FROM v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) = 1"))
register("AGG-12", lambda s, d: A.deduplicate_features(predictions(s, d).withColumn("p", F.col("p") * 0.37 + 0.00131), ["p"], "y", "id", 2), sql("SELECT p, n, CASE WHEN 2 * ones > n THEN 1 WHEN 2 * ones < n THEN 0 ELSE fl END::BIGINT AS label, ones > 0 AND ones < n AS clash, first_row FROM (SELECT round(p * 0.37::DOUBLE + 0.00131::DOUBLE, 2) AS p, count(*) AS n, sum(y) AS ones, arg_min(y, id) AS fl, min(id) AS first_row FROM predictions GROUP BY 1)"))
register(
    "AGG-13",
    lambda s, d: tokens(s, d).filter("mask").agg(r6(F.avg("reward"), "reward_mean"), r6(F.max("reward"), "reward_max"), r6(F.min("reward"), "reward_min"), r6(F.avg("value"), "value_mean"), r6(1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5), "explained_var")),
    sql("SELECT round(avg(reward), 6) + 0.0 AS reward_mean, round(max(reward), 6) + 0.0 AS reward_max, round(min(reward + 0.0), 6) + 0.0 AS reward_min, round(avg(value), 6) + 0.0 AS value_mean, round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) + 0.0 AS explained_var FROM tokens WHERE mask"),
)
register("AGG-14", lambda s, d: requests(s, d).agg(r6(F.sum("n") / (F.max("last") - F.min("arrival")) / 8, "tokens_per_gpu_second")), sql("SELECT round(sum(n) / (max(\"last\") - min(arrival)) / 8, 6) + 0.0 AS tokens_per_gpu_second FROM requests"))
register("AGG-15", lambda s, d: table(s, d, "events").groupBy("event_type").agg(r6(F.avg("value"), "value")), "SELECT event_type, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY ALL")
B = A.buckets_1_2_5(1000)
register("AGG-19", lambda s, d: A.histogram(table(s, d, "events"), "value", B).select("le", "n", "count"), f"SELECT b::DOUBLE AS le, (SELECT count(*) FROM events WHERE value <= b) AS n, (SELECT count(value) FROM events) AS count FROM (SELECT unnest({B}) AS b)")
register("AGG-27", lambda s, d: A.histogram(table(s, d, "events"), "value", B, ["event_type"]).select("event_type", "le", "n", "count", r6("total", "total")), f"SELECT event_type, b::DOUBLE AS le, count(*) FILTER (value <= b) AS n, count(value) AS count, round(sum(value), 6) AS total FROM events, (SELECT unnest({B}) AS b) GROUP BY ALL")
register("AGG-20", lambda s, d: requests(s, d).select("rid", *[r6(x, n) for n, x in {"e2e": F.col("last") - F.col("arrival"), "queue_time": F.col("queued") - F.col("arrival"), "prefill": F.col("first") - F.col("queued"), "decode": F.col("last") - F.col("first"), "inference": F.col("last") - F.col("queued")}.items()]), sql('SELECT rid, round("last" - arrival, 6) AS e2e, round(queued - arrival, 6) AS queue_time, round("first" - queued, 6) AS prefill, round("last" - "first", 6) AS decode, round("last" - queued, 6) AS inference FROM requests'))


def timings():
    return {"ttft": F.col("first") - F.col("arrival"), "tpot": F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(0.0)}


register(
    "AGG-16",
    lambda s, d: requests(s, d).agg(*[f for n, x in timings().items() for f in (F.round(F.avg(x), 4).alias(f"{n}_mean"), F.round(F.stddev_pop(x), 4).alias(f"{n}_std"), F.round(F.percentile(x, F.lit(0.5)), 4).alias(f"{n}_median"), F.round(F.percentile(x, F.lit(0.99)), 4).alias(f"{n}_p99"))]),
    sql("+m AS (SELECT \"first\" - arrival AS ttft, CASE WHEN n > 1 THEN (\"last\" - \"first\") / (n - 1) ELSE 0 END AS tpot FROM requests) SELECT " + ", ".join(f"round(avg({n}), 4) AS {n}_mean, round(stddev_pop({n}), 4) AS {n}_std, round(quantile_cont({n}, 0.5), 4) AS {n}_median, round(quantile_cont({n}, 0.99), 4) AS {n}_p99" for n in ("ttft", "tpot")) + " FROM m"),
)
PCT = (10, 25, 50, 75, 90, 99)
register("AGG-17", lambda s, d: table(s, d, "events").agg(*[r6(F.percentile("value", F.lit(p / 100)), f"p{p}") for p in PCT]), "SELECT " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) + 0.0 AS p{p}" for p in PCT) + " FROM events")
register("AGG-18", lambda s, d: requests(s, d).agg(F.sum(((timings()["ttft"] <= 100000.0) & (timings()["tpot"] <= 40000.0)).cast("long")).alias("good")), sql("SELECT count(*) FILTER (\"first\" - arrival <= 100000.0 AND CASE WHEN n > 1 THEN (\"last\" - \"first\") / (n - 1) ELSE 0 END <= 40000.0) AS good FROM requests"))
register(
    "AGG-21",
    lambda s, d: responses(s, d).agg(r6(F.sum(F.col("len") % 5) / F.sum(F.lit(4)), "acceptance_rate"), r6(1 + F.sum(F.col("len") % 5) / F.count("*"), "mean_length"), *[r6(F.avg((F.col("len") % 5 >= i).cast("double")), f"at{i}") for i in (1, 2, 3, 4)]),
    sql("SELECT round(sum(len % 5) / sum(4), 6) AS acceptance_rate, round(1 + sum(len % 5) / count(*), 6) AS mean_length, " + ", ".join(f"round(avg((len % 5 >= {i})::INT), 6) AS at{i}" for i in (1, 2, 3, 4)) + " FROM responses"),
)
register("AGG-25", lambda s, d: lineitem(s, d).groupBy(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("long").alias("token")).agg(F.count("*").alias("n")), "SELECT l_orderkey AS seq, l_linenumber::BIGINT AS token, count(*) AS n FROM lineitem GROUP BY ALL")
register("AGG-26", lambda s, d: probes(s, d).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "answer"))), lambda x: x["answer"]), ",").alias("answers")), sql("SELECT qid, string_agg(answer, ',' ORDER BY step) AS answers FROM probes GROUP BY qid"))
register("AGG-28", lambda s, d: lineitem(s, d).agg(r6(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))), "acc"), r6(F.avg("l_quantity"), "response_length"), r6(F.avg("l_tax"), "reward")), "SELECT round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS acc, round(avg(l_quantity), 6) AS response_length, round(avg(l_tax), 6) AS reward FROM lineitem")
register("AGG-29", lambda s, d: requests(s, d).agg(r6(F.sum("n") / (F.max("last") - F.min("arrival")), "tokens_per_second"), r6(F.avg("n"), "mean_tokens")), sql("SELECT round(sum(n) / (max(\"last\") - min(arrival)), 6) AS tokens_per_second, round(avg(n), 6) AS mean_tokens FROM requests"))
