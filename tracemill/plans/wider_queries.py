"""Queries of sinks, file stores, dataset preparation, callables given by path, tool calls, prompts and terminal states."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import aggregates as A
from tracemill.operators import learning, preparing, rules
from tracemill.operators import trajectory as T
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import probes, sql, table
from tracemill.session import ship, work_dir
from tracemill.sources import custom, readers, store
from tracemill.streaming import early_stop


def r6(c, name):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def place(s, name: str) -> str:
    return f"{work_dir(s)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks
def numbered_files(s, d):
    home = place(s, "numbered")
    for name, items in {"part_10.json": [{"v": 3}, {"v": 4}], "part_2.json": [{"v": 2}], "extra.json": [{"v": 1}]}.items():
        store.put_text(s, f"{home}/{name}", json.dumps(items))
    return readers.read_numbered_json(s, home).select("file_id", F.col("v").cast("long").alias("v"))


register("SRC-6", numbered_files, "SELECT * FROM (VALUES (-1::BIGINT, 1::BIGINT), (2, 2), (10, 3), (10, 4)) t(file_id, v)")


def stored(s, d):
    home = place(s, "store")
    before = store.exists(s, f"{home}/a/x.txt")
    store.make_dirs(s, f"{home}/a")
    store.put_text(s, f"{home}/a/x.txt", "one\ntwo")
    store.copy(s, f"{home}/a/x.txt", f"{home}/b/y.txt")
    again = store.cached(s, f"{home}/a/x.txt", f"{home}/cache") == store.cached(s, f"{home}/a/x.txt", f"{home}/cache")
    lines = s.read.text(f"{home}/b/y.txt").agg(F.count("*").alias("lines"))
    return lines.select(F.lit(before).alias("before"), F.lit(store.exists(s, f"{home}/a/x.txt")).alias("after"), F.lit(again).alias("cached"), "lines")


register("SRC-7", stored, "SELECT false AS before, true AS after, true AS cached, 2::BIGINT AS lines")


def benchmarks(s, d):
    home = place(s, "benchmarks")
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(t["text"].alias("value"))).alias("conversations"))
    turns.write.json(f"{home}/talks")
    talks = readers.read_conversations(s, f"{home}/talks").select(F.lit("talks").alias("kind"), F.length("prompt").cast("long").alias("a"), F.length("completion").cast("long").alias("b"))
    table(s, d, "orders").select(F.col("o_orderstatus").alias("Model"), F.col("o_custkey").alias("Request tokens"), (F.col("o_orderkey") % 5).alias("Response tokens")).write.csv(f"{home}/burst", header=True)
    burst = readers.read_bursts(s, f"{home}/burst", "F").select(F.lit("burst").alias("kind"), F.col("prompt_tokens").alias("a"), F.col("output_tokens").alias("b"))
    return talks.unionByName(burst)


register(
    "SRC-8",
    benchmarks,
    "SELECT 'talks' AS kind, length(t[1]) AS a, length(t[2]) AS b FROM (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) WHERE len(t) >= 2 UNION ALL SELECT 'burst', o_custkey, o_orderkey % 5 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 > 0",
)


def sunk(s, d, write, read, *columns):
    df = table(s, d, "supplier").select(*columns)
    home = place(s, "sink")
    write(df, home)
    return read(home)


register("SNK-1", lambda s, d: sunk(s, d, readers.write_results, lambda p: readers.read_csv(s, p), "s_suppkey", "s_name").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name"), "SELECT s_suppkey, s_name FROM supplier")
register("SNK-2", lambda s, d: sunk(s, d, readers.write_probe_log, s.read.json, "s_suppkey", F.concat("s_name", F.lit(" é▁")).alias("s_name")), "SELECT s_suppkey, s_name || ' é▁' AS s_name FROM supplier")
register("SNK-3", lambda s, d: sunk(s, d, readers.write_nested, s.read.parquet, F.struct(F.col("s_suppkey").alias("id"), F.array("s_name", F.lit("x")).alias("names")).alias("r")).select("r.id", F.col("r.names")[0].alias("name")), "SELECT s_suppkey AS id, s_name AS name FROM supplier")
register("SNK-4", lambda s, d: sunk(s, d, lambda df, p: readers.write_one_per_item(df, "s_suppkey", p, 100), s.read.json, "s_suppkey", "s_name").select(F.col("item").cast("long").alias("item"), "s_suppkey", "s_name"), "SELECT s_suppkey AS item, s_suppkey, s_name FROM supplier")
register("SNK-7", lambda s, d: sunk(s, d, readers.write_metrics, s.read.json, (F.col("s_suppkey") % 3).alias("data_source"), "s_acctbal").select(F.col("data_source").cast("long").alias("data_source"), "s_acctbal"), "SELECT s_suppkey % 3 AS data_source, s_acctbal FROM supplier")


def tracked(s, d):
    home = place(s, "metrics")
    for step in (1, 2):
        stats = table(s, d, "orders").filter(F.col("o_orderkey") % 2 == step - 1).agg(F.count("*").cast("double").alias("rows"), F.max("o_totalprice").alias("most")).first().asDict()
        store.log_metrics(s, stats, step, home)
    return s.read.json(home).select("step", "name", "value")


register("SNK-6", tracked, "SELECT step, name, value FROM (SELECT o_orderkey % 2 + 1 AS step, count(*)::DOUBLE AS rows, max(o_totalprice) AS most FROM orders GROUP BY 1) UNPIVOT (value FOR name IN (rows, most))")


def paced(s, d):
    ship(s)
    home = place(s, "paced")
    source = table(s, d, "supplier").select("s_suppkey", "s_acctbal")
    source.repartition(4).write.parquet(f"{home}/in")
    stream = early_stop.paced(s, source.schema, f"{home}/in", 1)
    query = stream.writeStream.foreachBatch(lambda df, batch: store.log_metrics(df.sparkSession, {"rows": float(df.count())}, batch, f"{home}/out")).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.json(f"{home}/out").agg(F.count("*").alias("batches"), F.sum("value").alias("rows"))


register("STM-9", paced, "SELECT 4::BIGINT AS batches, count(*)::DOUBLE AS rows FROM supplier")


# --- features and prompts
def features(s, d):
    df = table(s, d, "lineitem")
    first = readers.default_features(df, ["l_tax", "nothing"], [], [])
    usual = readers.default_features(df, None, ["l_discount", "l_none"], [])
    rest = readers.default_features(df, None, ["l_none"], ["l_orderkey"])
    return s.createDataFrame([("wanted", ",".join(first)), ("usual", ",".join(usual)), ("numeric", ",".join(rest))], "kind string, names string")


register("PRJ-7", features, "SELECT * FROM (VALUES ('wanted', 'l_tax'), ('usual', 'l_discount'), ('numeric', 'l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax')) t(kind, names)")


def prompts(s, d):
    choice = X.prompt("choice", question=F.col("p_name"), a=F.col("p_brand"), b=F.col("p_type"), c=F.col("p_size").cast("string"), d=F.lit("none"))
    return table(s, d, "part").select(
        "p_partkey", choice.alias("choice"), X.prompt("math", problem=F.col("p_name")).alias("math"), X.opened(F.lit("Be brief."), F.col("p_name")).alias("opened"),
        X.opened(F.lit("Be brief."), F.col("p_name"), F.col("p_type")).alias("thought"), X.prompt("open probe", prefix=F.trim(F.col("p_type"))).alias("probe"), X.prompt("closed probe", prefix=F.col("p_type")).alias("closed"),
    )


register(
    "PRJ-8",
    prompts,
    r"""SELECT p_partkey, '**Question**:' || chr(10) || p_name || chr(10) || '**Choices**:' || chr(10) || 'A: ' || p_brand || chr(10) || 'B: ' || p_type || chr(10) || 'C: ' || p_size || chr(10) || 'D: none' || chr(10) || 'Now based on the above reasoning, you must give the correct option in the form <final_answer>your answer(A,B,C,D,only one letter)</final_answer>. You must give an option.' AS choice,
  'Here is a math problem:' || chr(10) || p_name || chr(10) || chr(10) || 'Please provide detailed reasoning inside <think>...</think> and then output your final answer inside \boxed{}' AS math,
  '<system>Be brief.</system>' || chr(10) || 'user' || chr(10) || p_name || chr(10) || 'assistant' || chr(10) || '<think> ' AS opened, '<system>Be brief.</system>' || chr(10) || 'user' || chr(10) || p_name || chr(10) || 'assistant' || chr(10) || '<think> ' || p_type || ' </think>' || chr(10) AS thought,
  '<think> ' || trim(p_type) || ' <stop> </think>' || chr(10) || '$$' || chr(10) || '\boxed{' AS probe, '<think> ' || p_type || ' </think><final_answer>' AS closed FROM part""",
)


def options(s, d):
    ship(s)
    letter = F.substring(F.lit("ABC"), (F.col("p_partkey") % 3 + 1).cast("int"), F.lit(1))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(letter, F.lit(": "), F.element_at(F.array(F.lit("red widget"), F.lit("small ring"), F.lit("blue bolt")), (F.col("p_partkey") % 3 + 1).cast("int")))).otherwise(letter)
    return table(s, d, "part").select("p_partkey", rules.fuzzy_option(said, {"A": "red widget", "B": "small ring", "C": "blue bolt"}).alias("option"))


register("STR-24", options, "SELECT p_partkey, substr('ABC', p_partkey % 3 + 1, 1) AS option FROM part")


# --- tool calls
def tool_calls(s, d):
    n = F.col("p_partkey").cast("string")
    call = lambda key: F.concat(F.lit('{"name": "find", "'), F.lit(key), F.lit('": {"id": '), n, F.lit("}}"))
    text = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("see <tool_call>\n"), call("arguments"), F.lit("\n</tool_call> and <tool_call>"), call("arguments"), F.lit("</tool_call>")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("ok [TOOL_CALLS] ["), call("arguments"), F.lit("]")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("<|python_tag|>"), call("parameters")))
        .otherwise(F.lit("no call at all"))
    )
    calls = X.tool_calls(text)
    return table(s, d, "part").select("p_partkey", F.size(calls["calls"]).cast("long").alias("n"), F.get(calls["calls"], F.lit(0))["name"].alias("name"), F.get_json_object(F.get(calls["calls"], F.lit(0))["arguments"], "$.id").cast("long").alias("id"), F.trim(calls["content"]).alias("content"))


register("STR-27", tool_calls, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN p_partkey % 4 < 3 THEN 'find' END AS name, CASE WHEN p_partkey % 4 < 3 THEN p_partkey END AS id, CASE p_partkey % 4 WHEN 0 THEN 'see' WHEN 1 THEN 'ok' WHEN 2 THEN '' ELSE 'no call at all' END AS content FROM part")


# --- dataset preparation
register("DSP-4", lambda s, d: preparing.collated(table(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 16).select("batch", F.array_join("s_suppkey", ",").alias("keys"), F.size("s_name").cast("long").alias("n")), "SELECT (row - 1) // 16 AS batch, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS keys, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS row FROM supplier) GROUP BY 1")
register("DSP-5", lambda s, d: preparing.mini_batches(table(s, d, "supplier").select("s_suppkey"), "s_suppkey", 8, 2, 4), "SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY md5('4:' || epoch || ':' || s_suppkey), s_suppkey) - 1) // 8 AS batch, s_suppkey FROM supplier, range(2) t(epoch)")


def completions(s, d):
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    out = preparing.completion_only(turns, "messages")
    return out.select("conv_id", F.size("words").cast("long").alias("n"), F.aggregate("loss", F.lit(0), lambda a, x: a + x).cast("long").alias("trained"))


register("DSP-6", completions, r"SELECT conv_id, sum(n)::BIGINT AS n, (coalesce(sum(n) FILTER (last AND role = 'assistant'), 0))::BIGINT AS trained FROM (SELECT conv_id, role, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id")
register(
    "AGG-22",
    lambda s, d: A.recent_hit_rate(probes(s, d).withColumn("asked", F.col("k") + 1).withColumn("found", F.col("hit").cast("long")), "qid", ["step"], "k", "asked", "found", 1000).select("qid", "step", r6("hit_rate", "hit_rate")),
)


# --- callables
RULE = '''
def bonus(values, scale=1.0):
    return values * scale + 1


class Squares(DataSource):
    """A data set given by a class: numbers and their squares, in two parts."""

    @classmethod
    def name(cls):
        return "squares"

    def schema(self):
        return "id long, square long"

    def reader(self, schema):
        n = int(self.options["rows"])

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(i) for i in range(2)]

            def read(self, partition):
                for i in range(partition.value, n, 2):
                    yield i, i * i

        return Reader()
'''


def by_path(s, d):
    ship(s)
    path = f"{place(s, 'rule')}.py"
    store.put_text(s, path, RULE)
    return rules.apply_rule(table(s, d, "events"), rules.load_rule(s, path, "bonus", scale=0.5), ["value"], "score").select("event_id", r6("score", "score"))


register("UDF-2", by_path, "SELECT event_id, round(value * 0.5::DOUBLE + 1, 6) + 0.0 AS score FROM events")


def data_set(s, d):
    path = f"{place(s, 'data')}.py"
    store.put_text(s, path, RULE)
    custom.register_source(s, path, "Squares")
    return s.read.format("squares").option("rows", "50").load()


register("UDF-3", data_set, "SELECT id, id * id AS square FROM range(50) t(id)")


def processors(s, d):
    ship(s)
    rows = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))

    def third_up(logits: np.ndarray) -> np.ndarray:
        logits = logits.copy()
        logits[2] += 1
        return logits

    out = rules.process_logits(rows, "logits", [third_up, lambda x: x * 2])
    return out.select("vec_id", *[r6(F.col("logits")[i], f"t{i}") for i in (1, 2)])


register("UDF-4", processors, "SELECT vec_id, round(embedding[2]::DOUBLE * 2, 6) + 0.0 AS t1, round((embedding[3]::DOUBLE + 1) * 2, 6) + 0.0 AS t2 FROM embeddings")


def dispatched(s, d):
    ship(s)
    rows = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"))
    double = lambda pdf: pd.DataFrame({"k": pdf["s_suppkey"], "v": pdf["s_suppkey"] * 2})
    top = lambda pdf: pd.DataFrame({"k": [pdf["nation"].iloc[0]], "v": [pdf["s_suppkey"].max()]})
    parts = rules.dispatch(rows, double, "k long, v long", "parts")
    groups = rules.dispatch(rows, top, "k long, v long", "groups", by=["nation"])
    every = rules.dispatch(rows.filter("s_suppkey < 10"), lambda pdf, rank: pd.DataFrame({"k": [rank], "v": [len(pdf)]}), "k long, v long", "every", workers=3)
    return parts.select(F.lit("parts").alias("mode"), "k", "v").unionByName(groups.select(F.lit("groups").alias("mode"), "k", "v")).unionByName(every.select(F.lit("every").alias("mode"), "k", "v"))


register("UDF-5", dispatched, "SELECT 'parts' AS mode, s_suppkey AS k, s_suppkey * 2 AS v FROM supplier UNION ALL SELECT 'groups', s_nationkey::BIGINT, max(s_suppkey) FROM supplier GROUP BY 2 UNION ALL SELECT 'every', r, (SELECT count(*) FROM supplier WHERE s_suppkey < 10) FROM range(3) t(r)")


# --- learning: each step is one pass of Spark's own learners, so only rows are checked here
def learners(s, d):
    df = T.final_answers(probes(s, d)).withColumn("velocity", T.velocity(F.col("value"), T.per_question("event_id")))
    return df.select("qid", "step", "y", "value", "velocity", F.col("k").cast("double").alias("k"))


def boosted(s, d):
    df = learners(s, d)
    model = learning.boost(df, ["value", "velocity", "k"], "y", 2)
    model = learning.boost(df.filter("qid % 2 = 0"), ["value", "velocity", "k"], "y", 2, model)
    return learning.boosted_score(model, df.filter("qid % 5 = 0")).select("qid", "step", "y", "prob")


def reused(s, d):
    path, df = place(s, "model"), learners(s, d)
    learning.fit_or_load(df, ["value", "k"], "y", path)
    model = learning.fit_or_load(df, ["value", "k"], "y", path)
    return learning.score(model, df, ["value", "k"]).select("qid", "step", "prob")


register("ML-3", reused)
register("ML-4", boosted)


# --- terminal states and kinds of output of a stream
def sessions(s, d):
    ship(s)
    home = place(s, "sessions")
    k = F.col("k")
    delta = F.when(k % 29 == 0, "x <final_answer>B</final_answer>").when(k % 31 == 0, "y </final_answer>").otherwise("z ")
    source = probes(s, d).select("qid", "step", "event_id", delta.alias("delta"), (k % 23 == 0).alias("finished"), "value")
    source.repartition("qid").write.parquet(f"{home}/in")
    stream = early_stop.sessions(s.readStream.schema(source.schema).parquet(f"{home}/in"), 180.0, 0)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{home}/out").select("qid", "step", "kind", "cause")


CAUSES = "+c AS (SELECT qid, step, CASE WHEN k % 29 = 0 THEN 'think_final' WHEN k % 31 = 0 THEN 'hard_stop' WHEN k % 23 = 0 THEN 'finished' WHEN value >= 180 THEN 'early_stop' END AS cause FROM probes), e AS (SELECT qid, min(step) FILTER (cause IS NOT NULL) AS stop FROM c GROUP BY qid)"
register("STM-4", sessions, sql(f"{CAUSES} SELECT qid, -1::BIGINT AS step, 'baseline' AS kind, NULL AS cause FROM e UNION ALL SELECT qid, step, CASE WHEN cause IN ('hard_stop', 'finished', 'think_final') THEN cause ELSE 'interval' END, cause FROM c JOIN e USING (qid) WHERE step <= coalesce(stop, step)"))
register("STM-6", lambda s, d: sessions(s, d).filter("kind = 'baseline'").select("qid", "step"), sql("SELECT DISTINCT qid, -1::BIGINT AS step FROM probes"))


def kinds(s, d):
    n = F.length("text")
    parts = table(s, d, "documents").select("doc_id", F.posexplode(F.array(F.substring("text", F.lit(1), F.floor(n / 3).cast("int")), F.substring("text", F.lit(1), F.floor(n / 2).cast("int")), F.col("text"))).alias("i", "text"))
    out = None
    for kind in ("cumulative", "delta", "final"):
        got = early_stop.output_rows(parts, "doc_id", ["i"], "text", kind).select(F.lit(kind).alias("kind"), "doc_id", F.col("i").cast("long").alias("i"), F.md5("text").alias("digest"))
        out = got if out is None else out.unionByName(got)
    return out


register(
    "STM-7",
    kinds,
    "WITH t AS (SELECT doc_id, text, [length(text) // 3, length(text) // 2, length(text)] AS n, unnest(range(3)) AS i FROM documents) SELECT 'cumulative' AS kind, doc_id, i, md5(substr(text, 1, n[i + 1])) AS digest FROM t UNION ALL SELECT 'delta', doc_id, i, md5(substr(text, CASE WHEN i = 0 THEN 1 ELSE n[i] + 1 END, CASE WHEN i = 0 THEN n[1] ELSE n[i + 1] - n[i] END)) FROM t UNION ALL SELECT 'final', doc_id, 2, md5(text) FROM documents",
)
