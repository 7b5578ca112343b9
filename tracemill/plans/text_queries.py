"""Queries of text functions, rewards and probe slots over reasoning traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import rewards as R
from tracemill.plans.catalogue import register
from tracemill.plans.fixtures import logits, probes, sql, table, tokens, traces


def r6(c, name):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def trace(name: str, columns, body: str):
    """A query of traces: columns(text) -> dict of columns, and the select list in SQL over column `trace`."""
    register(name, lambda s, d: traces(s, d).select("doc_id", *[c.alias(k) for k, c in columns(F.col("trace")).items()]), sql(f"SELECT doc_id, {body} FROM traces"))


BOX = r"CASE doc_id % 4 WHEN 0 THEN '\boxed{\frac{' || doc_id || '}{7}}' WHEN 1 THEN '\boxed{x{' || doc_id || '}y}' END"
INNER = r"CASE doc_id % 4 WHEN 0 THEN '\frac{' || doc_id || '}{7}' WHEN 1 THEN 'x{' || doc_id || '}y' ELSE '' END"
trace("STR-1", lambda x: {"box": X.boxed_or_framed(x)}, f"{BOX} AS box")
trace("STR-2", lambda x: {"answer": X.unboxed(X.last_box(x))}, f"{INNER} AS answer")
trace("STR-3", lambda x: {"key": X.answer_key(x)}, f"CASE WHEN doc_id % 4 < 2 THEN {INNER} ELSE trim(trace) END AS key")
CANON = r"trim(replace(regexp_replace(replace(replace(a, '–', '-'), '\left', ''), '\\text\{([^}]*)\}', '\1', 'g'), ' ', ''), '$')"
register("STR-4", lambda s, d: table(s, d, "part").select("p_partkey", X.canonical(F.concat(F.lit(" $\\left–\\text{"), "p_name", F.lit("} "), "p_size", F.lit("$ "))).alias("form")), f"SELECT p_partkey, {CANON} AS form FROM (SELECT p_partkey, trim(' $\\left–\\text{{' || p_name || '}} ' || p_size || '$ ') AS a FROM part)")
register("STR-5", lambda s, d: table(s, d, "part").select("p_partkey", X.math_form(F.concat(F.lit("x = \\sqrt3 + \\frac12 + "), "p_size")).alias("form"), X.math_form(F.concat_ws("/", "p_size", F.lit("7"))).alias("ratio")), r"SELECT p_partkey, '\sqrt{3}+\frac{1}{2}+' || p_size AS form, '\frac{' || p_size || '}{7}' AS ratio FROM part")
register("STR-7", lambda s, d: table(s, d, "orders").select("o_orderkey", X.without_digit_commas(F.format_number("o_totalprice", 2)).alias("n")), "SELECT o_orderkey, printf('%.2f', o_totalprice) AS n FROM orders")
register("STR-10", lambda s, d: table(s, d, "documents").select("doc_id", X.letter(F.concat(F.lit("<final_answer>Answer: "), F.substring(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)), F.lit(")</final_answer>"))).alias("letter")), "SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN substr('ABCD', doc_id % 5 + 1, 1) END AS letter FROM documents")
register("STR-11", lambda s, d: table(s, d, "part").select("p_partkey", X.gold_letter((F.col("p_partkey") % 4).cast("string")).alias("gold"), X.gold_letter(F.concat(F.lit("-"), F.substring("p_brand", 1, 3), F.lit("b"))).alias("named")), "SELECT p_partkey, substr('ABCD', p_partkey % 4 + 1, 1) AS gold, upper(regexp_extract('-' || substr(p_brand, 1, 3) || 'b', '([A-Da-d])', 1)) AS named FROM part")
trace("STR-12", lambda x: {"clean": X.cleaned_thinking(F.concat(x, F.lit(" <final_answer>A</final_answer>")))}, "trim(regexp_replace(trace, '</?think>', '', 'g')) AS clean")
trace("STR-13", lambda x: {"thought": X.thinking(x)}, r"regexp_extract(trace, '(?s)<think>(.*?)(?:</think>|\z)', 1) AS thought")
STOPS = r"list_filter(list_transform(string_split(replace(trace, '. ', '<stop>'), '<stop>'), lambda p: trim(p)), lambda p: p <> '')"
stopped = lambda x: X.stops(F.replace(x, F.lit(". "), F.lit("<stop>")))
trace("STR-14", lambda x: {"n": F.size(stopped(x)).cast("long"), "parts": F.array_join(stopped(x), "|")}, f"len({STOPS}) AS n, array_to_string({STOPS}, '|') AS parts")
register(
    "STR-15",
    lambda s, d: X.prefix_rows(traces(s, d).select("doc_id", stopped(F.col("trace")).alias("parts")), "parts").select("doc_id", "k", F.length("prefix").cast("long").alias("chars"), F.md5("prefix").alias("digest")),
    sql(f"+p AS (SELECT doc_id, {STOPS} AS s FROM traces), k AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM p) SELECT doc_id, k, length(array_to_string(s[1:k], ' <stop> ')) AS chars, md5(array_to_string(s[1:k], ' <stop> ')) AS digest FROM k"),
)
trace("STR-16", lambda x: {"tail": X.last_parts(stopped(x), 5)}, f"coalesce(array_to_string(({STOPS})[-5:], ' <stop> '), '') AS tail")
trace("STR-17", lambda x: {"n": F.size(X.sentences(x)).cast("long"), "first": F.coalesce(F.try_element_at(X.sentences(x), F.lit(1)), F.lit(""))}, r"len(regexp_extract_all(trace, '[^.!?。！？]+[.!?。！？]*')) AS n, coalesce(regexp_extract_all(trace, '[^.!?。！？]+[.!?。！？]*')[1], '') AS first")
trace("STR-19", lambda x: {"n": F.size(X.thought_steps(x)).cast("long")}, r"len(list_filter(string_split_regex(trace, '->|[.!?\n]'), lambda p: trim(p) <> ''))::BIGINT AS n")
register("STR-20", lambda s, d: table(s, d, "documents").select("doc_id", F.upper(F.regexp_extract(F.ltrim("text", F.lit("Ġ▁ (\"'*#")), "^([A-Za-z])(?![a-z])", 1)).alias("bucket")), r"""SELECT doc_id, upper(regexp_extract(ltrim(text, 'Ġ▁ ("''*#'), '^([A-Za-z])(?:[^a-z]|$)', 1)) AS bucket FROM documents""")
trace(
    "STR-21",
    lambda x: {"strict": X.reasoning_and_content(x, True)["content"], "loose": X.reasoning_and_content(x, False)["reasoning"]},
    "CASE WHEN doc_id % 4 = 1 THEN trace ELSE nullif(substr(trace, instr(trace, '</think>') + 8), '') END AS strict, CASE WHEN doc_id % 4 = 1 THEN replace(trace, '<think>', '') ELSE replace(substr(trace, 1, instr(trace, '</think>') - 1), '<think>', '') END AS loose",
)
trace("STR-22", lambda x: {"without": X.cut_at_stop(x, ["</think>", ". "], False), "with": X.cut_at_stop(x, ["</think>", ". "], True)}, "CASE WHEN doc_id % 4 <> 1 THEN substr(trace, 1, instr(trace, '</think>') - 1) WHEN instr(trace, '. ') > 0 THEN substr(trace, 1, instr(trace, '. ') - 1) ELSE trace END AS without, CASE WHEN doc_id % 4 <> 1 THEN substr(trace, 1, instr(trace, '</think>') + 7) WHEN instr(trace, '. ') > 0 THEN substr(trace, 1, instr(trace, '. ') + 1) ELSE trace END AS with")
trace("STR-23", lambda x: {"foreign": X.foreign_letters(x), "gap": X.wide_gap(x)}, r"regexp_matches(regexp_replace(trace, '[A-Za-z]', '', 'g'), '\p{L}') AS foreign, regexp_matches(trace, ' {10,}') AS gap")
register("STR-25", lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.startswith("o_orderpriority", F.lit("1")) | F.startswith("o_orderpriority", F.lit("2")), F.concat(F.lit("Hard: "), "o_orderpriority")).otherwise(F.concat(F.lit("Easy: "), "o_orderpriority")).alias("tag")), "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'Hard: ' ELSE 'Easy: ' END || o_orderpriority AS tag FROM orders")
register("JSON-1", lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.feats.step").cast("long"), F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("step")), "SELECT event_id, coalesce(regexp_extract(props, '([0-9]+)', 1)::BIGINT, 0) AS step FROM events")
LEN = "CASE WHEN {c} < 0.5 THEN CASE WHEN l_quantity <= {t} THEN 1.0 ELSE {t} / l_quantity END ELSE CASE WHEN l_quantity >= {t} THEN 1.0 ELSE l_quantity / {t} END END".format(c="(l_discount * 10)", t="(30 * (l_discount * 10))")
register("MTH-3", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", r6(X.length_match(F.col("l_quantity"), F.lit(30.0), F.col("l_discount") * 10), "score")), f"SELECT l_orderkey, l_extendedprice, round(CASE WHEN 30 * (l_discount * 10) <= 0 THEN CASE WHEN l_quantity > 0 THEN 0.0 ELSE 1.0 END ELSE greatest(0.0, least(1.0, {LEN})) END, 6) + 0.0 AS score FROM lineitem")
register("MTH-4", lambda s, d: table(s, d, "orders").select("o_orderkey", X.close(F.col("o_totalprice"), F.round("o_totalprice", -1)).alias("close")), "SELECT o_orderkey, abs(o_totalprice - round(o_totalprice, -1)) <= 1e-4::DOUBLE * greatest(abs(o_totalprice), abs(round(o_totalprice, -1))) AS close FROM orders")
# --- rewards
EARLY = "(doc_id % 10) / 10.0::DOUBLE"
NSTOP = "(length(t) - length(replace(t, '<stop>', ''))) / 6"
TAGGED = "(length(t) - length(replace(t, '<think>', '')) = 7 AND length(t) - length(replace(t, '</think>', '')) = 8)"
STOPPED = f"({NSTOP} BETWEEN 1 AND 5)"
MARKED = "+m AS (SELECT doc_id, replace(trace, '. ', '<stop>') AS t FROM traces)"


def rewarded(rule):
    def run(s, d):
        t = traces(s, d).withColumn("t", F.replace("trace", F.lit(". "), F.lit("<stop>")))
        return t.select("doc_id", r6(rule(F.col("t"), (F.col("doc_id") % 10) / F.lit(10.0), F.col("doc_id") % 3 == 0), "score"))

    return run


register("RWD-1", rewarded(R.open_reward), sql(f"{MARKED} SELECT doc_id, round(CASE WHEN {STOPPED} THEN {EARLY} ELSE 0 END / 4 + {STOPPED}::INT / 8 + {TAGGED}::INT / 8 + (doc_id % 3 = 0)::INT / 2, 6) + 0.0 AS score FROM m"))
register("RWD-2", rewarded(R.closed_reward), sql(f"{MARKED}, f AS (SELECT *, (NOT (regexp_matches(regexp_replace(t, '[A-Za-z]', '', 'g'), '\\p{{L}}') OR regexp_matches(t, ' {{10,}}')))::INT AS fair FROM m) SELECT doc_id, round(CASE WHEN {STOPPED} THEN {EARLY} ELSE 0 END / 4 + fair * {STOPPED}::INT / 8 + fair * {TAGGED}::INT / 2 / 8 + (doc_id % 3 = 0)::INT / 2, 6) + 0.0 AS score FROM f"))
register("RWD-6", lambda s, d: table(s, d, "documents").select("doc_id", R.by_source(F.col("lang"), {"en": F.lit(1.0), "fr": F.lit(0.5), "de": F.lit(0.25), "es": F.lit(0.125)}).alias("score")), "SELECT doc_id, CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'fr' THEN 0.5 WHEN 'de' THEN 0.25 ELSE 0.125 END AS score FROM documents")
register("RWD-7", lambda s, d: table(s, d, "orders").select("o_orderkey", R.number_answer(F.concat(F.lit("so 5 #### "), F.format_number("o_totalprice", 2)), True).alias("strict"), R.number_answer(F.concat(F.lit("a 7, b "), "o_custkey", F.lit(".")), False).alias("loose")), "SELECT o_orderkey, printf('%.2f', o_totalprice) AS strict, o_custkey::VARCHAR AS loose FROM orders")
trace("RWD-11", lambda x: {"score": R.think_format(F.replace(x, F.lit("<think>"), F.lit("")))}, "(doc_id % 4 <> 1)::DOUBLE AS score")
# --- probe slots
BUCKETED = "+lt AS (SELECT row, CASE WHEN token % 7 < 4 THEN substr('ABCD', token % 7 + 1, 1) END AS letter, logit AS logp FROM logits)"


def lettered(s, d):
    code = (F.col("token") % 7).cast("int")
    return logits(s, d).select("row", F.when(code < 4, F.substring(F.lit("ABCD"), code + 1, F.lit(1))).alias("letter"), F.col("logit").alias("logp"))


register("PRB-1", lambda s, d: R.letter_slots(lettered(s, d)).select("row", *[r6(c, c) for c in (*"abcd", "tail")]), sql(BUCKETED + " SELECT row, " + ", ".join(f"round(coalesce(ln(sum(exp(logp)) FILTER (letter = '{x}')), min(logp) - 2), 6) + 0.0 AS {x.lower()}" for x in "ABCD") + ", round(min(logp), 6) + 0.0 AS tail FROM lt GROUP BY row"))
register("PRB-2", lambda s, d: R.chosen_step(probes(s, d), F.col("k") % 11 == 0, F.col("k") % 5).select("qid", "step"), sql("SELECT qid, step FROM probes QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k % 11 = 0 DESC, CASE WHEN k % 11 = 0 THEN step END, k % 5 DESC, step DESC) = 1"))
register("PRB-4", lambda s, d: R.open_slot(tokens(s, d), "seq", "logp").select("seq", "ans_len", *[r6(c, c) for c in ("l_sum", "mean_logprob", "var_logprob", "neg_ppl")]), sql("SELECT seq, count(*) AS ans_len, round(sum(logp), 6) + 0.0 AS l_sum, round(avg(logp), 6) + 0.0 AS mean_logprob, round(var_pop(logp), 6) + 0.0 AS var_logprob, round(-avg(logp), 6) + 0.0 AS neg_ppl FROM tokens GROUP BY seq"))
