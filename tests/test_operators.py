"""Worked examples, identities, and plain-Python references on random input."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.functions import answers as G
from tracemill.functions import text as X
from tracemill.operators import advantages as V
from tracemill.operators import aggregates as A
from tracemill.operators import closed_qa as Q
from tracemill.operators import learning
from tracemill.operators import relational as R
from tracemill.operators import rules
from tracemill.operators import sampling as S
from tracemill.operators import trajectory as T
from tracemill.sources import readers
from tracemill.streaming import early_stop as S2


def probes(spark, rows):
    return spark.createDataFrame([(q, s, i, v, a) for i, (q, s, v, a) in enumerate(rows)], "qid long, step long, event_id long, value double, answer string")


def test_curvature_of_squares(spark):
    df = probes(spark, [(n, s, float((s + 1) ** 2), "a") for n in (3, 4, 5, 6) for s in range(n)])
    w = T.per_question("event_id")
    got = df.withColumn("c", T.curvature(F.col("value"), w)).groupBy("qid").agg(F.max_by("c", "step").alias("c")).collect()
    assert all(abs(r.c - 2) < 1e-9 for r in got)


def test_trajectory_example(spark):
    w = T.per_question("event_id")
    df = T.step_energy(probes(spark, [(1, i, x, "a") for i, x in enumerate((5.0, 7.0, 4.0))]), "value", w)
    df = df.withColumns({"vel": T.velocity(F.col("value"), w), "acc": T.acceleration(F.col("value"), w), "delta": T.delta_recent(F.col("value"), w), "slope": T.slope_recent(F.col("value"), w)})
    rows = df.orderBy("step").collect()
    assert [r.s_es for r in rows] == [0, 2, -3] and [r.h_es for r in rows] == [0, 2, -5]
    assert [r.vel for r in rows] == [0, 2, -3] and [r.acc for r in rows] == [0, 0, -5]
    assert [r.delta for r in rows] == [0, 2, -1] and [r.slope for r in rows] == [0, 2, -0.5]


def test_runs(spark):
    rows = T.runs(probes(spark, [(1, i, 0.0, a) for i, a in enumerate("aabba")]), "answer", T.per_question("event_id")).orderBy("step").collect()
    assert [r.run_len for r in rows] == [1, 2, 1, 2, 1] and [r.flips for r in rows] == [0, 0, 1, 1, 2]


def test_tie_takes_last_letter(spark):
    df = spark.range(1).select(*[F.lit(0.0).alias(f"cum_{c}") for c in "abcd"])
    assert T.top_letter(df, ("a", "b", "c", "d")).first().cum_top == "D"


def test_boxes(spark):
    cases = {r"x \boxed{\frac{1}{2}} y \boxed{a{b}c} z": "a{b}c", r"\boxed{open": "", "none": "", r"\boxed{a} \boxed{b": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", X.unboxed(X.last_box(F.col("t"))).alias("a")).collect():
        assert r.a == cases[r.t]


def test_gold_and_letters(spark):
    df = spark.createDataFrame([("2",), ("b) x",), ("7",)], "t string")
    assert [r[0] for r in df.select(X.gold_letter(F.col("t"))).collect()] == ["C", "B", None]


def test_buckets():
    assert A.buckets_1_2_5(100) == [1, 2, 5, 10, 20, 50, 100]


def test_draft():
    assert S.draft([1, 2, 3, 4, 2, 3], 2, 3, 4) == [4, 2, 3]
    assert S.draft([1, 2, 3], 2, 3, 4) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=0, max_size=40), st.integers(1, 6))
def test_balanced_parts(lengths, k):
    parts = S.balanced_parts(lengths, k)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths))) and len(parts) == k
    if len(lengths) % k == 0:
        assert len({len(p) for p in S.balanced_parts(lengths, k, equal=True)}) <= 1


def test_group_advantages(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 1.0), (2, 2, 0.0)], "uid long, rid long, score double")
    assert abs(V.grpo(df).filter("uid = 1").first().adv - 0.5 / (1 + 1e-6)) < 1e-12
    assert [r.adv for r in V.rloo(df).filter("uid = 2").orderBy("rid").collect()] == [1, -1]


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((800, 1, -5))], "row long, token long, logit double")
    assert abs(S.softmax(df).agg(F.sum("p")).first()[0] - 1) < 1e-12


def test_rows_by_position(spark):
    df = R.numbered(spark.range(6).withColumnRenamed("id", "x"), "x")
    assert [r.x for r in R.repeat(df, 2, 6).orderBy("row").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r.x for r in R.pad_to_divisor(df, 4, 6).orderBy("row").collect()] == [0, 1, 2, 3, 4, 5, 0, 1]
    with pytest.raises(ValueError):
        R.chunks(df, 4, 6)
    with pytest.raises(Exception, match="differ"):
        R.zip_join(df, df.withColumn("x", F.col("x") + 1)).collect()


def test_probe_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('\n{oops\n{"qid":"","probe_record":{"step":1}}\n{"qid":"q","probe_record":{"step":2,"qa_mode":"openqa","probe_text":" 4 "}}\n')
    rows = readers.read_probe_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert [(r.qid, r.step, r.probe_answer, r.has_answer) for r in rows] == [("q", 2, "4", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\nc"), (2, "d")], "_id long, t string")
    readers.write_results(df, str(tmp_path / "csv"))
    assert {r.t for r in readers.read_csv(spark, str(tmp_path / "csv")).collect()} == {"a,\"b\nc", "d"}
    assert readers.append_missing(df.filter("_id = 1"), str(tmp_path / "j")) == 1
    assert readers.append_missing(df, str(tmp_path / "j")) == 1 and readers.append_missing(df, str(tmp_path / "j")) == 0
    readers.write_one_per_item(df, "_id", str(tmp_path / "items"), 2)
    assert (tmp_path / "items" / "item=0001").is_dir()
    readers.write_metrics(df.withColumn("data_source", F.lit("x")), str(tmp_path / "m"))
    assert (tmp_path / "m" / "data_source=x").is_dir()


def test_items_with_long_keys(spark, tmp_path):
    keys = [0, 7, 9999, 10000, 10001, 123456, -5, None]
    readers.write_one_per_item(spark.createDataFrame([(k, f"t{k}") for k in keys], "_id long, t string"), "_id", str(tmp_path / "items"), 2)
    assert {p.name for p in (tmp_path / "items").iterdir() if p.is_dir()} == {"item=__HIVE_DEFAULT_PARTITION__", *(f"item={k:04d}" for k in keys if k is not None)}
    rows = spark.read.json(str(tmp_path / "items")).select(F.col("item").cast("long").alias("item"), "_id", "t").collect()
    assert {(r.item, r._id, r.t) for r in rows} == {(k, k, f"t{k}") for k in keys}


def test_bootstrap_against_plain_python(spark):
    # Keys of all lengths, also beyond one MD5 block, null keys and values, and a table with rounds that draw nothing.
    keys = [str(i * i * 7919) for i in range(150)] + ["", "é", "x" * 46, "x" * 49, "x" * 70, None]
    for rows in ([(k, None if i % 11 == 3 else i * 1.25) for i, k in enumerate(keys)], [("1", 2.0)], [("1", None)]):
        means = []
        for r in range(1, 121):
            us = [-1.0 if k is None else (int(hashlib.md5(f"42:{r}:{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for k, _ in rows]
            times = [sum(u >= edge for _, edge in A.poisson_edges()) for u in us]
            total = sum(x * n for (_, x), n in zip(rows, times) if x is not None)
            means.append(total / sum(times) if sum(times) else math.nan)
        got = A.bootstrap(spark.createDataFrame(rows, "k string, x double"), "x", "k", 120).first()
        if all(x is None for _, x in rows):
            assert got["mean"] is None and got["std"] is None
        else:
            np.testing.assert_allclose([got["mean"], got["std"]], [np.mean(means), np.std(means)], rtol=1e-12)


def plain_gae(rewards, values, mask, gamma, lam):
    out, later = [], 0.0
    for i in reversed(range(len(rewards))):
        later = rewards[i] + gamma * (values[i + 1] if i + 1 < len(values) else 0) - values[i] + gamma * lam * later
        out.append(later)
    out = out[::-1]
    valid = [a for a, m in zip(out, mask) if m]
    mean = sum(valid) / len(valid)
    var = sum((a - mean) ** 2 for a in valid) / (len(valid) - 1)
    return [(a - mean) / math.sqrt(var + 1e-8) if m else 0.0 for a, m in zip(out, mask)]


def test_gae_is_whitened(spark):
    rewards, values, mask = [0.1, -0.4, 1.0, 0.3], [0.2, 0.1, -0.3, 0.5], [True, True, False, True]
    df = spark.createDataFrame([(1, i + 1, r, v, m) for i, (r, v, m) in enumerate(zip(rewards, values, mask))], "seq long, pos long, reward double, value double, mask boolean")
    got = [r.adv for r in V.gae(df, 0.9, 0.8).orderBy("pos").collect()]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, plain_gae(rewards, values, mask, 0.9, 0.8)))


def test_expressions():
    same = [("2*(x+1)", "2x+2"), ("sqrt(8)", "2sqrt(2)"), ("x^2-1", "(x-1)(x+1)"), ("1/2+1/3", "5/6"), ("3pi/3", "pi")]
    other = [("2x", "x+2"), ("sqrt(2)", "1.41"), ("x", "y"), ("", "1"), ("1/0", "1"), ("x^{2}", "x^{2}"), ("__import__('os')", "1")]
    assert all(G.equal_expressions(a, b) for a, b in same) and not any(G.equal_expressions(a, b) for a, b in other)
    assert G.same_symbols("\\frac{1}{2}", "1/2") and G.same_symbols("(1, 2x)", "(1,x+x)") and not G.same_symbols("[1,2]", "(1,2)") and not G.same_symbols("2/4", "1/2")
    assert G.found_answer("We get 7. So the answer is 12. ok")[1] == "12" and not G.found_answer("nothing at all")[0]


def test_answer_tags():
    text = "<think>ab. (<answer>A</answer>) cd <answer>B</answer></think> <final_answer>A</final_answer>"
    # Visible: "ab. () cd ": 5 characters before the first tag, 10 before the second and in all.
    assert G.tag_score(text, "B") == (1.0, 2)
    assert G.tag_score(text.replace("<final_answer>A</final_answer>", ""), "B") == (0.0, 2)
    assert G.tag_score("no tags", "A") == (0.0, 0) and G.tag_score(None, None) == (0.0, 0)
    score, tags = G.sentence_tag_score("ab. (<answer>A</answer>) cd <answer>A</answer>", "A")
    assert tags == 2 and math.isclose(score, (1 - 4 / 8) / 2)


def test_closed_features(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, *map(float, rng.normal(size=4))) for i in range(7)]
    got = Q.featured(spark.createDataFrame(rows, "qid long, step long, a double, b double, c double, d double")).orderBy("step").collect()
    shares = np.array([np.exp(r[2:]) / np.exp(r[2:]).sum() for r in rows])
    for i, r in enumerate(got):
        last = shares[max(0, i - 4) : i + 1]
        fisher = np.mean([np.diag(p) - np.outer(p, p) for p in last], 0)
        assert math.isclose(r.fi_lmax, np.linalg.eigvalsh(fisher)[-1], abs_tol=1e-9) and math.isclose(r.fi_trace, np.trace(fisher), abs_tol=1e-9)
        path = np.log(shares).cumsum(0)[: i + 1]
        if i >= 2:
            v, a = path[-1] - path[-2], path[-1] - 2 * path[-2] + path[-3]
            across = a - (a @ v) / (v @ v + 1e-9) * v
            assert math.isclose(r.kappa, np.linalg.norm(across) / (v @ v + 1e-9), abs_tol=1e-9)
        assert r.run_len >= 1 and math.isclose(r.step_ratio, (i + 1) / 7)


def test_sessions_over_split_tags():
    import pandas as pd

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

    run, state = S2.session_states(10.0, 2), State()
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["step", "event_id", "delta", "finished", "value"])])
    first = pd.concat(run((1,), frame((0, 0, "a <final_", False, 1.0), (1, 1, "answer>B</fi", False, 99.0)), state))
    second = pd.concat(run((1,), frame((2, 2, "nal_answer>", True, 99.0), (3, 3, "x", True, 0.0)), state))
    assert first.kind.tolist() == ["baseline", "interval"] and second[["step", "cause"]].values.tolist() == [[2, "think_final"]]


def test_recent_hit_rate():
    # Over 5 requests the oldest batch goes, one at a time.
    assert A._rates([3, 3, 3, 1], [1, 1, 1, 1], [1, 0, 0, 1], 5) == [1.0, 0.0, 0.0, 0.5]


def test_indel_ratio():
    assert (rules.indel_ratio("abcd", "abcd"), rules.indel_ratio("abcd", "abed"), rules.indel_ratio("", "a"), rules.indel_ratio("a", "b")) == (100, 75, 0, 0)


def test_guarded_rules_have_a_limit(spark):
    import time

    def slow(x):
        time.sleep(5 if x == "slow" else 0)
        return len(x)

    df = spark.createDataFrame([("slow",), ("ok",), (None,)], "t string")
    got = {r.t: r.s for r in rules.apply_guarded(df, slow, "t", "s", 0.3).collect()}
    assert got == {"slow": 0.0, "ok": 2.0, None: 0.0}


def test_numbering_by_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(x) if x % 7 else None, i) for i, x in enumerate(rng.integers(0, 50, 3000))]
    got = [tuple(r) for r in R.numbered(spark.createDataFrame(rows, "a long, b long"), "a", "b").orderBy("row").collect()]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(*r, i) for i, r in enumerate(want)]
    assert R.numbered(spark.createDataFrame([], "a long"), "a").count() == 0


def test_boosting_goes_on(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a * b > 0)) for a, b in x], "a double, b double, y int")
    loss = lambda m: learning.boosted_score(m, df).agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("prob")).otherwise(1 - F.col("prob"))))).first()[0]
    first = learning.boost(df, ["a", "b"], "y", 2)
    more = learning.boost(df, ["a", "b"], "y", 2, first)
    assert len(first.trees) == 2 and len(more.trees) == 4 and loss(more) < loss(first) < math.log(2)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
