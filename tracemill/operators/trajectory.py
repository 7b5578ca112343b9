"""Features of probe trajectories: one row per probe, ordered by step within a question.

All features of a table share one window specification, so Spark sorts once per question. n counts the probes
so far; WIDE is the number of probes that curvature looks back on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Fixed values.
LETTERS = ("A", "B", "C", "D")
SMALL, SMALLER = 1e-9, 1e-12


def per_question(*tiebreak: str) -> WindowSpec:
    return Window.partitionBy("qid").orderBy("step", *tiebreak)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def delta_recent(x: Column, w: WindowSpec) -> Column:
    """Change over two probes; over one at the second; 0 at the first."""
    return x - F.coalesce(F.lag(x, 2).over(w), F.first(x).over(so_far(w)))


def slope_recent(x: Column, w: WindowSpec) -> Column:
    n = F.row_number().over(w)
    return F.when(n > 1, (x - F.first(x).over(so_far(w))) / (n - 1)).otherwise(0.0)


def curvature(x: Column, w: WindowSpec) -> Column:
    """Second derivative of the least-squares parabola through the last 3, 4 or 5 probes; 0 before."""
    n = F.row_number().over(w)
    lag = lambda k: F.lag(x, k).over(w)
    three = x - 2 * lag(1) + lag(2)
    four = (x - lag(1) - lag(2) + lag(3)) / 2
    five = (2 * x - lag(1) - 2 * lag(2) - lag(3) + 2 * lag(4)) / 7
    return F.when(n >= 5, five).when(n == 4, four).when(n == 3, three).otherwise(0.0)


def velocity(x: Column, w: WindowSpec) -> Column:
    return F.coalesce(x - F.lag(x).over(w), F.lit(0.0))


def acceleration(x: Column, w: WindowSpec) -> Column:
    return F.coalesce(x - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w), F.lit(0.0))


def step_energy(df: DataFrame, x: str, w: WindowSpec) -> DataFrame:
    """s_es: the change of x (0 first); h_es: the change of s_es (0 first)."""
    df = df.withColumn("s_es", velocity(F.col(x), w))
    return df.withColumn("h_es", F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col("s_es") - F.lag("s_es").over(w)))


def runs(df: DataFrame, key: str, w: WindowSpec, order: tuple[str, ...] = ("step", "event_id")) -> DataFrame:
    """run_len and flips of a key: place within its run, and how often it changed so far."""
    changed = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("long"), F.lit(0))
    df = df.withColumn("flips", F.sum(changed).over(so_far(w)))
    island = Window.partitionBy("qid", "flips").orderBy(*order)
    return df.withColumn("run_len", F.row_number().over(island).cast("long"))


def sticky_runs(df: DataFrame, key: str, w: WindowSpec, order: tuple[str, ...] = ("step", "event_id")) -> DataFrame:
    """changed_prev, run_len, flips where a null key leaves the state as it is."""
    before = F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("changed_prev", F.coalesce((F.col(key).isNotNull() & before.isNotNull() & (F.col(key) != before)).cast("long"), F.lit(0)))
    df = df.withColumn("flips", F.sum("changed_prev").over(so_far(w)))
    island = Window.partitionBy("qid", "flips").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.count(key).over(island)
    return df.withColumn("run_len", F.greatest(seen, F.lit(1)))


def cumulative_scores(df: DataFrame, letters: tuple[str, ...], w: WindowSpec) -> DataFrame:
    """cum_x of each score column x: running sum of ln(softmax + SMALL)."""
    top = F.greatest(*[F.col(c) for c in letters])
    weight = {c: F.exp(F.col(c) - top) for c in letters}
    total = sum(weight.values(), F.lit(0.0)) + SMALLER
    for c in letters:
        df = df.withColumn(f"cum_{c}", F.sum(F.log(weight[c] / total + SMALL)).over(so_far(w)))
    return df


def top_letter(df: DataFrame, letters: tuple[str, ...]) -> DataFrame:
    """cum_top (ties: the last letter) and cum_margin to the second."""
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"cum_{c}").alias("s"), F.lit(c.upper()).alias("l")) for c in letters])))
    return df.withColumn("cum_top", ranked[0]["l"]).withColumn("cum_margin", ranked[0]["s"] - ranked[1]["s"])


def one_hot(df: DataFrame, column: str = "cum_top", letters=LETTERS) -> DataFrame:
    return df.withColumns({f"is_{c.lower()}": F.when(F.col(column) == c, 1.0).otherwise(0.0) for c in letters})


def final_answers(df: DataFrame) -> DataFrame:
    """final_answer: the question's last valid answer; y: whether this probe's valid answer is that."""
    everything = Window.partitionBy("qid")
    last = F.max(F.when(F.col("valid"), F.struct("step", "event_id", "answer"))).over(everything)["answer"]
    df = df.withColumn("final_answer", last)
    hit = F.col("valid") & F.col("final_answer").isNotNull() & (F.col("final_answer") != "") & (F.col("answer") == F.col("final_answer"))
    return df.withColumn("y", F.coalesce(hit, F.lit(False)).cast("long"))


def early_stop_report(df: DataFrame) -> DataFrame:
    """One row: coverage of early stops, accuracy when stopped, mean stop, accuracy of the last step, blended accuracy.

    One aggregation by question, one over questions; nothing is joined.
    """
    order = F.struct("step", "event_id")
    last, hit = F.max_by("answer", order), F.min_by("answer", F.when(F.col("hit"), order))
    valid = F.max_by("answer", F.when(F.col("valid"), order))
    per = df.groupBy("qid").agg(last.alias("last_answer"), hit.alias("hit_answer"), F.min(F.when(F.col("hit"), F.col("step"))).alias("hit_step"), F.max("step").alias("last_step"), valid.alias("final_answer"))
    per = per.filter(F.col("final_answer").isNotNull())
    stopped = F.col("hit_step").isNotNull()
    right = (F.col("hit_answer") == F.col("final_answer")).cast("double")
    base = (F.col("last_answer") == F.col("final_answer")).cast("double")
    return per.agg(
        F.count("*").alias("questions"),
        F.sum(stopped.cast("long")).alias("stopped"),
        F.round(F.avg(stopped.cast("double")), 6).alias("coverage"),
        F.round(F.avg(F.when(stopped, right)), 6).alias("acc_when_stop"),
        F.round(F.avg("hit_step"), 6).alias("avg_stop"),
        F.round(F.avg(base), 6).alias("acc_last_step"),
        F.round(F.avg(F.when(stopped, right).otherwise(base)), 6).alias("acc_blended"),
    )
