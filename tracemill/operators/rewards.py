"""Rule rewards of responses, and probe slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(len(mark))


def open_reward(text: Column, early: Column, correct: Column) -> Column:
    """A quarter early stop, an eighth each for one to five stops and one pair of think tags, half accuracy; without
    the stops the early part does not count."""
    stopped = occurrences(text, "<stop>").between(1, 5)
    tagged = (occurrences(text, "<think>") == 1) & (occurrences(text, "</think>") == 1)
    return F.when(stopped, early).otherwise(0.0) / 4 + stopped.cast("double") / 8 + tagged.cast("double") / 8 + correct.cast("double") / 2


def closed_reward(text: Column, early: Column, correct: Column) -> Column:
    """The same with half of the tag part for each of final answer and think tags; text with foreign letters or wide
    gaps gets no format parts."""
    from tracemill.functions.text import foreign_letters, wide_gap

    fair = (~(foreign_letters(text) | wide_gap(text))).cast("double")
    stopped = occurrences(text, "<stop>").between(1, 5)
    final = (occurrences(text, "<final_answer>") == 1) & (occurrences(text, "</final_answer>") == 1)
    tagged = (occurrences(text, "<think>") == 1) & (occurrences(text, "</think>") == 1)
    form = (final.cast("double") + tagged.cast("double")) / 2
    return F.when(stopped, early).otherwise(0.0) / 4 + fair * stopped.cast("double") / 8 + fair * form / 8 + correct.cast("double") / 2


def tag_reward(text: Column, tags: Column, correct: Column, length: Column | None = None) -> Column:
    """Half for the form, an eighth each for markup, answer tags and accuracy, and with `length` for that.

    Form: half for one final answer (a quarter) and one pair of think tags (a quarter), half when fewer than ten characters
    follow the final answer. Markup: a half, and with `length` a half more for answer tags. Text with foreign letters or
    wide gaps gets neither.
    """
    from tracemill.functions.text import foreign_letters, wide_gap

    fair = (~(foreign_letters(text) | wide_gap(text))).cast("double")
    final = (occurrences(text, "<final_answer>") == 1) & (occurrences(text, "</final_answer>") == 1)
    short = final & (F.length(F.element_at(F.split(text, "</final_answer>", -1), -1)) < 10)
    thought = (occurrences(text, "<think>") == 1) & (occurrences(text, "</think>") == 1)
    form = (final.cast("double") + thought.cast("double")) / 4 + short.cast("double") / 2
    marked = (text.contains("<answer>") & text.contains("</answer>")).cast("double")
    markup = F.lit(0.5) if length is None else 0.5 + marked / 2
    score = fair * markup / 8 + tags / 8 + correct.cast("double") / 8 + fair * form / 2
    return score if length is None else score + length / 8


def by_source(source: Column, rules: dict[str, Column]) -> Column:
    """The rule of each source; an unknown source is an error."""
    out = F.raise_error(F.concat(F.lit("no reward for source "), F.coalesce(source, F.lit("null")))).cast("double")
    for name, rule in rules.items():
        out = F.when(source == name, rule).otherwise(out)
    return out


def number_answer(text: Column, strict: bool) -> Column:
    """The number after the last ####, or the last number at all."""
    number = r"-?[0-9][0-9.,]*"
    if strict:
        found = F.regexp_extract(text, rf"(?s)^.*#### ({number})", 1)
    else:
        found = F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(number), F.lit(0)), F.lit(-1)), F.lit(""))
    return F.nullif(F.regexp_replace(F.regexp_replace(found, ",", ""), r"\.$", ""), F.lit(""))


def think_format(text: Column) -> Column:
    """1 when exactly one </think> and no <think> stand in the text."""
    return ((occurrences(text, "</think>") == 1) & (occurrences(text, "<think>") == 0)).cast("double")


def letter_slots(df: DataFrame) -> DataFrame:
    """(row, a, b, c, d, tail) from (row, letter, logp): log-sum-exp per letter; missing letters get tail - 2.

    tail is the smallest log-probability used (-100 if there is none).
    """
    top = F.max("logp").over(Window.partitionBy("row", "letter"))
    parts = df.withColumn("m", top).groupBy("row", "letter").agg((F.max("m") + F.log(F.sum(F.exp(F.col("logp") - F.col("m"))))).alias("lse"), F.min("logp").alias("low"))
    pick = lambda x: F.max(F.when(F.col("letter") == x, F.col("lse")))
    wide = parts.groupBy("row").agg(*[pick(x).alias(x.lower()) for x in "ABCD"], F.coalesce(F.min("low"), F.lit(-100.0)).alias("tail"))
    return wide.withColumns({c: F.coalesce(c, F.col("tail") - 2) for c in "abcd"})


def chosen_step(df: DataFrame, letter: Column, coverage: Column) -> DataFrame:
    """The first step whose best token is a letter, else the last of the best coverage."""
    order = Window.partitionBy("qid").orderBy(letter.desc(), F.when(letter, F.col("step")).asc(), coverage.desc(), F.desc("step"))
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def open_slot(df: DataFrame, by: str, logp: str) -> DataFrame:
    """Sum, number, mean and population variance of the best log-probabilities of a probe; zeros when there are none."""
    x = F.when(F.abs(F.col(logp)) < float("inf"), F.col(logp))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(by).agg(zero(F.sum(x)).alias("l_sum"), F.count(x).alias("ans_len"), zero(F.avg(x)).alias("mean_logprob"), zero(F.var_pop(x)).alias("var_logprob"), (-zero(F.avg(x))).alias("neg_ppl"))
