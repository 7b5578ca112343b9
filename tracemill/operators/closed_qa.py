"""Closed questions: the thirty features of an evaluated prefix, the letter that a probe gives, and training rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracemill.functions import text as X
from tracemill.operators import trajectory as T
from tracemill.session import ship

LETTERS = ("a", "b", "c", "d")
#: Names of the features, in the order in which classifiers take them.
FEATURES = (
    *(f"cum_{c}" for c in LETTERS), "cum_margin", "run_len", "flips", "delta_recent", "slope_recent", "step_ratio", *LETTERS, *(f"p_{c}" for c in LETTERS),
    "curv_margin2", *(f"curv_{c}2" for c in LETTERS), "vel_norm", "acc_norm", "kappa", "fi_trace", "fi_lmax", "fi_offdiag", "fi_entropy",
)
#: Prefixes that curvature and the Fisher statistics look back on.
WIDE = 5


@F.pandas_udf(DoubleType())
def largest_eigenvalue(matrix: pd.Series) -> pd.Series:
    """Of symmetric 4 x 4 matrices given as arrays of 16, all of a batch at once."""
    if not len(matrix):
        return pd.Series([], dtype=float)
    return pd.Series(np.linalg.eigvalsh(np.stack(matrix.to_numpy()).reshape(-1, 4, 4))[:, -1])


def _norm(parts) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def featured(df: DataFrame) -> DataFrame:
    """All of FEATURES for prefixes (qid, step, a, b, c, d), the scores being logarithms.

    One sort by question serves every window; only the eigenvalue leaves the JVM. ln is taken of shares of at least
    1e-12, ties for the top go to the last letter, step_ratio is the prefix's number by the question's prefixes.
    """
    ship(df.sparkSession)
    w = T.per_question()
    whole = T.so_far(w)
    top = F.greatest(*[F.col(c) for c in LETTERS])
    df = df.withColumns({f"e_{c}": F.exp(F.col(c) - top) for c in LETTERS})
    total = sum((F.col(f"e_{c}") for c in LETTERS), F.lit(0.0)) + T.SMALLER
    df = df.withColumns({f"p_{c}": F.col(f"e_{c}") / total for c in LETTERS}).drop(*(f"e_{c}" for c in LETTERS))
    df = df.withColumns({f"cum_{c}": F.sum(F.log(F.greatest(F.col(f"p_{c}"), F.lit(1e-12)))).over(whole) for c in LETTERS})
    df = T.runs(T.top_letter(df, LETTERS), "cum_top", w, ("step",))
    margin = F.col("cum_margin")
    df = df.withColumns({"delta_recent": T.delta_recent(margin, w), "slope_recent": T.slope_recent(margin, w), "curv_margin2": T.curvature(margin, w)})
    df = df.withColumns({f"curv_{c}2": T.curvature(F.col(f"cum_{c}"), w) for c in LETTERS})
    df = df.withColumn("step_ratio", F.row_number().over(w) / F.count("*").over(Window.partitionBy("qid")))
    # Velocity and acceleration of the path of sums, once it has three points.
    df = df.withColumns({f"v_{c}": F.col(f"cum_{c}") - F.lag(f"cum_{c}").over(w) for c in LETTERS}).withColumns({f"s_{c}": F.col(f"v_{c}") - F.lag(f"cum_{c}").over(w) + F.lag(f"cum_{c}", 2).over(w) for c in LETTERS})
    v, a = [F.col(f"v_{c}") for c in LETTERS], [F.col(f"s_{c}") for c in LETTERS]
    square = sum((x * x for x in v), F.lit(0.0)) + T.SMALL
    along = sum((x * y for x, y in zip(a, v)), F.lit(0.0)) / square
    three = F.row_number().over(w) >= 3
    across = _norm([y - along * x for x, y in zip(v, a)]) / square
    df = df.withColumns({name: F.when(three, x).otherwise(0.0) for name, x in {"vel_norm": F.sqrt(F.greatest(square - T.SMALL, F.lit(0.0))), "acc_norm": _norm(a), "kappa": across}.items()})
    # Mean Fisher information of the last shares: p on the diagonal, less the product of any two.
    last = w.rowsBetween(1 - WIDE, Window.currentRow)
    clipped = {c: F.greatest(F.col(f"p_{c}"), F.lit(1e-12)) for c in LETTERS}
    sums = sum(clipped.values(), F.lit(0.0))
    df = df.withColumns({f"q_{c}": x / sums for c, x in clipped.items()})
    q = {c: F.col(f"q_{c}") for c in LETTERS}
    means = {f"f_{x}{y}": F.avg((q[x] if x == y else F.lit(0.0)) - q[x] * q[y]).over(last) for i, x in enumerate(LETTERS) for y in LETTERS[i:]}
    df = df.withColumns(means).withColumn("fi_entropy", F.avg(-sum((x * F.log(x + T.SMALLER) for x in q.values()), F.lit(0.0))).over(last))
    cell = lambda x, y: F.col(f"f_{min(x, y)}{max(x, y)}")
    df = df.withColumn("fi_trace", sum((cell(x, x) for x in LETTERS), F.lit(0.0))).withColumn("fi_offdiag", _norm([cell(x, y) for x in LETTERS for y in LETTERS if x != y]))
    df = df.withColumn("fi_lmax", largest_eigenvalue(F.array(*[cell(x, y) for x in LETTERS for y in LETTERS])))
    return df.drop(*means, *(f"{k}_{c}" for k in "vsq" for c in LETTERS))


def picked(text: Column) -> Column:
    """A to D by the strong pattern, else the first letter by itself; null if there is none."""
    one = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.upper(F.coalesce(one(X.STRONG), one(X.SOFT)))


def probe_letter(first: Column, second: Column, text: Column, hint: Column) -> Column:
    """struct<letter, eligible>: the letter of the best token, else of the next, the text, or the hint if it is one."""
    letter = F.coalesce(picked(first), picked(second), picked(F.coalesce(text, F.lit(""))), F.when(hint.isin("A", "B", "C", "D"), hint))
    return F.struct(letter.alias("letter"), letter.isNotNull().alias("eligible"))


def training_rows(df: DataFrame, predicted: str, final: str) -> DataFrame:
    """(qid, k, m, gold, pred, y, x): the features of each prefix in order, and whether its letter is the final one."""
    df = featured(df)
    gold, said = F.upper(F.coalesce(F.col(final), F.lit(""))), F.upper(F.col(predicted))
    y = F.coalesce((gold != "") & (said != "") & (said == gold), F.lit(False)).cast("long")
    k = F.row_number().over(T.per_question()).cast("long")
    return df.select("qid", k.alias("k"), F.count("*").over(Window.partitionBy("qid")).alias("m"), gold.alias("gold"), F.col(predicted).alias("pred"), y.alias("y"), F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x"))
