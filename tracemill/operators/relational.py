"""Row operators of batches: selection, positional joins, folding, padding, ranking.

A batch has no order of its own in Spark: where position matters, `row` is an explicit 0-based column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that a table is numbered in, at most.
RANGES = 256


def numbered(df: DataFrame, *order: str, within: tuple[str, ...] = (), name: str = "row") -> DataFrame:
    """df with a 0-based position by order, within groups if any.

    Without groups the order's values are cut into ranges at bounds taken from a bounded sample (the rows of the smallest
    hashes); a position is the rows of earlier ranges plus the place in its own, so no task sorts the whole table.
    The bounds are literals: every evaluation of the plan cuts alike.
    """
    if within:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long"))
    ranges = min(RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*order)
    sample = sorted(keys.orderBy(F.xxhash64(*order), *order).limit(20 * ranges).collect(), key=lambda r: [(v is not None, v) for v in r])
    bounds = sorted({int(i * len(sample) / ranges) for i in range(1, ranges)}) if sample else []
    kinds = [f.dataType for f in keys.schema]
    cuts = [F.struct(*[F.lit(v).cast(kind).alias(c) for v, kind, c in zip(sample[i], kinds, order)]) for i in bounds]
    key = F.struct(*[F.col(c) for c in order])
    part = F.size(F.filter(F.array(*cuts), lambda cut: key >= cut)) if cuts else F.lit(0)
    placed = df.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # RANGES rows at most
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn("__in", inside).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__part", "__in", "__before")


def pop(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the popped columns, the rest)."""
    return df.select(*columns), df.drop(*columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def zip_join(left: DataFrame, right: DataFrame, key: str = "row") -> DataFrame:
    """Union of columns by position: both need the same positions, and equal values in columns they share."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    joined = left.withColumn("__l", F.lit(True)).join(renamed.withColumn("__r", F.lit(True)), key, "full")
    fits = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    for c in shared:
        fits = fits & F.col(c).eqNullSafe(F.col(f"__{c}"))
    checked = joined.withColumn("__ok", F.when(~fits, F.raise_error(F.lit("tables differ in positions or shared columns"))).otherwise(True))
    return checked.filter("__ok").drop("__l", "__r", "__ok", *[f"__{c}" for c in shared])


def overwrite(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """df with the column replaced where updates has the key."""
    new = updates.select(key, F.col(column).alias("__new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def reorder(df: DataFrame, index: DataFrame, key: str = "row") -> DataFrame:
    """Rows of df in the positions that index (old, new) gives them."""
    return df.join(index.withColumnRenamed("old", key), key).drop(key).withColumnRenamed("new", key)


def chunks(df: DataFrame, count: int, total: int, key: str = "row") -> DataFrame:
    """chunk: which of `count` equal parts a row is in; total must divide."""
    if total % count:
        raise ValueError(f"{total} rows do not divide into {count} chunks")
    return df.withColumn("chunk", F.floor(F.col(key) / F.lit(total // count)))


def repeat(df: DataFrame, times: int, total: int, interleave: bool = True, key: str = "row") -> DataFrame:
    """Each row `times` times: copies next to each other, or one whole table after another."""
    copies = df.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    place = F.col(key) * times + F.col("__copy") if interleave else F.col("__copy") * total + F.col(key)
    return copies.withColumn(key, place).drop("__copy")


def pad_to_divisor(df: DataFrame, divisor: int, total: int, key: str = "row") -> DataFrame:
    """Rows from the start again until the number of rows divides."""
    missing = -total % divisor
    if not total or not missing:
        return df
    rounds = df.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit((missing - 1) // total))))
    rounds = rounds.withColumn("__at", F.col("__at") * F.lit(total) + F.col(key))
    return df.unionByName(rounds.filter(F.col("__at") < missing).withColumn(key, F.col("__at") + total).drop("__at"))


def top(df: DataFrame, k: int, by: list[Column], within: list[str]) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*within).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def padded(values: Column, length: int, fill, left: bool = False) -> Column:
    """An array cut or filled to a length, at the right or left."""
    lack = F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(values), F.lit(0)))
    whole = F.concat(lack, values) if left else F.concat(values, lack)
    return F.slice(whole, F.greatest(F.size(whole) - length + 1, F.lit(1)), length) if left else F.slice(whole, 1, length)


def transposed(df: DataFrame, row: str, column: str, value: str, block: int) -> DataFrame:
    """(column, block, values): for each column its values by row, `block` rows at a time, so that no array grows with
    the table."""
    parts = df.groupBy(column, F.floor(F.col(row) / F.lit(block)).alias("block")).agg(F.array_sort(F.collect_list(F.struct(row, value))).alias("__v"))
    return parts.select(column, "block", F.transform("__v", lambda x: x[value]).alias("values"))


def paired(left: DataFrame, right: DataFrame, by_left: str, by_right: str) -> DataFrame:
    """Rows of both side by side: one against all, or equally many by position; other numbers are an error."""
    n, m = left.count(), right.count()
    if n not in (1, m):
        raise ValueError(f"{n} rows cannot be paired with {m}")
    if n == 1:
        return F.broadcast(left).join(right)
    return numbered(left, by_left, name="__at").join(numbered(right, by_right, name="__at"), "__at").drop("__at")
