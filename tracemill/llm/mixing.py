"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in order of size (then id). Each is expected target / source_size
times in the mix; the expectations are summed along that order from one offset that a hash of the source
and the seed gives, and a document is emitted once for each integer that its step crosses. As neighbours
in the order are of nearly the same size, the words taken come within about the largest document of the
target.

Sources are few: their sizes and targets are one row each, and one task shares them out. The prefix sum needs no task that sees a whole source: rows are range-partitioned by (source, size, id),
each partition counts its rows by source, and a rank is the count in earlier partitions plus the rank
in its own.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a source whose
size is 0 has target 0 and none of it is taken; rows that repeat an id are separate documents; an empty
table gives no rows; columns besides the used ones are ignored by plan() and kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.shared import WORD, materialise, partitions, release

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target: shares by weight; what exceeds most x size is shared anew.

    Of all levels (words per unit of weight) that assume the k sources of the smallest size per weight to
    be at their ceiling, the greatest is where sharing anew comes to rest. One row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ceiling = F.lit(most) * F.col("source_size")
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("weight", weight)
        .withColumn("ceiling", ceiling)
        .withColumn("level", level)
        .withColumn("target", F.least("ceiling", F.col("weight") * F.max("level").over(everything)))
        .select("source", "source_size", "target")
    )


def plan(docs: DataFrame, key: str = "doc_id", seed: str = SEED, used: list | None = None, **ratio) -> DataFrame:
    """(key, tie, source, size, source_size, target, copies) of each document; tie tells rows of one key apart. The table
    that the result reads is added to `used`."""
    n = partitions(docs.sparkSession)
    sizes = materialise(docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("tie"), "source", word_count(F.col("text")).alias("size")), "sizes")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("key"), F.col("tie")]
    ranged = materialise(sizes.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    release(sizes)
    if used is not None:
        used.append(ranged)
    by_part = ranged.groupBy("part", "source").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(F.col("part").alias("o_part"), F.col("source").alias("o_source"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    shares = targets(ranged.groupBy("source").agg(F.sum("size").alias("source_size")), **ratio)
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))), 1, 8)
    start = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    inside = Window.partitionBy("part", "source").orderBy("size", "key", "tie")
    shares = shares.select(F.col("source").alias("s_source"), "source_size", "target", start.alias("start"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    ranked = (
        ranged.withColumn("rank", F.row_number().over(inside))
        .join(offsets, (F.col("part") == F.col("o_part")) & F.col("source").eqNullSafe(F.col("o_source")))
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .join(shares, F.col("source").eqNullSafe(F.col("s_source")))
    )
    copies = F.floor(F.col("start") + F.col("rate") * F.col("rank")) - F.floor(F.col("start") + F.col("rate") * (F.col("rank") - 1))
    return ranked.select("key", "tie", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", seed: str = SEED, **ratio) -> DataFrame:
    """The mix itself: every row of docs as often as its copies say, columns unchanged.

    Rows that agree in key, source and text get the copies of their number among them, which goes by a hash of all
    columns, so that reruns agree.
    """
    used: list[DataFrame] = []
    planned = plan(docs, key, seed, used, **ratio).select(F.col("key").alias("_tm_key"), F.col("tie").alias("_tm_tie"), F.col("source").alias("_tm_source"), F.col("copies").alias("_tm_copies"))
    counts = planned.groupBy("_tm_key", "_tm_tie", "_tm_source").agg(F.sort_array(F.collect_list("_tm_copies")).alias("_tm_copies"))
    counts = materialise(counts, "copies")
    release(*used)
    twin = Window.partitionBy(F.col(key), F.xxhash64("text"), F.col("source")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    numbered = docs.withColumn("_tm_row", F.row_number().over(twin))
    same = F.col(key).eqNullSafe(F.col("_tm_key")) & (F.xxhash64("text") == F.col("_tm_tie")) & F.col("source").eqNullSafe(F.col("_tm_source"))
    joined = numbered.join(counts, same).withColumn("_tm_times", F.element_at("_tm_copies", F.col("_tm_row")).cast("int"))
    return joined.filter("_tm_times > 0").withColumn("_tm_each", F.explode(F.sequence(F.lit(1), F.col("_tm_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight,
    2.0::DOUBLE * source_size AS ceiling FROM sources
), levelled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), shares AS (
  SELECT source, source_size, least(ceiling, weight * max(level) OVER ()) AS target,
    ('0x' || substr(md5('mix-1' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start FROM levelled
), ranked AS (
  SELECT s.doc_id, s.size, h.source_size, h.target, h.start, CASE WHEN h.source_size > 0 THEN h.target / h.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rank
  FROM sizes s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, target, ((floor(start + rate * rank) - floor(start + rate * (rank - 1))) * size)::BIGINT AS taken FROM ranked
"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": OP5_SQL}
