"""URL filter rules: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule is (host, path, verdict). It fits its host and all subdomains of it when the URL's path starts with the
rule's path; of the fitting rules the longest (host and path together) decides, then the longer host, then
block over allow. Each distinct (host, path) of the pages is expanded into its host suffixes times its path
prefixes of the lengths that rules have; the expressions meet the rules in an equi-join on the first bytes of
their digest, and only those whose full digest agrees count.

Edge cases: a null URL or one without "://" has an empty host and an empty path and fits no rule; an empty
host has no suffixes; URLs that no rule fits get the default verdict; repeated pages each get their row;
empty pages or empty rules give no rows, or the default for each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
#: Hex digits of the digest that the join compares; a false meeting is refuted by the full digest.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rules_table(spark: SparkSession, rules) -> DataFrame:
    rows = [F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for host, path, verdict in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict added; rules: (host, path, verdict)."""
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), digest(F.col("host"), F.col("path")).alias("r_digest"))
    # Two rules for one expression: block wins.
    rules = rules.groupBy("r_host", "r_path", "r_digest").agg(F.max("r_verdict").alias("r_verdict")).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    # At most one number per possible path length, gathered by a global aggregate that one row leaves.
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"))
    seen = pages.select(host_of(F.col(url)).alias("_tm_host"), path_of(F.col(url)).alias("_tm_path")).distinct()
    labels = F.split("_tm_host", r"\.", -1)
    suffixes = F.when(F.col("_tm_host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    fitting = F.filter("lengths", lambda n: n <= F.length("_tm_path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("_tm_path"), F.lit(1), n))
    expressions = (
        seen.join(F.broadcast(lengths))  # one row
        .select("_tm_host", "_tm_path", F.explode(suffixes).alias("e_host"), prefixes.alias("prefixes"))
        .select("_tm_host", "_tm_path", "e_host", F.explode("prefixes").alias("e_path"))
        .withColumn("e_digest", digest(F.col("e_host"), F.col("e_path")))
        .withColumn("e_short", F.substring("e_digest", 1, SHORT))
    )
    met = expressions.join(rules, F.col("e_short") == F.col("r_short")).filter("e_digest = r_digest")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict"))
    best = met.groupBy("_tm_host", "_tm_path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("_tm_best"))
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    return (
        out.join(best, (F.col("host") == F.col("_tm_host")) & (F.col("path") == F.col("_tm_path")), "left")
        .withColumn("rule", F.col("_tm_best.rule"))
        .withColumn("verdict", F.coalesce(F.col("_tm_best.verdict"), F.lit(default)))
        .drop("_tm_host", "_tm_path", "_tm_best")
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

QUERIES = {"op8_url_rules": op8_url_rules}
ORACLES = {"op8_url_rules": OP8_SQL}
