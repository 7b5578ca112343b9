"""Pipeline over documents: toxic texts go, near copies go, personal data is sanitised, sources are mixed, texts are
encoded. Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read
again as the docs of the next. All stages but the last return the columns of documents.

1. toxicity: a model learnt from labels (of documents that are not held out) rejects texts of score >= 0.7.
2. near_copies: of each component of documents whose sets of 5-word shingles have a Jaccard similarity of at least
   0.8, the one with the smallest id stays.
3. pii: personal data and terms that disclose it are replaced; n_chars is the new length.
4. mixing: each document as often as systematic sampling of its source says.
5. pieces: token ids of each text, with their number and digest and whether they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import jaccard, mixing, pieces, pii, toxicity
from tracemill.llm.shared import materialise, prepare, release

SHINGLE, NUM, DEN = 5, 80, 100


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, model, *docs.columns, out="_tm_score")
    return scored.filter(F.col("_tm_score") < toxicity.THRESHOLD).drop("_tm_score")


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.keep_one(docs, width=SHINGLE, num=NUM, den=DEN)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.digests(docs, "doc_id", "lang", "source")


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_copies", stage_near_copies),
    ("pii", stage_pii),
    ("mixing", stage_mixing),
    ("pieces", stage_pieces),
]

#: Learnt scores, link graphs and token ids are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            release(before)
    return stage_pieces(spark, docs, sf_dir)
