"""Early-stop classifiers on feature columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features count as 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def fit(df: DataFrame, features: list[str], label: str, trees: bool = False, seed: int = 42) -> PipelineModel:
    model = GBTClassifier(labelCol=label, maxIter=40, maxDepth=6, stepSize=0.07, subsamplingRate=0.9, seed=seed) if trees else LogisticRegression(labelCol=label, maxIter=50, regParam=1e-4)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(assembled(df, features))


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(assembled(df, features))
    return out.withColumn("prob", probability(out)).drop("features", "rawPrediction", "probability", "prediction")


def probability(scored: DataFrame) -> Column:
    """The probability of class 1: as the model gives it, else from its margin, else its prediction."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in scored.columns:
        return 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return F.col("prediction").cast("double")


class Boosted:
    """Regression trees whose values, times a rate, add up to a margin; more can be added at any time."""

    def __init__(self, features: list[str], trees: list, rate: float):
        self.features, self.trees, self.rate = features, trees, rate

    def margin(self, df: DataFrame) -> DataFrame:
        out = VectorAssembler(inputCols=self.features, outputCol="__features").transform(assembled(df, self.features)).withColumn("__margin", F.lit(0.0))
        for tree in self.trees:
            out = tree.transform(out).withColumn("__margin", F.col("__margin") + self.rate * F.col("__tree")).drop("__tree")
        return out


def boost(df: DataFrame, features: list[str], label: str, rounds: int, model: Boosted | None = None, depth: int = 4, rate: float = 0.3, seed: int = 42) -> Boosted:
    """`rounds` more trees on what the model so far leaves of the labels, given these rows; without a model, a new one."""
    model = model or Boosted(features, [], rate)
    for i in range(rounds):
        rows = model.margin(df).withColumn("__rest", F.col(label) - 1 / (1 + F.exp(-F.col("__margin"))))
        tree = DecisionTreeRegressor(featuresCol="__features", labelCol="__rest", predictionCol="__tree", maxDepth=depth, seed=seed + i)
        model = Boosted(model.features, [*model.trees, tree.fit(rows)], model.rate)
    return model


def boosted_score(model: Boosted, df: DataFrame) -> DataFrame:
    return model.margin(df).withColumn("prob", 1 / (1 + F.exp(-F.col("__margin")))).drop("__features", "__margin")


def fit_or_load(df: DataFrame, features: list[str], label: str, path: str, force: bool = False) -> PipelineModel:
    """The saved model, unless there is none or a new one is forced."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return PipelineModel.load(path)
    model = fit(df, features, label)
    model.write().overwrite().save(path)
    return model
