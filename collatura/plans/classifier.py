"""Classifiers of false positives on pair features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.operators.features import ALL_FEATURES

KINDS = {
    "random_forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=6, seed=7),
    "gradient_boosting": lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=7),
    "logistic_regression": lambda: LogisticRegression(maxIter=50, regParam=0.01),
}


class FalsePositiveClassifier:
    """One of three classifiers over the features named; label 1 is a false positive."""

    def __init__(self, kind: str = "random_forest", features: tuple[str, ...] = ALL_FEATURES):
        self.kind, self.features = kind, features
        self.model: PipelineModel | None = None

    def fit(self, rows: DataFrame, label: str = "label") -> FalsePositiveClassifier:
        stages = [VectorAssembler(inputCols=list(self.features), outputCol="_features", handleInvalid="keep"), KINDS[self.kind]().setFeaturesCol("_features").setLabelCol("_label")]
        self.model = Pipeline(stages=stages).fit(rows.withColumn("_label", F.col(label).cast("double")))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability`` of a false positive and ``predicted``."""
        out = self.model.transform(rows.withColumn("_label", F.lit(0.0)))
        out = out.withColumns({"_p": F.element_at(vector_to_array("probability"), 2), "predicted": F.col("prediction").cast("int")})
        return out.drop("_features", "_label", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", "probability")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, kind: str = "random_forest", features: tuple[str, ...] = ALL_FEATURES) -> FalsePositiveClassifier:
        out = cls(kind, features)
        out.model = PipelineModel.load(path)
        return out


def split(rows: DataFrame, *keys: str, test_share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the keys, so that a pair never falls on both sides."""
    part = F.pmod(F.xxhash64(*keys), F.lit(1000)) < int(test_share * 1000)
    return rows.where(~part), rows.where(part)


def accuracy(predicted: DataFrame, label: str = "label") -> float:
    rows = predicted.select(F.col(label).cast("double").alias("label"), F.col("predicted").cast("double").alias("prediction"))
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(rows)


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))
