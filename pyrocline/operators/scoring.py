"""Linear classification of clusters."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocline.operators.clusters import FEATURES


@dataclass(frozen=True)
class Linear:
    """Weights in the order of FEATURES, and the intercept."""

    weights: tuple[float, ...]
    intercept: float

    def margin_sql(self) -> str:
        """The decision function as SQL."""
        return " + ".join([*(f"{w!r} * {n}" for w, n in zip(self.weights, FEATURES, strict=True)), repr(self.intercept)])


def load(spark: SparkSession, path: str) -> Linear:
    """Read a model from JSON ``{"weights": [8 numbers], "intercept": number}``; a model is never unpickled."""
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if len(found["weights"]) != len(FEATURES):
        raise ValueError(f"a model has {len(FEATURES)} weights")
    return Linear(tuple(map(float, found["weights"])), float(found["intercept"]))


def predict(clusters: DataFrame, model: Linear) -> DataFrame:
    """``clusters`` with ``model_prediction``: wildfire for class 0, manmade for any other."""
    margin = sum((F.lit(w) * F.col(n) for w, n in zip(model.weights[1:], FEATURES[1:], strict=True)), F.lit(model.weights[0]) * F.col(FEATURES[0])) + F.lit(model.intercept)
    return clusters.withColumn("model_prediction", F.when(margin > 0, "manmade").otherwise("wildfire"))


def train(clusters: DataFrame, target: str, rounds: int = 50, penalty: float = 0.01) -> Linear:
    """A linear support vector classifier of ``target`` (0 or 1) over FEATURES."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="inputs", handleInvalid="skip").transform(clusters)
    model = LinearSVC(featuresCol="inputs", labelCol=target, maxIter=rounds, regParam=penalty).fit(rows)
    return Linear(tuple(float(x) for x in model.coefficients), float(model.intercept))
