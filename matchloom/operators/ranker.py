"""The learned ranker: standardised features, class-balanced logistic regression, metrics and a saved artifact."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.scoring import FEATURES

from .metrics import classification, curve_areas, ranking_metrics, stratified_split


def train(rows: DataFrame, key: str, label: str = "label", query: str | None = None, features: Sequence[str] = FEATURES, k: int = 10, valid: float = 0.2, seed: int = 42) -> tuple[PipelineModel, dict]:
    """(model, metrics on the validation part). Classes weigh the same in the fit; the split is by key, so it repeats."""
    parts = stratified_split(rows, F.col(key), label, valid, seed).cache()
    fitted_on = parts.where("split = 'train'")
    n = {r[label]: r["n"] for r in fitted_on.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(n) != 2:
        raise ValueError("both labels are needed to train")
    total = sum(n.values())
    weighted = fitted_on.withColumn("weight_", F.when(F.col(label) == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0])))
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_", handleInvalid="keep"), StandardScaler(inputCol="raw_", outputCol="x_", withMean=True), LogisticRegression(featuresCol="x_", labelCol=label, weightCol="weight_", regParam=1.0 / total, maxIter=200, probabilityCol="prob_", rawPredictionCol="margin_", predictionCol="said_")]
    model = Pipeline(stages=stages).fit(weighted)
    scored = predict(model, parts.where("split = 'valid'")).cache()
    metrics = {"train_rows": total, "valid_rows": scored.count()} | curve_areas(scored.select("score", F.col(label).alias("label"))).first().asDict() | classification(scored.select("score", F.col(label).alias("label"))).first().asDict()
    if query:
        metrics |= ranking_metrics(scored.select(F.col(query).alias("query"), F.col(key).alias("key"), "score", F.col(label).alias("label")), k).first().asDict()
    scored.unpersist()
    parts.unpersist()
    return model, metrics


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with ``score``, the probability of label 1."""
    return model.transform(rows).withColumn("score", vector_to_array("prob_")[1]).drop("raw_", "x_", "prob_", "margin_", "said_")


def coefficients(model: PipelineModel, features: Sequence[str] = FEATURES) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """(coefficients, means, deviations) by feature, for contributions."""
    scaler, lr = model.stages[1], model.stages[2]
    return tuple(dict(zip(features, map(float, v), strict=True)) for v in (lr.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray()))


def save(spark: SparkSession, model: PipelineModel, metrics: dict, path: str, version: str) -> None:
    """The model and a JSON file beside it, with the version, the features and the metrics."""
    model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"version": version, "features": list(FEATURES), "metrics": metrics})
    spark.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first().value)


def better(new: dict, old: dict | None, metric: str = "roc_auc") -> bool:
    """Whether a retrained model is to be promoted."""
    return old is None or (new.get(metric) or 0.0) >= (old.get(metric) or 0.0)
