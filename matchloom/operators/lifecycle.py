"""The life of a ranker model: retraining, versions, a registry, promotion, and what is known of the model in use."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranker

# Fixed value: the name in the metadata.
MODEL_NAME = "candidate_matcher"


def dataset_digest(rows: DataFrame) -> str:
    """SHA-256 over the sums of the rows' hashes: the same rows give the same digest in any order and on any partitioning,
    and no row leaves its task."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)"))
    sums = rows.agg(F.count("*").alias("n"), *[part(k).alias(f"s{k}") for k in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in sums.columns]), 256)).first()[0]


def _put(spark: SparkSession, value: dict, path: str, mode: str) -> None:
    spark.range(1).select(F.lit(json.dumps(value)).alias("value")).coalesce(1).write.mode(mode).text(path)


def _get(spark: SparkSession, path: str) -> list[dict]:
    """JSON lines; none where nothing has been written."""
    try:
        return [json.loads(r.value) for r in spark.read.text(path).collect()]
    except AnalysisException:
        return []


def retrain(rows: DataFrame, key: str, folder: str, version: str, trained_at: str, dataset_version: str | None = None, query: str | None = None, promote: str = "always", metric: str = "roc_auc") -> dict:
    """Fits a model, saves it under its version with its metrics, and adds a row to the registry. ``promote``: ``always``,
    ``never``, or ``better`` (its metric is not below that of the model in use). Returns the metrics record. Versions are
    folders that are written once; the model in use is named by a pointer, so promotion copies nothing."""
    spark = rows.sparkSession
    model, metrics = ranker.train(rows, key, query=query)
    path = f"{folder}/versions/{version}"
    record = metrics | {"model_name": MODEL_NAME, "model_version": version, "trained_at_utc": trained_at, "dataset_version": dataset_version, "dataset_sha256": dataset_digest(rows), "artifact_path": path}
    ranker.save(spark, model, record, path, version)
    in_use = model_info(spark, folder)
    promoted = promote == "always" or (promote == "better" and ranker.better(record, in_use["metrics"] or None, metric))
    if promoted:
        _put(spark, {"model_version": version, "artifact_path": path}, f"{folder}/latest", "overwrite")
    _put(spark, {"model_version": version, "trained_at_utc": trained_at, "artifact_path": path, "metrics_path": f"{path}/meta", "promoted_to_latest": promoted}, f"{folder}/registry", "append")
    return record | {"promoted_to_latest": promoted}


def registry(spark: SparkSession, folder: str) -> list[dict]:
    """All versions, in the order of their training."""
    return sorted(_get(spark, f"{folder}/registry"), key=lambda r: (r["trained_at_utc"], r["model_version"]))


def load_latest(spark: SparkSession, folder: str) -> PipelineModel | None:
    """The model in use; none where there is none or it can't be read."""
    latest = _get(spark, f"{folder}/latest")
    try:
        return ranker.load(spark, latest[0]["artifact_path"])[0] if latest else None
    except (AnalysisException, Py4JJavaError):
        return None


def model_info(spark: SparkSession, folder: str) -> dict:
    """What is known of the model in use: whether it exists and can be loaded, its metadata, data set, time and metrics."""
    latest = _get(spark, f"{folder}/latest")
    meta = _get(spark, f"{latest[0]['artifact_path']}/meta") if latest else []
    metrics = meta[0]["metrics"] if meta else {}
    numbers = {k: v for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    return {
        "artifact_exists": bool(meta),
        "model_loaded": bool(meta) and load_latest(spark, folder) is not None,
        "metadata": {"model_name": MODEL_NAME, "model_version": metrics.get("model_version"), "features": meta[0]["features"] if meta else []},
        "dataset_version": metrics.get("dataset_version"),
        "trained_at_utc": metrics.get("trained_at_utc"),
        "metrics": numbers,
    }
