"""Saved models (SNK3, SRC8): each save is a new version folder, and one appended row makes it current.

    <path>/<task>/versions/<version>/{info, table, scaling, large/<n>}
    <path>/<task>/current            one row (seq, version, method, settings, features, large) per save

The row is appended after the version is complete and its file appears as a whole, so a reader between two
saves gets the models, thresholds and scaling of one save, never a mixture. Old versions stay readable.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.operators.forecasting.methods import Method
from gridcast.operators.forecasting.regional import RegionalModels

CURRENT = "seq bigint, version string, method string, settings string, features array<string>, large array<string>, scaled boolean"

_MODEL_CLASSES = {
    "rf_regressor": RandomForestRegressionModel,
    "gbt_regressor": GBTRegressionModel,
    "rf_classifier": RandomForestClassificationModel,
    "gbt_classifier": GBTClassificationModel,
}


def versions(spark: SparkSession, path: str, task: str) -> DataFrame:
    """All saves of a task, newest first; none where nothing was saved."""
    try:
        return spark.read.schema(CURRENT).parquet(f"{path}/{task}/current").orderBy(F.col("seq").desc(), F.col("version").desc())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CURRENT)


def save_models(fitted: RegionalModels, path: str, spark: SparkSession, region: str = "region") -> DataFrame:
    """SNK3: write the models of a task as a new version below ``path``, make it current, return its registry."""
    newest = versions(spark, path, fitted.task).first()
    seq = 1 + (newest["seq"] if newest else 0)
    version = f"{seq:08d}-{uuid.uuid4().hex}"
    base = f"{path}/{fitted.task}/versions/{version}"
    fitted.info.write.parquet(f"{base}/info")
    if fitted.table is not None:
        fitted.table.write.parquet(f"{base}/table")
    if fitted.stats is not None:
        fitted.stats.write.parquet(f"{base}/scaling")
    # Zone names are values of any kind: the row keeps them as JSON, in the order of the folders.
    for i, model in enumerate(fitted.models.values()):
        model.write().save(f"{base}/large/{i}")
    row = (
        seq, version, fitted.method.name, json.dumps(dataclasses.asdict(fitted.method)), fitted.features,
        [json.dumps(z) for z in fitted.models], fitted.stats is not None,
    )
    spark.createDataFrame([row], CURRENT).coalesce(1).write.mode("append").parquet(f"{path}/{fitted.task}/current")
    return read_registry(spark, path, fitted.task, region)


def _current(spark: SparkSession, path: str, task: str, version: str | None):
    known = versions(spark, path, task)
    row = (known if version is None else known.where(F.col("version") == version)).first()
    if row is None:
        raise ValueError(f"no models of {task} below {path}" + (f" in version {version}" if version else ""))
    return row, f"{path}/{task}/versions/{row['version']}"


def read_registry(spark: SparkSession, path: str, task: str, region: str = "region", version: str | None = None) -> DataFrame:
    """One row per zone of the current (or the named) version: task, zone, version, method, settings, features,
    threshold, scale_pos_weight."""
    row, base = _current(spark, path, task, version)
    constant = [F.lit(v).alias(k) for k, v in (("version", row["version"]), ("method", row["method"]), ("settings", row["settings"]))]
    features = F.array(*[F.lit(f) for f in row["features"]]).alias("features")
    return spark.read.parquet(f"{base}/info").select(F.lit(task).alias("task"), region, *constant, features, "threshold", "scale_pos_weight")


def load_models(spark: SparkSession, path: str, task: str, version: str | None = None) -> RegionalModels:
    """SRC8: the models of one task with their features, thresholds and weights, all of one version."""
    row, base = _current(spark, path, task, version)
    method = Method(**json.loads(row["settings"]))
    out = RegionalModels(task, method, list(row["features"]))
    out.info = spark.read.parquet(f"{base}/info")
    out.table = spark.read.parquet(f"{base}/table")
    if row["scaled"]:
        out.stats = spark.read.parquet(f"{base}/scaling")
    for i, zone in enumerate(row["large"]):
        out.models[json.loads(zone)] = _MODEL_CLASSES[method.kind].load(f"{base}/large/{i}")
    return out
