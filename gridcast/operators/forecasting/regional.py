"""One model per zone: fitting and scoring all zones of a table.

Models are tables with one row per zone (linear, logistic) or per zone and tree, fitted for all zones by one
chain of jobs, and scoring joins them. Only a zone with more rows than one task may hold gets a Spark ML
ensemble of its own; the driver loops over those zones, of which there are few, as each is large.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.base import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridcast.operators.aggregates import class_weights
from gridcast.operators.evaluation import FN_COST, scaling_stats, standardize_by_region
from gridcast.operators.forecasting.linear import fit_ols, interaction_frame, predict_ols
from gridcast.operators.forecasting.logistic import fit_logistic, predict_logistic
from gridcast.operators.forecasting.methods import Method
from gridcast.operators.forecasting.trees import LOCAL_ROWS, fit_trees, score_trees
from gridcast.operators.relational import broadcast_if_small, drop_null_subset
from gridcast.session import written

NO_ROWS = "no complete training row"


@dataclass
class RegionalModels:
    """Fitted models of one task and method.

    ``table`` holds models as rows; ``models`` the Spark models of zones too large for one task; ``stats``
    scaling values; ``info`` (region, threshold, scale_pos_weight) the numbers that belong to a zone's
    model; ``skipped`` (region, reason) the zones of the training rows that have no model.
    """

    task: str
    method: Method
    features: list[str]
    table: DataFrame | None = None
    models: dict[object, Model] = field(default_factory=dict)
    stats: DataFrame | None = None
    info: DataFrame | None = None
    skipped: DataFrame | None = None

    def zones(self, region: str = "region") -> DataFrame:
        """The zones that have a model."""
        return self.info.select(region)


def stage_by_region(df: DataFrame, region: str = "region") -> DataFrame:
    """Write the rows once, in the order of their zones, and read them back.

    The rebalance hint gathers a zone's rows in few files, but splits a zone that is too large for one
    task; the order lets a scan for one zone skip the others. One table, however many zones there are.
    """
    return written(df.hint("rebalance", F.col(region)).sortWithinPartitions(region), "by-region")


def class_weight_column(weights: str, label: str) -> Column:
    """Row weight from the columns of :func:`class_weights`."""
    positive = {
        "balanced": F.col("balanced_pos"),
        "pos": F.col("pos_weight"),
        "cost": F.lit(float(FN_COST)),
        "cost_pos": F.col("cost_pos_weight"),
    }[weights]
    negative = F.col("balanced_neg") if weights == "balanced" else F.lit(1.0)
    return F.when(F.col(label) == 1, F.coalesce(positive, F.lit(1.0))).otherwise(F.coalesce(negative, F.lit(1.0)))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def fit_regional(
    train: DataFrame,
    method: Method,
    features: Sequence[str],
    label: str,
    task: str,
    region: str = "region",
    parallel: int = 4,
    on_error: str = "raise",
    local_rows: int = LOCAL_ROWS,
) -> RegionalModels:
    """Fit ``method`` for every zone of ``train``, which should be a written table.

    A fit that fails is an error; with ``on_error="skip"`` its zone is left out and noted in ``skipped``
    with the reason. A zone without any complete row cannot be fitted and is always noted there.
    """
    out = RegionalModels(task, method, list(features))
    zones = train.select(region).where(F.col(region).isNotNull()).distinct()
    if method.kind == "ols":
        frame, out.features = interaction_frame(train)
        out.table = written(fit_ols(frame, out.features, label, region), "linear")
        return _described(out, zones, out.table.select(region), None, region)

    rows, weight, balance = drop_null_subset(train, [*features, label]), None, None
    if method.classifier:
        balance = written(class_weights(rows, label, [region], FN_COST), "balance")
    if method.scaled:
        out.stats = written(scaling_stats(rows, features, region), "scaling")
        rows = standardize_by_region(rows, out.stats, features, region)
    if method.weights != "none":
        weight = "class_weight"
        rows = rows.join(broadcast_if_small(balance), region).withColumn(weight, class_weight_column(method.weights, label))
    rows = rows.where(F.col(region).isNotNull()).select(region, *features, label, *([weight] if weight else []))

    if method.kind == "logistic":
        rows = written(rows, "logistic-rows")
        out.table = fit_logistic(rows, features, label, weight, region, max_iter=min(method.trees, 100))
        return _described(out, zones, out.table.select(region), balance, region)

    rows = stage_by_region(rows, region)
    sizes = written(rows.groupBy(region).agg(F.count(F.lit(1)).alias("n")), "sizes")
    # Few by construction: each of these zones has more than local_rows rows.
    large = sorted(r[0] for r in sizes.where(F.col("n") > local_rows).select(region).collect())
    small = rows.where(~F.col(region).isin(*large)) if large else rows
    fitted = written(fit_trees(small, method, features, label, region, weight), "trees")
    failed = fitted.where(F.col("error").isNotNull()).groupBy(region).agg(F.min("error").alias("reason"))
    out.table = fitted.join(failed, region, "left_anti").drop("error")

    def fit_one(zone):
        return method.estimator(label).fit(_assembled(rows.where(F.col(region) == zone), features))

    with ThreadPoolExecutor(parallel) as pool:
        fits = {z: pool.submit(fit_one, z) for z in large}
    errors = {z: str(f.exception()) for z, f in fits.items() if f.exception() is not None}
    out.models = {z: f.result() for z, f in fits.items() if z not in errors}
    if errors:
        kind = rows.schema[region].dataType.simpleString()
        failed = failed.unionByName(rows.sparkSession.createDataFrame(list(errors.items()), f"`{region}` {kind}, reason string"))
    if on_error != "skip" and (first := failed.orderBy(region).first()):
        raise RuntimeError(f"{method.name} of {task} could not be fitted for zone {first[region]}: {first['reason']}")
    return _described(out, zones, sizes.select(region).join(failed, region, "left_anti"), balance, region, failed)


def _described(out: RegionalModels, zones: DataFrame, fitted: DataFrame, balance: DataFrame | None, region: str, failed: DataFrame | None = None) -> RegionalModels:
    """Add info and skipped."""
    used = {"balanced": "balanced_pos", "pos": "pos_weight", "cost_pos": "cost_pos_weight"}.get(out.method.weights)
    weight = F.lit(None).cast("double")
    info = fitted.select(region).distinct()
    if balance is not None:
        info, weight = info.join(balance, region, "left"), F.col(used) if used else F.lit(float(FN_COST))
    out.info = written(info.select(region, F.lit(None).cast("double").alias("threshold"), weight.cast("double").alias("scale_pos_weight")), "info")
    missing = zones.join(out.info, region, "left_anti")
    if failed is None:
        missing = missing.withColumn("reason", F.lit(NO_ROWS))
    else:
        missing = missing.join(failed, region, "left").select(region, F.coalesce("reason", F.lit(NO_ROWS)).alias("reason"))
    out.skipped = written(missing, "skipped")
    return out


def skipped_table(fitted: Sequence[RegionalModels], spark: SparkSession, region: str = "region") -> DataFrame:
    """(task, method, region, reason) of the zones that have no model."""
    parts = [
        m.skipped.select(F.lit(m.task).alias("task"), F.lit(m.method.name).alias("method"), F.col(region).cast("string").alias("region"), "reason")
        for m in fitted
    ]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "task string, method string, region string, reason string"))


def score_regional(df: DataFrame, fitted: RegionalModels, as_name: str = "score", region: str = "region") -> DataFrame:
    """Add the prediction (regression) or the probability of class 1 (classification).

    Rows with an unknown feature or of a zone without a model give no score and no row.
    """
    if fitted.method.kind == "ols":
        keep = df.columns
        frame, names = interaction_frame(df)
        scored = predict_ols(frame, fitted.table, names, region, as_name)
        return scored.select(*keep, as_name).where(F.col(as_name).isNotNull())
    rows = drop_null_subset(df, fitted.features)
    if fitted.stats is not None:
        # Keep the unscaled columns of the input in the result.
        rows = rows.select(region, *fitted.features, F.struct(*df.columns).alias("_row"))
        rows = standardize_by_region(rows, fitted.stats, fitted.features, region)
        return predict_logistic(rows, fitted.table, fitted.features, as_name, region).select("_row.*", as_name)
    parts = [score_trees(rows, fitted.table, fitted.features, fitted.method, as_name, region)]
    for zone, model in fitted.models.items():
        scored = model.transform(_assembled(rows.where(F.col(region) == zone), fitted.features))
        value = vector_to_array("probability")[1] if fitted.method.classifier else F.col("prediction")
        parts.append(scored.select(*df.columns, value.alias(as_name)))
    return reduce(DataFrame.unionByName, parts)
