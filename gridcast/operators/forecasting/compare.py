"""Training, comparison and refitting of the three tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, functions as F

from gridcast.operators.evaluation import (
    FN_COST,
    FP_COST,
    confusion_metrics,
    method_summary,
    regression_metrics,
    success_rate,
    tune_threshold,
)
from gridcast.operators.forecasting.features import DAILY_FEATURES, HOURLY_FEATURES
from gridcast.operators.forecasting.methods import LOAD_METHODS, PEAK_DAY_METHODS, PEAK_HOUR_METHODS, Method
from gridcast.operators.forecasting.regional import RegionalModels, fit_regional, score_regional
from gridcast.operators.joins import pred_vs_actual
from gridcast.operators.labels import historical_peak_hour
from gridcast.operators.relational import best_method, broadcast_if_small, drop_null_subset, min_rows_guard, semi_join_membership, union_batches
from gridcast.session import written

T = TypeVar("T")

# Task names, also in the registry.
HOURLY_LOAD, PEAK_HOUR, PEAK_DAY = "hourly_load", "peak_hour", "peak_day"


def _winner(summary: DataFrame, metric: str, ascending: bool) -> str:
    return best_method(summary, metric, ascending=ascending).first()["method"]


def _together(run: Callable[[Method], T], methods: Mapping[str, Method]) -> list[T]:
    """``run`` of every method, in order. Boosting keeps one core a zone busy and least squares few at a time,
    so the methods' jobs share the cores better side by side."""
    with ThreadPoolExecutor(max(1, len(methods))) as pool:
        return list(pool.map(run, methods.values()))


# Task 1: hourly load.


def score_load(
    train: DataFrame, test: DataFrame, method: Method, features: Sequence[str] = HOURLY_FEATURES
) -> DataFrame:
    """Test rows with ``predicted_load`` of one method, fitted per zone."""
    fitted = fit_regional(train, method, features, "load", HOURLY_LOAD)
    return score_regional(test, fitted, "predicted_load").withColumn("method", F.lit(method.name))


def load_trials(
    train: DataFrame, test: DataFrame, methods: Mapping[str, Method] = LOAD_METHODS
) -> tuple[DataFrame, dict[str, RegionalModels]]:
    """Scored test rows of all methods, and the fitted models by method name."""
    fits = dict(zip(methods, _together(lambda m: fit_regional(train, m, HOURLY_FEATURES, "load", HOURLY_LOAD), methods), strict=True))
    parts = [score_regional(test, f, "predicted_load").withColumn("method", F.lit(f.method.name)) for f in fits.values()]
    return union_batches(parts), fits


def load_metrics(
    train: DataFrame, scored: DataFrame, features: Sequence[str] = HOURLY_FEATURES, keys: Sequence[str] = ("region", "method")
) -> DataFrame:
    """AG12 with the number of training rows."""
    sizes = drop_null_subset(train, [*features, "load"]).groupBy("region").agg(F.count(F.lit(1)).alias("n_train"))
    return regression_metrics(scored, keys).join(sizes, "region")


def compare_load_models(
    train: DataFrame, test: DataFrame, methods: Mapping[str, Method] = LOAD_METHODS, keys: Sequence[str] = ("region", "method")
) -> DataFrame:
    """ML9: metrics per zone and method (or ``keys``, columns of ``test`` among them); a method that cannot be
    fitted anywhere gives no rows."""
    return load_metrics(train, load_trials(train, test, methods)[0], keys=keys)


def common_zones(results: DataFrame) -> DataFrame:
    """The results of zones that every method has, so that means compare like with like. A method that
    was left out of a hard zone must not win by that. ``results``: one row per zone and method."""
    n = results.agg(F.countDistinct("method")).first()[0]
    full = results.groupBy("region").agg(F.countDistinct("method").alias("n")).where(F.col("n") == n)
    if full.isEmpty():
        raise ValueError("no zone has results of all methods")
    return semi_join_membership(results, full, ["region"])


def refit_best_load(
    results: DataFrame, final_train: DataFrame, methods: Mapping[str, Method] = LOAD_METHODS
) -> RegionalModels:
    """ML10: the method with the least mean RMSE, fitted on the longer range."""
    best = methods[_winner(method_summary(common_zones(results)), "rmse", True)]
    return fit_regional(final_train, best, HOURLY_FEATURES, "load", HOURLY_LOAD)


# Task 2: peak hour. Training rows carry ``is_peak_hour``; test rows also ``date``, ``hour``, ``load``.


def peak_hour_trial(
    train: DataFrame,
    test: DataFrame,
    method: Method,
    features: Sequence[str] = HOURLY_FEATURES,
    min_train: int = 100,
) -> tuple[DataFrame, RegionalModels | None]:
    """ML11-ML13, ML15: predicted and true peak hour per (region, date) of one method, and its models if it has any."""
    fitted = None
    if method.kind == "historical":
        truth = pred_vs_actual(test.withColumn("_s", F.col("load")), score="_s").select("region", "date", "actual")
        out = historical_peak_hour(train, test).join(truth, ["region", "date"])
    else:
        enough = min_rows_guard(train, test, min_train=min_train)
        train, test = semi_join_membership(train, enough, ["region"]), semi_join_membership(test, enough, ["region"])
        label = "load" if method.kind == "ols" else "is_peak_hour"
        fitted = fit_regional(train, method, features, label, PEAK_HOUR)
        out = pred_vs_actual(score_regional(test, fitted, "score"), score="score")
    return out.select("region", "date", "pred", "actual", F.lit(method.name).alias("method")), fitted


def peak_hour_results(
    train: DataFrame,
    test: DataFrame,
    method: Method,
    features: Sequence[str] = HOURLY_FEATURES,
    min_train: int = 100,
) -> DataFrame:
    """The results of :func:`peak_hour_trial`."""
    return peak_hour_trial(train, test, method, features, min_train)[0]


def peak_hour_trials(
    train: DataFrame, test: DataFrame, methods: Mapping[str, Method] = PEAK_HOUR_METHODS
) -> tuple[DataFrame, dict[str, RegionalModels]]:
    """Results of all methods, and the fitted models of those that have any, by method name."""
    trials = dict(zip(methods, _together(lambda m: peak_hour_trial(train, test, m), methods), strict=True))
    return union_batches([r for r, _ in trials.values()]), {k: f for k, (_, f) in trials.items() if f is not None}


def compare_peak_hour_models(
    train: DataFrame, test: DataFrame, methods: Mapping[str, Method] = PEAK_HOUR_METHODS
) -> DataFrame:
    """Success rate per method over the zones that all methods have."""
    return peak_hour_summary(peak_hour_trials(train, test, methods)[0])


def peak_hour_summary(results: DataFrame) -> DataFrame:
    """Success rate per method over the zones that all methods have."""
    return success_rate(common_zones(written(results, "peak-hours")))


def refit_best_peak_hour(
    summary: DataFrame, final_train: DataFrame, methods: Mapping[str, Method] = PEAK_HOUR_METHODS
) -> RegionalModels:
    """ML16: the most successful method that has a model, fitted on the longer range."""
    with_model = summary.where(F.col("method").isin(*[k for k, m in methods.items() if m.kind != "historical"]))
    best = methods[_winner(with_model, "success_rate", False)]
    label = "load" if best.kind == "ols" else "is_peak_hour"
    return fit_regional(final_train, best, HOURLY_FEATURES, label, PEAK_HOUR)


# Task 3: peak day. Rows carry ``is_peak_day``.


def fit_peak_day(
    train: DataFrame,
    tune: DataFrame,
    method: Method,
    features: Sequence[str] = DAILY_FEATURES,
    fp_cost: float = FP_COST,
    fn_cost: float = FN_COST,
) -> RegionalModels:
    """ML17, ML18, ML20: a classifier per zone and the threshold that costs least on ``tune``."""
    fitted = fit_regional(train, method, features, "is_peak_day", PEAK_DAY)
    tuned = tune_threshold(score_regional(tune, fitted, "p"), fp_cost=fp_cost, fn_cost=fn_cost)
    return with_thresholds(fitted, tuned)


def with_thresholds(fitted: RegionalModels, found: DataFrame) -> RegionalModels:
    """The models with thresholds from (region, threshold); 0.5 where none was found."""
    limits = fitted.info.drop("threshold").join(found.select("region", "threshold"), "region", "left")
    fitted.info = written(limits.select("region", F.coalesce("threshold", F.lit(0.5)).alias("threshold"), "scale_pos_weight"), "info")
    return fitted


def thresholds(fitted: RegionalModels) -> DataFrame:
    """(region, threshold) table, one row per model."""
    return fitted.info.select("region", F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def classify_peak_day(df: DataFrame, fitted: RegionalModels) -> DataFrame:
    """Probability ``p`` and ``peak_day_pred`` by each zone's own threshold."""
    scored = score_regional(df, fitted, "p")
    return (
        scored.join(broadcast_if_small(thresholds(fitted)), "region")
        .withColumn("peak_day_pred", (F.col("p") >= F.col("threshold")).cast("int"))
        .drop("threshold")
    )


def peak_day_trials(
    train: DataFrame,
    tune: DataFrame,
    test: DataFrame,
    methods: Mapping[str, Method] = PEAK_DAY_METHODS,
) -> tuple[DataFrame, dict[str, RegionalModels]]:
    """Classified test days of all methods, and the fitted models by method name."""
    fits = dict(zip(methods, _together(lambda m: fit_peak_day(train, tune, m), methods), strict=True))
    parts = [classify_peak_day(test, f).withColumn("method", F.lit(f.method.name)) for f in fits.values()]
    return union_batches(parts), fits


def compare_peak_day_models(
    train: DataFrame,
    tune: DataFrame,
    test: DataFrame,
    methods: Mapping[str, Method] = PEAK_DAY_METHODS,
) -> DataFrame:
    """ML21: confusion counts pooled over the zones per method, least loss first."""
    return peak_day_summary(peak_day_trials(train, tune, test, methods)[0])


def peak_day_summary(classified: DataFrame) -> DataFrame:
    """Counts and loss per method over the zones that all methods have."""
    classified = written(classified, "classified")
    return confusion_metrics(common_zones(classified), ["method"]).orderBy("total_loss", "method")


def refit_best_peak_day(
    summary: DataFrame, fits: Mapping[str, RegionalModels], final_train: DataFrame
) -> RegionalModels:
    """ML22: the method with the least loss, fitted on the longer range.

    The longer range holds the rows that chose the thresholds, so each zone keeps the threshold of the
    model that was fitted without them.
    """
    held_out = fits[_winner(summary, "total_loss", True)]
    fitted = fit_regional(final_train, held_out.method, held_out.features, "is_peak_day", PEAK_DAY)
    return with_thresholds(fitted, thresholds(held_out))
