"""Metrics, thresholds and scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions import as_col
from gridcast.functions.scalar import within_tolerance
from gridcast.operators.relational import broadcast_if_small

# Fixed costs of the peak-day task: a false alarm and a missed peak day.
FP_COST = 1
FN_COST = 4


def regression_metrics(
    df: DataFrame, keys: Sequence[str] = ("region", "method"), actual: str = "load", pred: str = "predicted_load"
) -> DataFrame:
    """AG12: MSE, RMSE, MAE and R2 per group, in one aggregation."""
    err = F.col(actual) - F.col(pred)
    mse, n = F.avg(err * err), F.count(err)
    sst = F.var_pop(F.when(err.isNotNull(), F.col(actual))) * n
    return df.groupBy(*keys).agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when(sst > 0, 1 - F.sum(err * err) / sst).alias("r2"),
        n.alias("n_test"),
    )


def method_summary(results: DataFrame, method: str = "method") -> DataFrame:
    """AG13: mean over the zones per method, best RMSE first; ordered before rounding."""
    names = ("mse", "rmse", "mae", "r2")
    means = results.groupBy(method).agg(*[F.avg(c).alias(c) for c in names])
    return means.orderBy("rmse", method).select(method, *[F.bround(c, 2).alias(c) for c in names])


def asymmetric_loss(
    label: Column | str, pred: Column | str, fp_cost: float = FP_COST, fn_cost: float = FN_COST
) -> Column:
    """AG15: aggregate, cost of all false alarms and misses."""
    y, p = as_col(label), as_col(pred)
    return F.count_if((y == 1) & (p == 0)) * fn_cost + F.count_if((y == 0) & (p == 1)) * fp_cost


def confusion_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = "is_peak_day",
    pred: str = "peak_day_pred",
    fp_cost: float = FP_COST,
    fn_cost: float = FN_COST,
) -> DataFrame:
    """AG14: confusion counts, loss, accuracy, precision, recall and F1; 0 for an empty denominator."""
    y, p = F.col(label), F.col(pred)
    counts = df.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        asymmetric_loss(y, p, fp_cost, fn_cost).alias("total_loss"),
    )

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(0.0)

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def threshold_at(i: Column | int, start: float = 0.1, step: float = 0.01) -> Column:
    """The ``i``-th value of a floating-point range, bit for bit: the step is the difference of the
    first two values, not ``step`` itself."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.lit(start) + i * F.lit((start + step) - start)


def tune_threshold(
    df: DataFrame,
    keys: Sequence[str] = ("region",),
    prob: str = "p",
    label: str = "is_peak_day",
    fp_cost: float = FP_COST,
    fn_cost: float = FN_COST,
    start: float = 0.1,
    stop: float = 1.0,
    step: float = 0.01,
) -> DataFrame:
    """AG16: per group the lowest threshold with the least loss of ``prob >= threshold``.

    A row is counted once, under the number of thresholds it reaches; running sums over these at most
    91 counts give the loss of every threshold, so no row meets every threshold. The loss only changes
    at a count that occurs, hence only those (and the first threshold) are candidates.
    """
    n_thresholds = math.ceil((stop - start) / step)
    delta = (start + step) - start
    p = F.nanvl(F.col(prob), F.lit(None).cast("double"))
    # The division may be one off next to a threshold; compare with the exact values on both sides.
    guess = F.floor((p - start) / delta)
    reached = F.when(threshold_at(guess + 1, start, step) <= p, guess + 2).otherwise(
        F.when(threshold_at(guess, start, step) <= p, guess + 1).otherwise(guess)
    )
    # ``least`` skips nulls, hence the explicit case: a row without a score reaches no threshold.
    k = F.when(p.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n_thresholds), reached))).otherwise(0).cast("int")
    y = F.col(label)
    counts = df.groupBy(*keys, k.alias("_k")).agg(
        F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg")
    )
    upto = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    losses = counts.select(
        *keys,
        "_k",
        F.sum("_neg").over(total).alias("_all_neg"),
        (
            F.sum("_pos").over(upto) * fn_cost + (F.sum("_neg").over(total) - F.sum("_neg").over(upto)) * fp_cost
        ).alias("_loss"),
    )
    option = F.struct(F.col("_loss").alias("loss"), F.col("_k").alias("k"))
    # Without a row below the first threshold, that threshold flags every row.
    all_flagged = F.struct((F.max("_all_neg") * fp_cost).alias("loss"), F.lit(0).alias("k"))
    first = F.when(F.min("_k") > 0, all_flagged)
    best = F.least(first, F.min(F.when(F.col("_k") < n_thresholds, option)))
    return (
        losses.groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, threshold_at(F.col("_b.k"), start, step).alias("threshold"), F.col("_b.loss").alias("loss"))
    )


def success_rate(
    df: DataFrame, keys: Sequence[str] = ("method",), pred: str = "pred", actual: str = "actual", tolerance: int = 1
) -> DataFrame:
    """AG17: share of peak hours hit within ``tolerance`` hours, best first."""
    ok = F.coalesce(within_tolerance(pred, actual, tolerance), F.lit(False))
    n, hit = F.count(F.lit(1)), F.count_if(ok)
    return (
        df.groupBy(*keys)
        .agg(
            n.alias("total"),
            hit.alias("correct"),
            (n - hit).alias("incorrect"),
            (hit * 100.0 / n).alias("success_rate"),
        )
        .orderBy(F.col("success_rate").desc(), *keys)
    )


def scaling_stats(train: DataFrame, cols: Sequence[str], region: str = "region") -> DataFrame:
    """AG20, fit: mean and population standard deviation per zone; a constant column gets 1."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{c}__sd")]
    return train.groupBy(region).agg(*aggs)


def standardize_by_region(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], region: str = "region"
) -> DataFrame:
    """AG20, apply. ``stats`` has one row per zone and is counted: with a checked, small number of zones the
    facts do not move. Write it first."""
    z = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd") for c in cols}
    joined = df.join(broadcast_if_small(stats), region)
    return joined.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])
