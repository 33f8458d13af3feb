"""Profiles, daily aggregates and small statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions import as_col, calendar as cal

# Fixed names of the profile metrics and of their long form.
PROFILE_METRICS = ("mw", "temp", "humidity", "wind", "precip")
SEASONAL_NAMES = {"mw": "Load_MW", "temp": "Temp_C", "humidity": "Humidity", "wind": "Wind", "precip": "Precip"}
# Fixed choice of metrics drawn per chart.
CHART_METRICS = ("mw", "temp", "humidity", "wind")


def first_by(largest: Column | str, then: Sequence[str], take: Column | str) -> Column:
    """Aggregate: ``take`` of the row with the largest value; on a tie the row that is first in
    ``then``. Rows without a value are skipped. Combines before the exchange."""
    v = as_col(largest)
    order = [as_col(c).alias(f"o{i}") for i, c in enumerate(then)]
    row = F.struct((-v).alias("v"), *order, as_col(take).alias("take"))
    return F.min(F.when(v.isNotNull(), row))["take"]


def argmax_hour(
    df: DataFrame, keys: Sequence[str] = ("region", "date"), value: str = "load", hour: str = "hour",
    then: Sequence[str] | None = None, as_name: str = "peak_hour",
) -> DataFrame:
    """AG6: hour of the largest value per group, the earliest on a tie; null when no value is known."""
    return df.groupBy(*keys).agg(first_by(value, then or [hour], hour).alias(as_name))


def season_frame(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Calendar columns of the seasonal profiles."""
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "hour": F.hour(ts),
            "wday": F.weekday(ts),
            "date": F.to_date(ts),
            "dayofweek_name": cal.day_name(ts),
            "season": cal.season_of_month(F.month(ts)),
            "season_year": cal.season_year(F.year(ts), F.month(ts)),
            "dayhour": cal.dayhour_index(ts),
        }
    )


def mean_profile(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = PROFILE_METRICS) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def monthly_profile(df: DataFrame, metrics: Sequence[str] = PROFILE_METRICS) -> DataFrame:
    """AG1."""
    return mean_profile(df, ["year", "month"], metrics)


def yearly_profile(df: DataFrame, metrics: Sequence[str] = PROFILE_METRICS) -> DataFrame:
    """AG2."""
    return mean_profile(df, ["year"], metrics)


def unpivot_metrics(
    df: DataFrame, ids: Sequence[str], metrics: Sequence[str], names: Mapping[str, str] | None = None
) -> DataFrame:
    """AG4: wide to long; a null value keeps its row."""
    names = names or {}
    renamed = df.withColumnsRenamed({m: names.get(m, m) for m in metrics})
    return renamed.unpivot(list(ids), [names.get(m, m) for m in metrics], "Metric", "Value")


def seasonal_profile(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AG3: mean per season, season year and ``by``, in long form.

    ``by`` is (wday, dayofweek_name), (hour) or (dayhour).
    """
    keys = ["season", "season_year", *by]
    return unpivot_metrics(mean_profile(df, keys), keys, PROFILE_METRICS, SEASONAL_NAMES)


def chart_monthly(df: DataFrame) -> DataFrame:
    """CH1: a series per year over the months, one panel per metric."""
    wide = monthly_profile(df, CHART_METRICS)
    return unpivot_metrics(wide, ["year", "month"], CHART_METRICS).orderBy("Metric", "year", "month")


def chart_yearly(df: DataFrame) -> DataFrame:
    """CH2: a point per year, one panel per metric."""
    return unpivot_metrics(yearly_profile(df, CHART_METRICS), ["year"], CHART_METRICS).orderBy("Metric", "year")


def chart_season(df: DataFrame, season: str, by: Sequence[str]) -> DataFrame:
    """CH3, CH4: the series of one season, ordered for drawing (``by`` starts with the axis)."""
    return seasonal_profile(df.where(F.col("season") == season), by).orderBy("Metric", "season_year", by[0])


def daily_weather_agg(
    df: DataFrame, keys: Sequence[str] = ("date", "region"), load: str | None = "load"
) -> DataFrame:
    """AG5: one row per day and zone; the maximum of ``load`` only for training data."""
    t, h, p, w = "temperature", "humidity", "precipitation", "wind_speed"
    aggs = [] if load is None else [F.max(load).alias("load_max")]
    aggs += [f(t).alias(f"{t}_{n}") for n, f in
             (("max", F.max), ("min", F.min), ("mean", F.avg), ("std", F.stddev_samp))]
    aggs += [f(h).alias(f"{h}_{n}") for n, f in (("max", F.max), ("min", F.min), ("mean", F.avg))]
    # A sum over nothing but unknown values is 0.
    aggs += [F.coalesce(F.sum(p), F.lit(0.0)).alias(f"{p}_sum"), F.max(p).alias(f"{p}_max")]
    aggs += [F.max(w).alias(f"{w}_max"), F.avg(w).alias(f"{w}_mean")]
    return df.groupBy(*keys).agg(*aggs)


def distinct_counts(df: DataFrame, cols: Mapping[str, Column | str], approx: bool = False) -> DataFrame:
    """AG7: distinct known values, exact or as a sketch."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(as_col(c)).alias(n) for n, c in cols.items()])


#: Buckets of a sketch, as a power of two, and its relative standard error, 1.04 / sqrt(buckets).
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / math.sqrt(1 << SKETCH_BITS)


def distinct_sketches(df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column | str], bits: int = SKETCH_BITS) -> DataFrame:
    """AG7, kept: per group (say, a year) one sketch of a few KB for each column's distinct known values. Sketches of
    later groups are added as rows; no earlier row is read again."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(as_col(c).cast("string"), bits).alias(n) for n, c in cols.items()])


def merged_distinct(sketches: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AG7 from sketches: estimated distinct values over all groups, or per ``keys``. The relative standard error is
    ``SKETCH_ERROR`` at the default size; a column without a known value has 0."""
    return sketches.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in cols])


def extent(df: DataFrame, ts: str) -> DataFrame:
    """AG8."""
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def mode_value(df: DataFrame, keys: Sequence[str], value: str, as_name: str = "mode") -> DataFrame:
    """AG9: most frequent known value, the smallest on a tie.

    Counted per (key, value) first, so state per group is one row, not a map of all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(first_by("_n", [value], value).alias(as_name))


def label_balance(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """AG10."""
    y = F.col(label)
    return df.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.count_if(y == 1).alias("n_pos"),
        F.count_if(y == 0).alias("n_neg"),
        F.avg(y).alias("share_pos"),
        (F.avg(y) * 100).alias("pct_pos"),
    )


def class_weights(df: DataFrame, label: str, keys: Sequence[str] = ("region",), fn_cost: float = 4.0) -> DataFrame:
    """AG11: neg/pos, neg/pos times the cost of a miss (1.0 without positives), and balanced
    weights n / (2 n_class)."""
    n, pos, neg = F.col("n"), F.col("n_pos"), F.col("n_neg")
    return label_balance(df, label, keys).select(
        *keys,
        "n_pos",
        "n_neg",
        F.when(pos > 0, neg / pos).alias("pos_weight"),
        F.when(pos > 0, neg / pos * fn_cost).otherwise(1.0).alias("cost_pos_weight"),
        F.when(pos > 0, n / (2 * pos)).alias("balanced_pos"),
        F.when(neg > 0, n / (2 * neg)).alias("balanced_neg"),
    )
