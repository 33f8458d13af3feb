"""Holiday neighbours, peak-hour and peak-day labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions import calendar as cal
from gridcast.operators.aggregates import argmax_hour, mode_value
from gridcast.operators.blocks import blocks_with_following, dense_index
from gridcast.operators.relational import filter_time_range, top_k_per_group


def adjacent_holiday_flags(
    df: DataFrame,
    region: str = "region",
    ts: str = "datetime",
    date: str = "date",
    is_holiday: str = "is_holiday",
    offset: int = 24,
) -> DataFrame:
    """The holiday flag ``offset`` rows later and earlier in the same zone, 0 beyond its ends.

    The flag depends on the date alone. So the facts are only numbered within their day; the row
    ranges of holidays near each day come from a table with one row per zone and day.
    """
    spans_frame = Window.partitionBy(region).orderBy(date).rowsBetween(-offset, offset)
    days_before = Window.partitionBy(region).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    day_size = df.groupBy(region, date).agg(F.count(F.lit(1)).alias("_n"), F.max(is_holiday).alias("_h"))
    start = F.coalesce(F.sum("_n").over(days_before), F.lit(0))
    days = day_size.withColumn("_start", start).withColumn(
        "_span",
        F.when(F.col("_h") == 1, F.struct(F.col("_start").alias("lo"), (F.col("_start") + F.col("_n")).alias("hi"))),
    )
    # Every day has a row, so ``offset`` rows never reach past ``offset`` days; nulls are not collected.
    days = days.select(region, date, "_start", F.collect_list("_span").over(spans_frame).alias("_spans"))

    in_day = Window.partitionBy(region, date).orderBy(ts)
    pos = F.col("_start") + F.row_number().over(in_day) - 1

    def holiday_at(p: Column) -> Column:
        return F.exists("_spans", lambda s: (p >= s["lo"]) & (p < s["hi"])).cast("int")

    return (
        df.join(days, [region, date])
        .withColumn("_pos", pos)
        .withColumn("is_day_before_holiday", holiday_at(F.col("_pos") + offset))
        .withColumn("is_day_after_holiday", holiday_at(F.col("_pos") - offset))
        .drop("_start", "_spans", "_pos")
    )


def adjacent_calendar_days(df: DataFrame, holidays: DataFrame | None = None, date: str = "date") -> DataFrame:
    """W2, calendar form: the day after / before the date is a holiday. Without ``holidays`` by the federal
    rules, without any exchange."""
    if holidays is None:
        rule = cal.holiday_rule_observed
        return df.withColumns(
            {
                "is_day_before_holiday": cal.flag(rule(F.date_add(date, 1)).isNotNull()),
                "is_day_after_holiday": cal.flag(rule(F.date_sub(date, 1)).isNotNull()),
            }
        )
    near = holidays.select("date").select(
        F.inline(
            F.array(
                F.struct(F.date_sub("date", 1).alias("_nd"), F.lit(1).alias("b"), F.lit(0).alias("a")),
                F.struct(F.date_add("date", 1).alias("_nd"), F.lit(0).alias("b"), F.lit(1).alias("a")),
            )
        )
    )
    near = near.groupBy("_nd").agg(F.max("b").alias("_b"), F.max("a").alias("_a"))
    return (
        df.join(near, F.col(date) == F.col("_nd"), "left")
        .withColumn("is_day_before_holiday", F.coalesce("_b", F.lit(0)))
        .withColumn("is_day_after_holiday", F.coalesce("_a", F.lit(0)))
        .drop("_nd", "_b", "_a")
    )


def mark_peak_hour(
    df: DataFrame,
    keys: Sequence[str] = ("region", "date"),
    load: str = "load",
    hour: str = "hour",
    order: Sequence[str] = ("datetime",),
) -> DataFrame:
    """Flag the row of the daily maximum and repeat its hour on the day's rows (-1 if none).

    ``order`` decides ties and identifies a row within its day. One window over a zone's day, which
    has at most 25 rows once repeated hours are gone (W1): one exchange, and the input is built once.
    """
    v = F.col(load)
    row = F.struct((-v).alias("v"), *[F.col(c) for c in order], F.col(hour).alias("_take"))
    peak = F.min(F.when(v.isNotNull(), row)).over(Window.partitionBy(*keys))
    # Null on a day without any load.
    same = [F.col(c) == F.col(f"_peak.{c}") for c in order]
    hit = same[0]
    for s in same[1:]:
        hit = hit & s
    return (
        df.withColumn("_peak", peak)
        .withColumn("is_peak_hour", cal.flag(hit))
        .withColumn("peak_hour_actual", F.coalesce("_peak._take", F.lit(-1)))
        .drop("_peak")
    )


def rolling_peak_day_labels(
    daily: DataFrame,
    size: int = 10,
    top: int = 2,
    region: str = "region",
    date: str = "date",
    load: str = "load_max",
    block: int = 256,
) -> DataFrame:
    """Every run of ``size`` consecutive observed days of a zone; its ``top`` days by load are 1.

    ``daily`` has one row per (region, date). Output: its columns, ``window_start``, ``window_end``
    and ``is_peak_day``, one row per day and window.
    """
    cols = daily.columns
    indexed = dense_index(daily, [region], F.year(date), [date], "_idx")
    placed = blocks_with_following(indexed, "_idx", block, size - 1)
    frame = Window.partitionBy(region, "_block").orderBy("_idx").rowsBetween(0, size - 1)
    windows = (
        placed.withColumn("_days", F.collect_list(F.struct("_idx", *cols)).over(frame))
        .where(~F.col("_copy") & (F.size("_days") == size))
        .select("_days")
    )
    ranked = F.array_sort(
        F.transform("_days", lambda d: F.struct(d[load].isNull(), (-d[load]).alias("v"), d["_idx"].alias("i")))
    )
    return (
        windows.withColumn("_top", F.transform(F.slice(ranked, 1, top), lambda r: r["i"]))
        .select(
            F.col("_days")[0][date].alias("window_start"),
            F.col("_days")[size - 1][date].alias("window_end"),
            "_top",
            F.explode("_days").alias("_d"),
        )
        .select(
            *[F.col(f"_d.{c}").alias(c) for c in cols],
            "window_start",
            "window_end",
            F.array_contains("_top", F.col("_d._idx")).cast("int").alias("is_peak_day"),
        )
    )


def period_peak_day_labels(
    daily: DataFrame,
    start: Column,
    end: Column,
    top: int = 2,
    region: str = "region",
    date: str = "date",
    load: str = "load_max",
) -> DataFrame:
    """Days of one fixed period, each once; the ``top`` days of every zone are 1."""
    period = filter_time_range(daily, date, start, end)
    best = top_k_per_group(
        period.select(region, date, load), [region], [F.col(load).desc_nulls_last(), F.col(date)], top
    ).select(region, date, F.lit(1).alias("_hit"))
    return (
        period.join(best, [region, date], "left")
        .withColumn("is_peak_day", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def historical_peak_hour(
    train: DataFrame,
    targets: DataFrame,
    default: int = 17,
    region: str = "region",
    date: str = "date",
    hour: str = "hour",
    load: str = "load",
) -> DataFrame:
    """AG21: per target (region, date) the usual peak hour of that month and day in ``train``, else
    the zone's usual peak hour, else ``default``.

    The history shrinks to one row per day, then to one per calendar day, before it meets the targets.
    """
    peaks = argmax_hour(train, [region, date], load, hour, as_name="_peak").withColumns(
        {"_m": F.month(date), "_d": F.dayofmonth(date)}
    )
    same_day = mode_value(peaks, [region, "_m", "_d"], "_peak", "_same_day")
    overall = mode_value(peaks, [region], "_peak", "_overall")
    return (
        targets.select(region, date)
        .distinct()
        .withColumns({"_m": F.month(date), "_d": F.dayofmonth(date)})
        .join(same_day, [region, "_m", "_d"], "left")
        .join(overall, [region], "left")
        .select(region, date, F.coalesce("_same_day", "_overall", F.lit(default)).alias("pred"))
    )
