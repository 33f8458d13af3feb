"""Feature frames (ML1, ML2) and splits (ML3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions import calendar as cal
from gridcast.functions.scalar import degree_days
from gridcast.operators.aggregates import daily_weather_agg
from gridcast.operators.joins import join_holiday
from gridcast.operators.labels import adjacent_calendar_days, adjacent_holiday_flags
from gridcast.operators.relational import drop_null_subset

# Fixed feature names of the hourly models, in order.
HOURLY_FEATURES = (
    "hour", "day_of_week", "month", "day_of_month", "day_of_year", "week_of_year", "is_weekend",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "temperature", "humidity", "wind_speed", "precipitation",
    "is_thanksgiving", "is_christmas", "is_new_years", "is_july4", "is_other_holiday",
    "is_day_before_holiday", "is_day_after_holiday",
)

# Fixed feature names of the daily models, in order.
DAILY_FEATURES = (
    "temperature_max", "temperature_min", "temperature_mean", "temperature_std", "temp_range",
    "hdd", "cdd", "is_very_hot", "is_very_cold",
    "humidity_max", "humidity_min", "humidity_mean",
    "precipitation_sum", "precipitation_max",
    "wind_speed_max", "wind_speed_mean",
    "month", "day_of_week", "day_of_month", "week_of_year",
    "is_weekend", "is_holiday",
    "month_sin", "month_cos", "dow_sin", "dow_cos",
)


def hourly_features(
    df: DataFrame,
    holidays: DataFrame | None = None,
    ts: str = "datetime",
    region: str = "region",
    neighbours: str = "rows",
) -> DataFrame:
    """ML1: calendar, cyclical and holiday features of hourly rows.

    ``neighbours`` is "rows" (holiday 24 rows away in the zone, W2) or "calendar" (holiday on the
    next or previous date; no exchange).
    """
    out = df.withColumns({**cal.calendar_parts(ts), "date": F.to_date(ts)}).withColumns(
        {
            "hour_sin": cal.cyclical_sin("hour", 24),
            "hour_cos": cal.cyclical_cos("hour", 24),
            "day_sin": cal.cyclical_sin("day_of_week", 7),
            "day_cos": cal.cyclical_cos("day_of_week", 7),
        }
    )
    out = join_holiday(out, holidays)
    out = out.withColumns(cal.holiday_name_flags("holiday_name")).drop("holiday_name")
    if neighbours == "calendar":
        return adjacent_calendar_days(out, holidays)
    return adjacent_holiday_flags(out, region, ts)


def daily_features(
    df: DataFrame,
    holidays: DataFrame | None = None,
    load: str | None = "load",
    base: float = 65.0,
    hot: float = 85.0,
    cold: float = 32.0,
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """ML2: one row per (date, zone) with weather aggregates and calendar features."""
    daily = daily_weather_agg(df, [date, region], load)
    parts = {k: v for k, v in cal.calendar_parts(date).items() if k not in ("hour", "day_of_year")}
    daily = daily.withColumns({"year": F.year(date), **parts})
    daily = join_holiday(daily, holidays, date).drop("holiday_name")
    return daily.withColumns(
        {
            **degree_days("temperature_mean", "temperature_max", "temperature_min", base),
            "is_very_hot": cal.flag(F.col("temperature_max") > hot),
            "is_very_cold": cal.flag(F.col("temperature_min") < cold),
            "month_sin": cal.cyclical_sin("month", 12),
            "month_cos": cal.cyclical_cos("month", 12),
            "dow_sin": cal.cyclical_sin("day_of_week", 7),
            "dow_cos": cal.cyclical_cos("day_of_week", 7),
        }
    )


def temporal_split(
    df: DataFrame,
    ranges: Mapping[str, tuple[Column | None, Column | None]],
    ts: str = "datetime",
    required: Sequence[str] = (),
    window_end: str | None = None,
) -> DataFrame:
    """ML3: rows of each inclusive range under its name in column ``split``, in one pass.

    Ranges may overlap; a row then comes out once per range. Rows with an unknown value in
    ``required`` (features and target) are dropped. With ``window_end`` a row also needs its label
    window to end inside the range, so no label looks past a training end.
    """

    def inside(start: Column | None, end: Column | None) -> Column:
        ok = F.col(ts).isNotNull()
        if start is not None:
            ok = ok & (F.col(ts) >= start)
        if end is not None:
            ok = ok & (F.col(ts) <= end)
            if window_end is not None:
                ok = ok & (F.col(window_end) <= end)
        return ok

    labels = F.array_compact(F.array(*[F.when(inside(a, b), F.lit(n)) for n, (a, b) in ranges.items()]))
    # The outermost bounds stay a plain filter on ``ts``, so they reach the scan.
    any_range = None
    for a, b in ranges.values():
        cond = inside(a, b)
        any_range = cond if any_range is None else any_range | cond
    rows = df.where(any_range)
    if required:
        rows = drop_null_subset(rows, required)
    return rows.withColumn("split", F.explode(labels))
