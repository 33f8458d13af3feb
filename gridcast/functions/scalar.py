"""Numeric and text helpers for features and output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridcast.functions import as_col


def nan_to_null(c: Column | str) -> Column:
    """Missing values are nulls everywhere behind the source boundary."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def degree_days(
    t_mean: Column | str, t_max: Column | str, t_min: Column | str, base: float = 65.0
) -> dict[str, Column]:
    """F12. ``greatest`` skips nulls, so an unknown mean is kept unknown explicitly."""
    t_mean = as_col(t_mean)
    known = t_mean.isNotNull()
    return {
        "temp_range": as_col(t_max) - as_col(t_min),
        "hdd": F.when(known, F.greatest(F.lit(0.0), F.lit(base) - t_mean)),
        "cdd": F.when(known, F.greatest(F.lit(0.0), t_mean - F.lit(base))),
    }


def interactions(
    hour: Column | str = "hour",
    temperature: Column | str = "temperature",
    humidity: Column | str = "humidity",
    weekend: Column | str = "is_weekend",
) -> dict[str, Column]:
    """F14."""
    t = as_col(temperature)
    return {
        "hour_x_temp": as_col(hour) * t,
        "temp_squared": t * t,
        "temp_x_humidity": t * as_col(humidity),
        "weekend_x_temp": as_col(weekend) * t,
    }


def one_hot_drop_first(c: Column | str, prefix: str, levels: range = range(7)) -> dict[str, Column]:
    """one 0/1 column per level but the first; levels are fixed, so train and test agree."""
    c = as_col(c)
    return {f"{prefix}_{k}": (c == k).cast("int") for k in list(levels)[1:]}


def round_half_even(c: Column | str) -> Column:
    """F16: nearest integer, a half goes to the even neighbour."""
    return F.rint(as_col(c)).cast("bigint")


def within_tolerance(a: Column | str, b: Column | str, tolerance: int = 1) -> Column:
    """plain distance, not circular (23 and 0 are 23 apart)."""
    return F.abs(as_col(a) - as_col(b)) <= tolerance


def hour_label(hour: Column | str) -> Column:
    """hour_00..hour_23."""
    return F.format_string("hour_%02d", as_col(hour))


def file_year(path: Column | str) -> Column:
    """year token ``_<yyyy>.csv`` of a file, or of the folder that holds its parts."""
    token = F.regexp_extract(as_col(path), r"_(\d{4})\.csv(?:/[^/]*)?$", 1)
    return F.when(token != "", token.cast("int"))
