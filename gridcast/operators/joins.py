"""Joins between facts, dimensions and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.calendar import holiday_rule_observed
from gridcast.operators.aggregates import first_by
from gridcast.operators.relational import dedup_first
from gridcast.sources.dims import zone_ordinal


#: Rows without an hour are dealt over so many keys per zone.
NULL_KEYS = 32


def _null_safe(df: DataFrame, hour: str, deal: Column) -> DataFrame:
    """Split a nullable hour into two non-null columns, so that null = null is a plain equality and
    one exchange on (zone, hour) serves both the deduplication and the join. ``deal`` numbers the key of a
    row without an hour, so that a zone's rows of that kind are not one key."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return df.withColumns(
        {
            "_no_hour": F.col(hour).isNull(),
            "_hour": F.coalesce(hour, epoch + F.expr("interval '1' hour") * deal),
        }
    )


def join_load_weather(
    load: DataFrame,
    weather: DataFrame,
    weather_order: Sequence[Column],
    zone: str = "load_area",
    load_hour: str = "dt_ept",
    weather_hour: str = "wx_ept",
    weather_cols: Sequence[str] = ("temp", "humidity", "dew_point", "precip", "wind"),
) -> DataFrame:
    """Every load row with the first weather row of its zone and hour; a null hour meets a null
    hour. The hour columns stay in the result.

    All rows of a zone without an hour have the same match. Load rows are dealt over ``NULL_KEYS`` keys by
    a hash of their values, and weather rows without an hour go to each of them; of those, every task sends
    one row per zone and key, as for any hour.
    """
    keys = [zone, "_hour", "_no_hour"]
    every = F.when(F.col(weather_hour).isNull(), F.sequence(F.lit(0), F.lit(NULL_KEYS - 1))).otherwise(F.array(F.lit(0)))
    dealt = _null_safe(weather.withColumn("_deal", F.explode(every)), weather_hour, F.col("_deal"))
    w = dedup_first(dealt, keys, weather_order).select(*keys, *weather_cols)
    plain = [f.name for f in load.schema if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    key = F.pmod(F.xxhash64(*plain), F.lit(NULL_KEYS)).cast("int")
    return _null_safe(load, load_hour, key).join(w, keys, "left").drop("_hour", "_no_hour")


def join_holiday(df: DataFrame, holidays: DataFrame | None = None, date: str = "date") -> DataFrame:
    """Holiday name (null on other days) and flag.

    Without ``holidays`` the federal rules are applied to the date itself: any year, no join. A table
    (date, holiday_name) of the caller is joined as Spark sees fit.
    """
    if holidays is None:
        out = df.withColumn("holiday_name", holiday_rule_observed(date))
    else:
        h = holidays.select(F.col("date").alias("_hd"), "holiday_name")
        out = df.join(h, F.col(date) == F.col("_hd"), "left").drop("_hd")
    return out.withColumn("is_holiday", F.col("holiday_name").isNotNull().cast("int"))


#: Zones that one row of a grid in the making holds.
KEYS_PER_ROW = 1_000


def key_rows(df: DataFrame, key: str) -> DataFrame:
    """(_row, _keys): the distinct known keys in ascending order, ``KEYS_PER_ROW`` to a row."""
    numbered = zone_ordinal(df.select(key).where(F.col(key).isNotNull()).distinct(), key, "_n")
    row = F.floor((F.col("_n") - 1) / KEYS_PER_ROW).cast("int").alias("_row")
    return numbered.groupBy(row).agg(F.sort_array(F.collect_list(key)).alias("_keys"))


def dense_grid(
    df: DataFrame,
    zones: DataFrame,
    date: str = "date",
    zone: str = "region",
    hour: str = "hour",
    values: Sequence[str] = ("load",),
    hours: range = range(24),
    fill=None,
) -> DataFrame:
    """One row per date x zone x hour, holes filled with ``fill``.

    A date meets each row of ``KEYS_PER_ROW`` zones once and grows by explodes, so any number of zones does.
    ``df`` has at most one row per (date, zone, hour).
    """
    rows = key_rows(zones, zone)
    last = F.coalesce(rows.agg(F.max("_row")).scalar(), F.lit(-1))
    grid = (
        df.select(date)
        .distinct()
        .withColumn("_row", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
        .join(rows, "_row")
        .select(date, F.explode("_keys").alias(zone))
        .withColumn(hour, F.explode(F.array(*[F.lit(h) for h in hours])))
    )
    out = grid.join(df.select(date, zone, hour, *values), [date, zone, hour], "left")
    return out if fill is None else out.fillna(fill, list(values))


def pred_vs_actual(
    df: DataFrame,
    keys: Sequence[str] = ("region", "date"),
    hour: str = "hour",
    score: str = "predicted_load",
    actual: str = "load",
) -> DataFrame:
    """Predicted and true peak hour per group in one aggregation, no join."""
    return df.groupBy(*keys).agg(
        first_by(score, [hour], hour).alias("pred"), first_by(actual, [hour], hour).alias("actual")
    )


def align_columns(test: DataFrame, train_cols: Sequence[str], fill=0) -> DataFrame:
    """The training columns in training order; one that the test side lacks is ``fill``."""
    return test.select(*[F.col(c) if c in test.columns else F.lit(fill).alias(c) for c in train_cols])
