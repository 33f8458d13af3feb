"""Nested hourly payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridcast.functions.timeparse import plus_hours

# Fixed field names of the payload and the columns they become.
HOURLY_FIELDS = {
    "time": "datetime_beginning_utc",
    "temperature_2m": "temp",
    "relative_humidity_2m": "humidity",
    "dew_point_2m": "dew_point",
    "precipitation": "precip",
    "wind_speed_10m": "wind",
}


def payload_schema(fields: Mapping[str, str] = HOURLY_FIELDS, time_field: str = "time") -> T.StructType:
    arrays = [
        T.StructField(f, T.ArrayType(T.StringType() if f == time_field else T.DoubleType())) for f in fields
    ]
    return T.StructType([T.StructField("hourly", T.StructType(arrays))])


def explode_hourly_payload(
    df: DataFrame,
    json_col: str = "payload",
    keep: Sequence[str] = ("load_area",),
    fields: Mapping[str, str] = HOURLY_FIELDS,
    time_field: str = "time",
) -> DataFrame:
    """SRC4: one row per entry of the parallel arrays; a payload without times gives no row."""
    schema = payload_schema(fields, time_field)
    parsed = df.select(*keep, F.from_json(json_col, schema).alias("p")).where(
        F.col(f"p.hourly.{time_field}").isNotNull()
    )
    # A field that a payload lacks is unknown in all its hours.
    arrays = [
        F.coalesce(F.col(f"p.hourly.{f.name}"), F.array().cast(f.dataType)).alias(f.name)
        for f in schema["hourly"].dataType
    ]
    zipped = F.arrays_zip(*arrays)
    return parsed.select(*keep, F.inline(zipped)).withColumnsRenamed(dict(fields))


def filter_payload_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """PF14: rows from the first hour of ``start`` to hour 23 of ``end`` (dates, UTC)."""
    last_hour = plus_hours(end.cast("timestamp_ntz"), F.lit(23))
    return df.where(F.col(ts).between(start.cast("timestamp_ntz"), last_hour))
