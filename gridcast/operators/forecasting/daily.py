"""The daily run: landed weather payloads and saved models to one published line per day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.functions import timeparse as tp
from gridcast.operators.forecasting.compare import HOURLY_LOAD, PEAK_DAY, PEAK_HOUR
from gridcast.operators.forecasting.features import daily_features, hourly_features
from gridcast.operators.forecasting.score import score_hourly, score_peak_day, score_peak_hour
from gridcast.operators.layout import forecast_line
from gridcast.operators.relational import semi_join_membership
from gridcast.session import written
from gridcast.sources.files import append_forecast_line, read_forecast_lines
from gridcast.sources.payload import explode_hourly_payload
from gridcast.sources.registry import load_models


@dataclass(frozen=True)
class Limits:
    """Degree-day base and the limits of hot and cold days, in the unit of the weather."""

    base: float = 65.0
    hot: float = 85.0
    cold: float = 32.0


def weather_frame(payloads: DataFrame, json_col: str = "payload", zone_col: str = "load_area", zone: str = tp.LOCAL_ZONE) -> DataFrame:
    """Hourly rows (datetime, region, weather) in local time from payloads in UTC. An hour whose local clock
    names two instants has no row, like the hours that training left out."""
    rows = explode_hourly_payload(payloads, json_col, [zone_col])
    utc = tp.parse_fixed_ts(tp.pad_seconds("datetime_beginning_utc"), tp.ISO_T)
    local = tp.localize_or_null(tp.floor_hour(tp.utc_to_local(utc, zone)), zone)
    out = rows.select(
        local.alias("datetime"), F.col(zone_col).alias("region"), F.col("temp").alias("temperature"), "humidity",
        F.col("precip").alias("precipitation"), F.col("wind").alias("wind_speed"),
    )
    return out.where(F.col("datetime").isNotNull())


def forecast(
    spark: SparkSession, payloads: DataFrame, models: str, zones: DataFrame, dates: DataFrame, limits: Limits = Limits(),
    neighbours: str = "calendar",
) -> DataFrame:
    """(date, line) for each of ``dates``: the loads of 24 hours of every zone, the peak hours, the peak-day flags.

    The models of the three tasks are read from the registry below ``models``, each as one whole version.
    Features come from the weather alone. A day's holiday neighbours are taken from the calendar, since
    the run sees no hours beyond its payloads. A zone or hour without weather or without a model is the
    line's ``0``; days without any weather have a line of zeros.
    """
    # Payloads are parsed once; hours and days start from the written rows.
    frame = written(weather_frame(payloads).withColumn("date", F.to_date("datetime")), "forecast-weather")
    wanted = semi_join_membership(frame, dates, ["date"])
    hourly = written(hourly_features(wanted.drop("date"), neighbours=neighbours), "forecast-hours")
    daily = daily_features(wanted, load=None, base=limits.base, hot=limits.hot, cold=limits.cold)
    return forecast_line(
        score_hourly(hourly, load_models(spark, models, HOURLY_LOAD)),
        score_peak_hour(hourly, load_models(spark, models, PEAK_HOUR)),
        score_peak_day(daily, load_models(spark, models, PEAK_DAY)),
        zones,
        dates,
    )


def forecast_run(
    spark: SparkSession, payloads: DataFrame, models: str, zones: DataFrame, dates: DataFrame, path: str, limits: Limits = Limits()
) -> DataFrame:
    """Publish the lines of ``dates`` that ``path`` does not hold yet and return all lines there. A run that is
    repeated publishes nothing twice."""
    lines = written(forecast(spark, payloads, models, zones, dates, limits), "forecast-lines")
    append_forecast_line(lines, path, known=read_forecast_lines(spark, path))
    return read_forecast_lines(spark, path)
