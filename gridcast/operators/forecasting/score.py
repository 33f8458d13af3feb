"""Scoring new days (ML23-ML25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridcast.functions.scalar import round_half_even
from gridcast.operators.aggregates import argmax_hour
from gridcast.operators.forecasting.compare import classify_peak_day
from gridcast.operators.forecasting.regional import RegionalModels, score_regional


def score_hourly(features: DataFrame, fitted: RegionalModels) -> DataFrame:
    """ML23: whole-number load per date, zone and hour."""
    return score_regional(features, fitted, "_v").select(
        "date", "region", "hour", round_half_even("_v").alias("predicted_load")
    )


def score_peak_hour(features: DataFrame, fitted: RegionalModels) -> DataFrame:
    """ML24: the hour with the largest score per date and zone."""
    return argmax_hour(score_regional(features, fitted, "_v"), ["date", "region"], "_v")


def score_peak_day(daily: DataFrame, fitted: RegionalModels) -> DataFrame:
    """ML25: flag per date and zone."""
    return classify_peak_day(daily, fitted).select("date", "region", "peak_day_pred")
