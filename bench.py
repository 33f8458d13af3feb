"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridcast import local_session  # noqa: E402
from gridcast.plans import QUERIES  # noqa: E402

HEADLINE = (
    "mark_peak_hour",
    "dedup_first",
    "join_load_weather",
    "monthly_profile",
    "seasonal_by_dayhour",
    "daily_weather_agg",
    "hourly_features",
    "daily_features",
    "rolling_peak_day_labels",
    "tune_threshold",
    "historical_peak_hour",
    "regression_metrics",
    "explode_hourly_payload",
    "ols_one_feature",
    "ols_interactions",
    "forecast_line",
    "land_weather",
    "gbt_regressor",
    "forecast_run",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gridcast-bench")
    # One small query first, so the session's start is not part of any number.
    QUERIES["extent"](spark, sf).collect()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
