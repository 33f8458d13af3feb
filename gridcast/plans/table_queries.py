"""Filters, set operations, profiles, aggregates, windows, top-k and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridcast.functions import calendar as cal, scalar as S
from gridcast.operators import aggregates as A, joins as J, labels as L, layout as LY, relational as R
from gridcast.plans import views as V
from gridcast.plans.registry import query
from gridcast.session import written
from gridcast.sources import dims

METRICS = A.PROFILE_METRICS


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _day(text: str):
    return F.to_date(F.lit(text))


def _dated_load(spark, sf):
    return V.load_history(spark, sf).select(
        "region", F.to_date("ts_local").alias("date"), F.hour("ts_local").alias("hour"), "ts_local", "load"
    )


def _season(spark, sf):
    return A.season_frame(V.profile_frame(spark, sf))


def _hourly_dates(spark, sf):
    """The event month as a forecast: (date, region, hour, predicted_load)."""
    return V.load_hourly(spark, sf).select(
        F.to_date("dt_hour").alias("date"),
        F.col("load_area").alias("region"),
        F.hour("dt_hour").alias("hour"),
        F.col("mw").alias("predicted_load"),
    )


_HOURLY_DATES = """select cast(dt_hour as date) as date, load_area as region, cast(hour(dt_hour) as int) as hour,
                          mw as predicted_load from load_hourly"""

# Filters and projections.


@query("filter_in_list", "select * from load_history where region in ('ASIA', 'EUROPE')", ("load_history",))
def filter_in_list(spark, sf):
    return R.filter_in_list(V.load_history(spark, sf), "region", ["ASIA", "EUROPE"])


@query("select_columns", "select l_linenumber, l_orderkey, l_quantity from lineitem")
def select_columns(spark, sf):
    return R.select_columns(V.table(spark, sf, "lineitem"), ["l_linenumber", "l_orderkey", "l_quantity"])


_NAMES = {"mw": "load", "temp": "temperature", "precip": "precipitation", "wind": "wind_speed"}


@query(
    "rename_columns",
    """select load_area as region, wx_hour as datetime, order_utc, event_id, temp as temperature, humidity,
              precip as precipitation, wind as wind_speed from weather_obs""",
    ("weather_obs",),
)
def rename_columns(spark, sf):
    return R.rename_columns(V.weather_obs(spark, sf), {"load_area": "region", "wx_hour": "datetime", **_NAMES})


@query("drop_columns", "select load_area, wx_hour, temp, humidity, precip, wind from weather_obs", ("weather_obs",))
def drop_columns(spark, sf):
    return R.drop_columns(V.weather_obs(spark, sf), ["order_utc", "event_id"])


@query(
    "filter_time_range",
    """select *, 'closed' as kind from load_history
         where ts_local between timestamp '1998-11-20 00:00:00' and timestamp '1999-02-28 23:00:00'
       union all select *, 'open' as kind from load_history where ts_local <= timestamp '1995-12-31 23:00:00'""",
    ("load_history",),
)
def filter_time_range(spark, sf):
    load = V.load_history(spark, sf)
    closed = R.filter_time_range(load, "ts_local", _ts("1998-11-20 00:00:00"), _ts("1999-02-28 23:00:00"))
    opened = R.filter_time_range(load, "ts_local", end=_ts("1995-12-31 23:00:00"))
    return R.union_batches([R.tag_constant(closed, "kind", "closed"), R.tag_constant(opened, "kind", "open")])


@query(
    "drop_null_subset",
    "select region, ts_local, mw, temp, humidity from merged where dt is not null and temp is not null",
    ("merged",),
)
def drop_null_subset(spark, sf):
    return R.drop_null_subset(V.merged(spark, sf), ["dt", "temp"]).select(
        "region", "ts_local", "mw", "temp", "humidity"
    )


_AUDIT = "select '{0}' as column_name, count(*) as n_rows, count(*) - count({0}) as n_null, " \
         "count({0}) * 100.0::double / count(*) as coverage_pct from merged"


@query("null_audit", " union all ".join(_AUDIT.format(c) for c in ("dt", "temp", "dew_point")), ("merged",))
def null_audit(spark, sf):
    return R.null_audit(V.merged(spark, sf), ["dt", "temp", "dew_point"])


@query(
    "null_sample",
    "select region, ts_local, mw from merged where dt is null order by ts_local, region limit 5",
    ("merged",),
)
def null_sample(spark, sf):
    return R.null_sample(V.merged(spark, sf), "dt", ["ts_local", "region"]).select("region", "ts_local", "mw")


@query("tag_constant", "select n_nationkey, n_name, 2024::int as year from nation")
def tag_constant(spark, sf):
    return R.tag_constant(V.table(spark, sf, "nation").select("n_nationkey", "n_name"), "year", 2024)


@query(
    "season_of_month",
    "select region, datetime, season from profile_frame",
    ("profile_frame",),
)
def season_of_month(spark, sf):
    return V.profile_frame(spark, sf).select(
        "region", "datetime", cal.season_of_month(F.month("datetime")).alias("season")
    )


@query("season_year", "select region, datetime, season_year from profile_frame", ("profile_frame",))
def season_year(spark, sf):
    return V.profile_frame(spark, sf).select(
        "region", "datetime", cal.season_year(F.year("datetime"), F.month("datetime")).alias("season_year")
    )


@query(
    "bool_flags",
    """select region, datetime, cast(isodow(datetime) >= 6 as int) as is_weekend,
              cast(coalesce(temp > 45, false) as int) as is_very_hot,
              cast(coalesce(temp < 5, false) as int) as is_very_cold from profile_frame""",
    ("profile_frame",),
)
def bool_flags(spark, sf):
    return V.profile_frame(spark, sf).select(
        "region",
        "datetime",
        cal.flag(F.weekday("datetime") >= 5).alias("is_weekend"),
        cal.flag(F.col("temp") > 45).alias("is_very_hot"),
        cal.flag(F.col("temp") < 5).alias("is_very_cold"),
    )


@query(
    "same_calendar_date",
    """select h.region, t.date as target_date, h.date, h.hour, h.load
       from (select distinct region, cast(ts_local as date) as date from load_history
             where ts_local >= timestamp '2000-01-01' and ts_local < timestamp '2001-01-01') t
       join (select region, cast(ts_local as date) as date, cast(hour(ts_local) as int) as hour, load
             from load_history) h
       on h.region = t.region and month(h.date) = month(t.date) and day(h.date) = day(t.date)
          and year(h.date) < year(t.date)""",
    ("load_history",),
)
def same_calendar_date(spark, sf):
    load = _dated_load(spark, sf).drop("ts_local")
    targets = R.filter_time_range(load, "date", _day("2000-01-01"), _day("2000-12-31"))
    return R.same_calendar_date(R.distinct_values(targets, ["region", "date"]), load)


@query(
    "calendar_date_history",
    """select t.region, t.date as target_date, count(h.load) as n, round(avg(h.load), 6) as mean,
              cast(min(h.load) as double) as least, cast(max(h.load) as double) as greatest, max(h.date) as latest
       from (select distinct region, cast(ts_local as date) as date from load_history
             where ts_local >= timestamp '1995-01-01' and ts_local < timestamp '2001-01-01') t
       left join (select region, cast(ts_local as date) as date, load from load_history) h
       on h.region = t.region and month(h.date) = month(t.date) and day(h.date) = day(t.date)
          and year(h.date) < year(t.date)
       group by all""",
    ("load_history",),
)
def calendar_date_history(spark, sf):
    load = written(_dated_load(spark, sf).drop("ts_local"), "dated")
    targets = R.filter_time_range(load, "date", _day("1995-01-01"), _day("2000-12-31"))
    return R.calendar_date_history(targets, load, "load").withColumn("mean", F.round("mean", 6))


# The least number of training rows is the zones' mean, so some zones stay and some go at every scale.
_GUARD = """select region from (
              select region, count(*) filter (where ts_local < timestamp '1995-06-01') as n,
                     count(*) filter (where ts_local >= timestamp '1995-06-01') as later from load_history group by 1)
            where later >= 1 and n >= (select cast(avg(n) as bigint) from (
              select count(*) filter (where ts_local < timestamp '1995-06-01') as n from load_history group by region))"""


@query("min_rows_guard", f"select * from load_history where region in ({_GUARD})", ("load_history",))
def min_rows_guard(spark, sf):
    load = written(V.load_history(spark, sf), "guarded")
    cut = _ts("1995-06-01 00:00:00")
    train, test = load.where(F.col("ts_local") < cut), load.where(F.col("ts_local") >= cut)
    n, zones = load.agg(F.count_if(F.col("ts_local") < cut), F.countDistinct("region")).first()
    keys = R.min_rows_guard(train, test, "region", math.floor(n / zones + 0.5) if zones else 1)
    return R.semi_join_membership(load, keys, ["region"])


@query(
    "semi_join_membership",
    """select l.* from load_history l where exists (
         select 1 from (select region, cast(ts_local as date) as d, row_number() over (
                          partition by region order by load desc, ts_local) as rk from load_history) t
         where t.rk <= 100 and t.region = l.region and t.d = cast(l.ts_local as date))""",
    ("load_history",),
)
def semi_join_membership(spark, sf):
    load = _dated_load(spark, sf)
    top = R.top_k_per_group(load, ["region"], [F.col("load").desc(), F.col("ts_local")], 100)
    return R.semi_join_membership(load, top, ["region", "date"]).select("region", "ts_local", "load")


@query(
    "union_batches",
    """select load_area, dt_hour, mw, 'events' as batch from load_hourly
       union all select region, ts_local, load, 'history' from load_history""",
    ("load_hourly", "load_history"),
)
def union_batches(spark, sf):
    a = V.load_hourly(spark, sf).drop("n_obs")
    b = V.load_history(spark, sf).withColumnsRenamed({"region": "load_area", "ts_local": "dt_hour", "load": "mw"})
    return R.union_batches([R.tag_constant(a, "batch", "events"), R.tag_constant(b, "batch", "history")])


@query("distinct_values", "select distinct region, cast(ts_local as date) as date from load_history",
       ("load_history",))
def distinct_values(spark, sf):
    return R.distinct_values(_dated_load(spark, sf), ["region", "date"])


@query("sorted_distinct", "select distinct cast(ts_local as date) as date from load_history order by 1",
       ("load_history",))
def sorted_distinct(spark, sf):
    return R.sorted_distinct(_dated_load(spark, sf), ["date"])


@query("sort_multi", "select * from load_history order by ts_local, region", ("load_history",))
def sort_multi(spark, sf):
    return R.sort_multi(V.load_history(spark, sf), ["ts_local", "region"])


@query(
    "top_k_per_group",
    """select region, date, load_max from (select *, row_number() over (
         partition by region order by load_max desc, date) as rk from daily_region) where rk <= 2""",
    ("daily_region",),
)
def top_k_per_group(spark, sf):
    return R.top_k_per_group(V.daily_region(spark, sf), ["region"], [F.col("load_max").desc(), F.col("date")], 2)


@query("head_sample", "select * from load_history order by ts_local, region limit 10", ("load_history",))
def head_sample(spark, sf):
    return R.head_sample(V.load_history(spark, sf), ["ts_local", "region"], 10)


# Grids and alignment.


@query(
    "dense_grid",
    f"""select d.date, z.region, cast(h.hour as int) as hour, v.predicted_load
        from (select distinct date from ({_HOURLY_DATES})) d,
             (select distinct region from ({_HOURLY_DATES})) z, generate_series(0, 23) h(hour)
        left join ({_HOURLY_DATES}) v on v.date = d.date and v.region = z.region and v.hour = h.hour""",
    ("load_hourly",),
)
def dense_grid(spark, sf):
    df = _hourly_dates(spark, sf)
    return J.dense_grid(df, df, values=["predicted_load"])


@query(
    "align_columns",
    """select cast(isodow(datetime) = 2 as int) as day_of_week_1, cast(0 as int) as extra, mw
       from profile_frame""",
    ("profile_frame",),
)
def align_columns(spark, sf):
    df = V.profile_frame(spark, sf)
    df = df.withColumns(S.one_hot_drop_first(F.weekday("datetime"), "day_of_week"))
    return J.align_columns(df, ["day_of_week_1", "extra", "mw"])


# Profiles.

_MEANS = ", ".join(f"avg({m}) as {m}" for m in METRICS)


@query("monthly_profile", f"select year, month, {_MEANS} from profile_frame group by 1, 2", ("profile_frame",))
def monthly_profile(spark, sf):
    return A.monthly_profile(_season(spark, sf))


@query("yearly_profile", f"select year, {_MEANS} from profile_frame group by 1", ("profile_frame",))
def yearly_profile(spark, sf):
    return A.yearly_profile(_season(spark, sf))


def _long_sql(keys: str, names: dict[str, str], where: str = "true") -> str:
    return " union all ".join(
        f"select {keys}, '{n}' as \"Metric\", avg({m}) as \"Value\" from profile_frame where {where} group by {keys}"
        for m, n in names.items()
    )


def _seasonal_sql(by: str, where: str = "true") -> str:
    return _long_sql(f"season, season_year, {by}", A.SEASONAL_NAMES, where)


@query("seasonal_by_wday", _seasonal_sql("wday, dayofweek_name"), ("profile_frame",))
def seasonal_by_wday(spark, sf):
    return A.seasonal_profile(_season(spark, sf), ["wday", "dayofweek_name"])


@query("seasonal_by_hour", _seasonal_sql("hour"), ("profile_frame",))
def seasonal_by_hour(spark, sf):
    return A.seasonal_profile(_season(spark, sf), ["hour"])


@query("seasonal_by_dayhour", _seasonal_sql("dayhour"), ("profile_frame",))
def seasonal_by_dayhour(spark, sf):
    return A.seasonal_profile(_season(spark, sf), ["dayhour"])


@query(
    "unpivot_metrics",
    " union all ".join(
        f"select region, ts_local, '{m}' as \"Metric\", {m} as \"Value\" from merged" for m in ("mw", "temp", "wind")
    ),
    ("merged",),
)
def unpivot_metrics(spark, sf):
    return A.unpivot_metrics(V.merged(spark, sf), ["region", "ts_local"], ["mw", "temp", "wind"])


_CHART = {m: m for m in A.CHART_METRICS}


@query("chart_monthly", _long_sql("year, month", _CHART), ("profile_frame",))
def chart_monthly(spark, sf):
    return A.chart_monthly(_season(spark, sf))


@query("chart_yearly", _long_sql("year", _CHART), ("profile_frame",))
def chart_yearly(spark, sf):
    return A.chart_yearly(_season(spark, sf))


@query("chart_season_wday", _seasonal_sql("wday, dayofweek_name", "season = 'Summer'"), ("profile_frame",))
def chart_season_wday(spark, sf):
    return A.chart_season(_season(spark, sf), "Summer", ["wday", "dayofweek_name"])


@query("chart_season_hour", _seasonal_sql("hour", "season = 'Winter'"), ("profile_frame",))
def chart_season_hour(spark, sf):
    return A.chart_season(_season(spark, sf), "Winter", ["hour"])


# Aggregates.

_DAILY_AGG = """
    cast(datetime as date) as date, region, max(load) as load_max,
    max(temperature) as temperature_max, min(temperature) as temperature_min, avg(temperature) as temperature_mean,
    stddev_samp(temperature) as temperature_std, max(humidity) as humidity_max, min(humidity) as humidity_min,
    avg(humidity) as humidity_mean, coalesce(sum(precipitation), 0) as precipitation_sum,
    max(precipitation) as precipitation_max, max(wind_speed) as wind_speed_max, avg(wind_speed) as wind_speed_mean"""


@query("daily_weather_agg", f"select {_DAILY_AGG} from model_frame group by 1, 2", ("model_frame",))
def daily_weather_agg(spark, sf):
    return A.daily_weather_agg(V.model_frame(spark, sf).withColumn("date", F.to_date("datetime")))


@query("argmax_hour", "select region, date, peak_hour from hour_peaks", ("hour_peaks",))
def argmax_hour(spark, sf):
    return A.argmax_hour(_dated_load(spark, sf))


@query(
    "distinct_counts",
    "select count(distinct region) as n_zones, count(distinct cast(dt as date)) as n_days from merged",
    ("merged",),
)
def distinct_counts(spark, sf):
    return A.distinct_counts(V.merged(spark, sf), {"n_zones": "region", "n_days": F.to_date("dt")})


@query(
    "distinct_sketches",
    """select count(distinct region) as n_zones, true as days_within_bound, true as hours_within_bound,
              count(distinct cast(dt as date)) as n_days, count(distinct dt) as n_hours from merged""",
    ("merged",),
)
def distinct_sketches(spark, sf):
    """Yearly sketches, kept as a table and merged, against the exact counts; the bound is three standard errors."""
    df = V.merged(spark, sf).select("region", "dt", F.year("dt").alias("year"))
    cols = {"zones": "region", "days": F.to_date("dt"), "hours": "dt"}
    kept = written(A.distinct_sketches(df, ["year"], cols), "sketches")
    near = lambda c, n: (F.abs(F.col(c) - F.col(n)) <= 3 * A.SKETCH_ERROR * F.col(n)).alias(f"{c}_within_bound")
    exact = A.distinct_counts(df, {"n_days": F.to_date("dt"), "n_hours": "dt"}).withColumn("one", F.lit(1))
    both = A.merged_distinct(kept, list(cols)).withColumn("one", F.lit(1)).join(exact, "one")
    return both.select(F.col("zones").alias("n_zones"), near("days", "n_days"), near("hours", "n_hours"), "n_days", "n_hours")


@query("extent", "select min(ts_local) as first, max(ts_local) as last from load_history", ("load_history",))
def extent(spark, sf):
    return A.extent(V.load_history(spark, sf), "ts_local")


@query(
    "mode_value",
    """select event_type, mode from (
         select event_type, cast(hour(ts) as int) as mode,
                row_number() over (partition by event_type order by count(*) desc, hour(ts)) as rn
         from events group by event_type, hour(ts)) where rn = 1""",
)
def mode_value(spark, sf):
    events = V.table(spark, sf, "events").select("event_type", F.hour("ts").alias("h"))
    return A.mode_value(events, ["event_type"], "h")


_BALANCE = """select region, count(*) as n, count(*) filter (where is_peak_day = 1) as n_pos,
                     count(*) filter (where is_peak_day = 0) as n_neg, avg(is_peak_day) as share_pos,
                     avg(is_peak_day) * 100 as pct_pos from rolling_labels group by 1"""


@query("label_balance", _BALANCE, ("rolling_labels",))
def label_balance(spark, sf):
    return A.label_balance(L.rolling_peak_day_labels(V.daily_region(spark, sf)), "is_peak_day", ["region"])


@query(
    "class_weights",
    f"""select region, n_pos, n_neg, n_neg / n_pos as pos_weight, n_neg / n_pos * 4 as cost_pos_weight,
               n / (2 * n_pos) as balanced_pos, n / (2 * n_neg) as balanced_neg from ({_BALANCE})""",
    ("rolling_labels",),
)
def class_weights(spark, sf):
    return A.class_weights(L.rolling_peak_day_labels(V.daily_region(spark, sf)), "is_peak_day")


# Windows and labels.


@query(
    "adjacent_holiday_flags",
    """select region, datetime, is_holiday, is_day_before_holiday, is_day_after_holiday from hourly_feat""",
    ("hourly_feat",),
)
def adjacent_holiday_flags(spark, sf):
    # Read twice by the operator, so written first.
    df = written(V.profile_frame(spark, sf).select("region", "datetime", F.to_date("datetime").alias("date")), "profile")
    df = J.join_holiday(df)
    return L.adjacent_holiday_flags(df).select(
        "region", "datetime", "is_holiday", "is_day_before_holiday", "is_day_after_holiday"
    )


@query(
    "adjacent_calendar_days",
    """select region, ts_local, cast(b.date is not null as int) as is_day_before_holiday,
              cast(a.date is not null as int) as is_day_after_holiday
       from load_history l left join holidays b on cast(l.ts_local as date) + 1 = b.date
            left join holidays a on cast(l.ts_local as date) - 1 = a.date""",
    ("load_history", "holidays"),
)
def adjacent_calendar_days(spark, sf):
    df = _dated_load(spark, sf).select("region", "ts_local", "date")
    return L.adjacent_calendar_days(df).drop("date")


@query(
    "mark_peak_hour",
    """select region, ts_local, load, cast(ts_local = p as int) as is_peak_hour,
              cast(hour(p) as int) as peak_hour_actual
       from (select *, first_value(ts_local) over (partition by region, cast(ts_local as date)
                                                   order by load desc, ts_local) as p from load_history)""",
    ("load_history",),
)
def mark_peak_hour(spark, sf):
    df = L.mark_peak_hour(_dated_load(spark, sf), order=["ts_local"])
    return df.select("region", "ts_local", "load", "is_peak_hour", "peak_hour_actual")


@query(
    "rolling_peak_day_labels",
    "select region, date, load_max, window_start, window_end, is_peak_day from rolling_labels",
    ("rolling_labels",),
)
def rolling_peak_day_labels(spark, sf):
    return L.rolling_peak_day_labels(V.daily_region(spark, sf))


@query(
    "period_peak_day_labels",
    """select region, date, load_max, cast(row_number() over (
                partition by region order by load_max desc nulls last, date) <= 2 as int) as is_peak_day
       from daily_region where date between date '1997-11-20' and date '1997-11-29'""",
    ("daily_region",),
)
def period_peak_day_labels(spark, sf):
    return L.period_peak_day_labels(V.daily_region(spark, sf), _day("1997-11-20"), _day("1997-11-29"))


_HISTORICAL = """select t.region, t.date, coalesce(s.peak_hour, o.peak_hour, 17)::int as pred
    from (select distinct region, cast(ts_local as date) as date from load_history
          where ts_local >= timestamp '2000-01-01') t
    left join (select region, m, d, peak_hour from (
        select region, month(date) as m, day(date) as d, peak_hour, row_number() over (
                 partition by region, month(date), day(date) order by count(*) desc, peak_hour) as rn
        from hour_peaks where date < date '2000-01-01' group by 1, 2, 3, 4) where rn = 1) s
      on s.region = t.region and s.m = month(t.date) and s.d = day(t.date)
    left join (select region, peak_hour from (
        select region, peak_hour, row_number() over (partition by region order by count(*) desc, peak_hour) as rn
        from hour_peaks where date < date '2000-01-01' group by 1, 2) where rn = 1) o on o.region = t.region"""


@query("historical_peak_hour", _HISTORICAL, ("load_history", "hour_peaks"))
def historical_peak_hour(spark, sf):
    load = _dated_load(spark, sf)
    train = R.filter_time_range(load, "date", end=_day("1999-12-31"))
    return L.historical_peak_hour(train, R.filter_time_range(load, "date", _day("2000-01-01")))


# Scalar functions.


def _profile_rows(spark, sf, *cols):
    return V.profile_frame(spark, sf).select("region", "datetime", *cols)


@query(
    "calendar_parts",
    """select region, datetime, hour, cast(isodow(datetime) - 1 as int) as day_of_week, month,
              cast(day(datetime) as int) as day_of_month, cast(dayofyear(datetime) as int) as day_of_year,
              cast(week(datetime) as int) as week_of_year, cast(isodow(datetime) >= 6 as int) as is_weekend
       from profile_frame""",
    ("profile_frame",),
)
def calendar_parts(spark, sf):
    return _profile_rows(spark, sf, *[c.alias(n) for n, c in cal.calendar_parts("datetime").items()])


@query("day_name", "select region, datetime, dayofweek_name, wday from profile_frame", ("profile_frame",))
def day_name(spark, sf):
    return _profile_rows(spark, sf, cal.day_name("datetime").alias("dayofweek_name"),
                         F.weekday("datetime").alias("wday"))


@query(
    "cyclical_encode",
    """select region, datetime, round(sin(2 * pi() * hour / 24), 9) as hour_sin,
              round(cos(2 * pi() * hour / 24), 9) as hour_cos, round(sin(2 * pi() * wday / 7), 9) as day_sin,
              round(cos(2 * pi() * wday / 7), 9) as day_cos, round(sin(2 * pi() * month / 12), 9) as month_sin,
              round(cos(2 * pi() * month / 12), 9) as month_cos from profile_frame""",
    ("profile_frame",),
)
def cyclical_encode(spark, sf):
    parts = {"hour": (F.hour("datetime"), 24), "day": (F.weekday("datetime"), 7), "month": (F.month("datetime"), 12)}
    cols = []
    for n, (x, period) in parts.items():
        cols += [F.round(cal.cyclical_sin(x, period), 9).alias(f"{n}_sin"),
                 F.round(cal.cyclical_cos(x, period), 9).alias(f"{n}_cos")]
    return _profile_rows(spark, sf, *cols)


@query("dayhour_index", "select region, datetime, dayhour from profile_frame", ("profile_frame",))
def dayhour_index(spark, sf):
    return _profile_rows(spark, sf, cal.dayhour_index("datetime").alias("dayhour"))


@query(
    "degree_days",
    f"""select date, region, temperature_max - temperature_min as temp_range,
               case when temperature_mean is not null then greatest(0::double, 25 - temperature_mean) end as hdd,
               case when temperature_mean is not null then greatest(0::double, temperature_mean - 25) end as cdd
        from (select {_DAILY_AGG} from model_frame group by 1, 2)""",
    ("model_frame",),
)
def degree_days(spark, sf):
    daily = A.daily_weather_agg(V.model_frame(spark, sf).withColumn("date", F.to_date("datetime")))
    parts = S.degree_days("temperature_mean", "temperature_max", "temperature_min", 25.0)
    return daily.select("date", "region", *[c.alias(n) for n, c in parts.items()])


@query(
    "holiday_flags",
    """select region, ts_local, coalesce(h.holiday_name = 'Thanksgiving', false)::int as is_thanksgiving,
              coalesce(h.holiday_name = 'Christmas Day', false)::int as is_christmas,
              coalesce(h.holiday_name = 'New Year''s Day', false)::int as is_new_years,
              coalesce(h.holiday_name = 'Independence Day', false)::int as is_july4,
              coalesce(h.holiday_name not in ('Thanksgiving', 'Christmas Day', 'New Year''s Day',
                                              'Independence Day'), false)::int as is_other_holiday
       from load_history l left join holidays h on cast(l.ts_local as date) = h.date""",
    ("load_history", "holidays"),
)
def holiday_flags(spark, sf):
    df = J.join_holiday(_dated_load(spark, sf))
    return df.select("region", "ts_local", *[c.alias(n) for n, c in cal.holiday_name_flags("holiday_name").items()])


@query(
    "interactions",
    """select region, datetime, hour * temp as hour_x_temp, temp * temp as temp_squared,
              temp * humidity as temp_x_humidity, cast(isodow(datetime) >= 6 as int) * temp as weekend_x_temp
       from profile_frame""",
    ("profile_frame",),
)
def interactions(spark, sf):
    parts = S.interactions(F.hour("datetime"), "temp", "humidity", cal.flag(F.weekday("datetime") >= 5))
    return _profile_rows(spark, sf, *[c.alias(n) for n, c in parts.items()])


@query(
    "one_hot_drop_first",
    "select region, datetime, " + ", ".join(f"(wday = {k})::int as day_of_week_{k}" for k in range(1, 7))
    + " from profile_frame",
    ("profile_frame",),
)
def one_hot_drop_first(spark, sf):
    parts = S.one_hot_drop_first(F.weekday("datetime"), "day_of_week")
    return _profile_rows(spark, sf, *[c.alias(n) for n, c in parts.items()])


@query("round_half_even", "select l_orderkey, l_linenumber, cast(round_even(l_quantity / 2, 0) as bigint) as r, "
       "cast(round_even(-l_quantity / 2, 0) as bigint) as r_neg from lineitem")
def round_half_even(spark, sf):
    q = F.col("l_quantity") / 2
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.round_half_even(q).alias("r"), S.round_half_even(-q).alias("r_neg")
    )


@query(
    "within_tolerance",
    "select o_orderkey, abs(o_orderkey % 24 - o_custkey % 24) <= 1 as ok from orders",
)
def within_tolerance(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", S.within_tolerance(F.col("o_orderkey") % 24, F.col("o_custkey") % 24).alias("ok")
    )


@query("hour_label", "select event_id, 'hour_' || lpad(cast(hour(ts) as varchar), 2, '0') as label from events")
def hour_label(spark, sf):
    return V.table(spark, sf, "events").select("event_id", S.hour_label(F.hour("ts")).alias("label"))


@query(
    "join_values",
    """select date, '"' || cast(date as varchar) || '",' || string_agg(cast(cast(mw as bigint) as varchar), ','
              order by load_area, dt_hour) as line
       from (select *, cast(dt_hour as date) as date from load_hourly) group by date""",
    ("load_hourly",),
)
def join_values(spark, sf):
    df = V.load_hourly(spark, sf)
    zones = dims.zone_ordinal(R.distinct_values(df, ["load_area"]))
    df = df.join(R.broadcast_if_small(zones), "load_area").select(
        F.to_date("dt_hour").alias("date"),
        ((F.col("zone_id") - 1) * 24 + F.hour("dt_hour")).alias("slot"),
        F.col("mw").cast("bigint").alias("value"),
    )
    return LY.join_values(df)


# Layouts. Fixed zone names of the event month, used as output columns.
_EVENT_ZONES = ("click", "error", "purchase", "signup", "view")


@query(
    "pivot_region_hour",
    "select date, "
    + ", ".join(
        f"avg(predicted_load) filter (where region = '{z}' and hour = {h}) as {z}_{h:02d}"
        for z in _EVENT_ZONES for h in range(24)
    )
    + f" from ({_HOURLY_DATES}) group by date",
    ("load_hourly",),
)
def pivot_region_hour(spark, sf):
    df = _hourly_dates(spark, sf)
    return LY.pivot_region_hour(df, LY.bounded_values(df, "region"))


@query(
    "pivot_hours",
    "select date, region, "
    + ", ".join(f"avg(predicted_load) filter (where hour = {h}) as hour_{h:02d}" for h in range(24))
    + """ from (select cast(ts_local as date) as date, region, hour(ts_local) as hour, load as predicted_load
                from load_history) group by all""",
    ("load_history",),
)
def pivot_hours(spark, sf):
    return LY.pivot_hours(_dated_load(spark, sf), value="load")


@query(
    "pivot_dates",
    "select region, "
    + ", ".join(f"max(h) filter (where date = date '2024-01-{d:02d}') as \"2024-01-{d:02d}\"" for d in range(1, 31))
    + f""" from (select region, date, cast(arg_min(hour, (-predicted_load, hour)) as int) as h
                 from ({_HOURLY_DATES}) group by 1, 2) group by region""",
    ("load_hourly",),
)
def pivot_dates(spark, sf):
    peaks = A.argmax_hour(_hourly_dates(spark, sf), value="predicted_load")
    return LY.pivot_dates(peaks, LY.bounded_values(peaks, "date"))


@query(
    "pivot_map_dates",
    """select region, cast(cast(ts_local as date) as varchar) as date, cast(max(load) as double) as peak
       from load_history where ts_local is not null and region is not null group by all""",
    ("load_history",),
)
def pivot_map_dates(spark, sf):
    load = _dated_load(spark, sf).where(F.col("region").isNotNull())
    wide = LY.pivot_map(load, ["region"], "date", F.max(F.col("load").cast("double")))
    return wide.select("region", F.explode("values").alias("date", "peak"))


@query(
    "load_cube",
    f"""select d.date, z.zone - 1 as zone, cast(h.hour as int) as hour, v.predicted_load
        from (select distinct date from ({_HOURLY_DATES})) d,
             (select region, cast(row_number() over (order by region) as int) as zone
              from (select distinct region from ({_HOURLY_DATES}))) z, generate_series(0, 23) h(hour)
        left join ({_HOURLY_DATES}) v on v.date = d.date and v.region = z.region and v.hour = h.hour""",
    ("load_hourly",),
)
def load_cube(spark, sf):
    df = _hourly_dates(spark, sf)
    cube = LY.load_cube(df, df)
    flat = cube.select("date", F.posexplode("cube").alias("zone", "hours"))
    return flat.select("date", "zone", F.posexplode("hours").alias("hour", "predicted_load"))
