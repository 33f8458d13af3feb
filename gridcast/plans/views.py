"""Demand-shaped views of the given tables, for Spark and as SQL text.

Measures are whole numbers held in doubles, so sums do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridcast.functions.timeparse import floor_hour, localize_or_null, plus_hours
from gridcast.operators.joins import join_load_weather
from gridcast.operators.labels import rolling_peak_day_labels
from gridcast.operators.relational import dedup_first

# Fixed last tie-breaks of weather rows in one zone and hour.
WEATHER_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "temp", "wind")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and hour: one month, few zones."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("load_area"),
        floor_hour("ts").alias("dt_hour"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    return e.groupBy("load_area", "dt_hour").agg(
        F.sum("v").cast("double").alias("mw"), F.count(F.lit(1)).alias("n_obs")
    )


def weather_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Many observations per zone and hour."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("load_area"),
        floor_hour("ts").alias("wx_hour"),
        F.col("ts").alias("order_utc"),
        "event_id",
        F.get_json_object("props", "$.k").cast("double").alias("temp"),
        F.round(F.col("value") * 100).alias("humidity"),
        (F.col("event_id") % 7).cast("double").alias("precip"),
        F.col("user_id").cast("double").alias("wind"),
    )


def _with_zone(df: DataFrame, spark: SparkSession, sf: str, nation: str) -> DataFrame:
    """Add the zone by way of the nation; 25 and 5 rows, whatever the scale."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        df.join(F.broadcast(n), F.col(nation) == F.col("n_nationkey"))
        .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumnRenamed("r_name", "region")
    )


def _zoned_lineitem(spark: SparkSession, sf: str, *cols) -> DataFrame:
    # Suppliers grow with the data, so Spark chooses that join by size.
    items = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    hour = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24).cast("int")
    ts = plus_hours(F.col("l_shipdate").cast("timestamp_ntz"), hour)
    return _with_zone(items, spark, sf, "s_nationkey").select("region", ts.alias("ts_local"), *cols)


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def load_history(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """Seven years of hourly load in five zones, with further aggregates."""
    return (
        _zoned_lineitem(spark, sf, _cents("l_extendedprice").alias("c"))
        .groupBy("region", "ts_local")
        .agg(F.expr("sum(c) div 100").cast("double").alias("load"), *more)
    )


def weather_history(spark: SparkSession, sf: str) -> DataFrame:
    """Weather rows on the same keys, several per key."""
    return _zoned_lineitem(
        spark, sf,
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        F.col("l_quantity").alias("temp"),
        F.round(F.col("l_discount") * 100).alias("humidity"),
        F.when(F.col("l_returnflag") != "A", F.col("l_linenumber").cast("double")).alias("dew_point"),
        F.round(F.col("l_tax") * 100).alias("precip"),
        F.floor(_cents("l_extendedprice") / 100000).cast("double").alias("wind"),
    )


def merged(spark: SparkSession, sf: str, without_flag: str | None = None) -> DataFrame:
    """Load with weather. Without the weather rows of one return flag some hours have none."""
    # Read from an aggregate, the clock is localised once an hour: no condition on it goes to the facts.
    load = load_history(spark, sf, F.max("ts_local").alias("_clock")).withColumn("dt", localize_or_null("_clock")).drop("_clock")
    wx = weather_history(spark, sf)
    if without_flag is not None:
        wx = wx.where(F.col("l_returnflag") != without_flag)
    # The first row of a clock is all that an hour can take from it, so only these rows are localised.
    order = [F.col(c) for c in WEATHER_ORDER]
    wx = dedup_first(wx, ["region", "ts_local"], order).withColumn("wx", localize_or_null("ts_local"))
    out = join_load_weather(
        load, wx, order, "region", "dt", "wx",
        ("temp", "humidity", "dew_point", "precip", "wind"),
    )
    return out.withColumnRenamed("load", "mw")


def profile_frame(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).where(F.col("dt").isNotNull()).withColumnRenamed("dt", "datetime").drop("ts_local")


def model_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Standard names of the feature frames."""
    return profile_frame(spark, sf).select(
        "datetime", "region",
        F.col("mw").alias("load"), F.col("temp").alias("temperature"), "humidity",
        F.col("precip").alias("precipitation"), F.col("wind").alias("wind_speed"),
    )


def daily_region(spark: SparkSession, sf: str) -> DataFrame:
    """Largest order per zone and day."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        _with_zone(orders, spark, sf, "c_nationkey")
        .groupBy("region", F.to_date("o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("load_max"))
    )


def scored_days(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling labels with a score: the previous day's load over the zone's largest."""
    daily = daily_region(spark, sf)
    top = daily.groupBy("region").agg(F.max("load_max").alias("m"))
    before = F.lag("load_max").over(Window.partitionBy("region").orderBy("date"))
    p = daily.withColumn("prev", before).join(top, "region").withColumn("p", F.col("prev") / F.col("m"))
    labels = rolling_peak_day_labels(daily).select("region", "date", "window_start", "is_peak_day")
    return labels.join(p.select("region", "date", "p"), ["region", "date"])


_DST = """(month({t}) = 4 and isodow({t}) = 7 and day({t}) <= 7 and hour({t}) = 2)
          or (month({t}) = 10 and isodow({t}) = 7 and day({t}) >= 25 and hour({t}) = 1)"""

_ZONED = """from lineitem join supplier on l_suppkey = s_suppkey
            join nation on s_nationkey = n_nationkey join region r on n_regionkey = r_regionkey"""
_TS = "l_shipdate + to_hours(cast((l_orderkey * 7 + l_linenumber) % 24 as int))"

def _merged_sql(which: str) -> str:
    missing = _DST.format(t="ts_local")
    return f"""
    select a.region, a.ts_local, a.dt, a.load as mw, w.temp, w.humidity, w.dew_point, w.precip, w.wind
    from (select *, case when {missing} then null else ts_local end as dt from load_history) a
    left join (
      select * from (
        select *, row_number() over (partition by region, wx order by
                 l_orderkey, l_linenumber, l_partkey, l_suppkey, temp, wind) as rn
        from (select *, case when {missing} then null else ts_local end as wx
              from weather_history {which}))
      where rn = 1) w
    on a.region = w.region and a.dt is not distinct from w.wx"""


# View name -> (views it needs, SQL). New York rules of the years in the tables: the hour 2 is missing
# on the first Sunday of April, the hour 1 comes twice on the last Sunday of October.
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "load_hourly": ((), """
        select event_type as load_area, date_trunc('hour', ts) as dt_hour,
               cast(sum(cast(round(value * 100) as bigint)) as double) as mw, count(*) as n_obs
        from events group by 1, 2"""),
    "weather_obs": ((), """
        select event_type as load_area, date_trunc('hour', ts) as wx_hour, ts as order_utc, event_id,
               cast(json_extract_string(props, '$.k') as double) as temp, round(value * 100) as humidity,
               cast(event_id % 7 as double) as precip, cast(user_id as double) as wind
        from events"""),
    "load_history": ((), f"""
        select r_name as region, {_TS} as ts_local,
               cast(cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) // 100 as double) as load
        {_ZONED} group by 1, 2"""),
    "weather_history": ((), f"""
        select r_name as region, {_TS} as ts_local,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
               l_quantity as temp, round(l_discount * 100) as humidity,
               case when l_returnflag <> 'A' then cast(l_linenumber as double) end as dew_point,
               round(l_tax * 100) as precip,
               cast(cast(round(l_extendedprice * 100) as bigint) // 100000 as double) as wind
        {_ZONED}"""),
    "merged": (("load_history", "weather_history"), _merged_sql("")),
    "merged_part": (("load_history", "weather_history"), _merged_sql("where l_returnflag <> 'R'")),
    "profile_frame": (("merged",), """
        select region, dt as datetime, mw, temp, humidity, dew_point, precip, wind,
               cast(year(dt) as int) as year, cast(month(dt) as int) as month, cast(hour(dt) as int) as hour,
               cast(isodow(dt) - 1 as int) as wday, strftime(dt, '%a') as dayofweek_name,
               case when month(dt) in (3, 4, 5) then 'Spring' when month(dt) in (6, 7, 8) then 'Summer'
                    when month(dt) in (9, 10, 11) then 'Fall' else 'Winter' end as season,
               cast(case when month(dt) = 12 then year(dt) + 1 else year(dt) end as int) as season_year,
               cast((isodow(dt) - 1) * 24 + hour(dt) as int) as dayhour
        from merged where dt is not null"""),
    "model_frame": (("merged",), """
        select dt as datetime, region, mw as load, temp as temperature, humidity,
               precip as precipitation, wind as wind_speed
        from merged where dt is not null"""),
    "daily_region": ((), """
        select r_name as region, cast(o_orderdate as date) as date, max(o_totalprice) as load_max
        from orders join customer on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey join region r on n_regionkey = r_regionkey
        group by 1, 2"""),
    "rolling_labels": (("daily_region",), """
        select region, window_start, window_end, date, load_max, cast(rk <= 2 as int) as is_peak_day from (
          select w.region, w.date as window_start, w.window_end, d.date, d.load_max,
                 row_number() over (partition by w.region, w.date
                                    order by d.load_max desc nulls last, d.date) as rk
          from (select region, date, lead(date, 9) over (partition by region order by date) as window_end
                from daily_region) w
          join daily_region d on d.region = w.region and d.date between w.date and w.window_end
          where w.window_end is not null)"""),
    "scored_days": (("daily_region", "rolling_labels"), """
        select l.region, l.date, l.window_start, l.is_peak_day, p.p
        from rolling_labels l join (
          select region, date, lag(load_max) over (partition by region order by date)
                 / max(load_max) over (partition by region) as p
          from daily_region) p on l.region = p.region and l.date = p.date"""),
    "holidays": ((), """
        select date, holiday_name from (
          with days as (
            select cast(d as date) as d from generate_series(timestamp '1994-12-25', timestamp '2003-01-07',
                                                             interval 1 day) g(d)),
          own as (
            select d, case
              when month(d) = 1 and day(d) = 1 then 'New Year''s Day'
              when month(d) = 1 and isodow(d) = 1 and (day(d) - 1) // 7 = 2 then 'Martin Luther King Jr. Day'
              when month(d) = 2 and isodow(d) = 1 and (day(d) - 1) // 7 = 2 then 'Washington''s Birthday'
              when month(d) = 5 and isodow(d) = 1 and month(d + 7) = 6 then 'Memorial Day'
              when month(d) = 7 and day(d) = 4 then 'Independence Day'
              when month(d) = 9 and isodow(d) = 1 and (day(d) - 1) // 7 = 0 then 'Labor Day'
              when month(d) = 10 and isodow(d) = 1 and (day(d) - 1) // 7 = 1 then 'Columbus Day'
              when month(d) = 11 and day(d) = 11 then 'Veterans Day'
              when month(d) = 11 and isodow(d) = 4 and (day(d) - 1) // 7 = 3 then 'Thanksgiving'
              when month(d) = 12 and day(d) = 25 then 'Christmas Day' end as h
            from days),
          obs as (
            select case isodow(d) when 6 then d - 1 else d + 1 end as d, h || ' (observed)' as h
            from own where h is not null and isodow(d) >= 6)
          select coalesce(a.d, b.d) as date, coalesce(a.h, b.h) as holiday_name
          from (select * from own where h is not null) a full join obs b on a.d = b.d)"""),
    "hourly_feat": (("model_frame", "holidays"), """
        select *, is_holiday - is_thanksgiving - is_christmas - is_new_years - is_july4 as is_other_holiday,
               cast(coalesce(lead(is_holiday, 24) over w, 0) as int) as is_day_before_holiday,
               cast(coalesce(lag(is_holiday, 24) over w, 0) as int) as is_day_after_holiday
        from (
          select f.*, cast(hour(datetime) as int) as hour, cast(isodow(datetime) - 1 as int) as day_of_week,
               cast(month(datetime) as int) as month, cast(day(datetime) as int) as day_of_month,
               cast(dayofyear(datetime) as int) as day_of_year, cast(week(datetime) as int) as week_of_year,
               cast(isodow(datetime) >= 6 as int) as is_weekend, cast(datetime as date) as date,
               sin(2 * pi() * hour(datetime) / 24) as hour_sin, cos(2 * pi() * hour(datetime) / 24) as hour_cos,
               sin(2 * pi() * (isodow(datetime) - 1) / 7) as day_sin,
               cos(2 * pi() * (isodow(datetime) - 1) / 7) as day_cos,
               cast(h.holiday_name is not null as int) as is_holiday,
               cast(coalesce(h.holiday_name = 'Thanksgiving', false) as int) as is_thanksgiving,
               cast(coalesce(h.holiday_name = 'Christmas Day', false) as int) as is_christmas,
               cast(coalesce(h.holiday_name = 'New Year''s Day', false) as int) as is_new_years,
               cast(coalesce(h.holiday_name = 'Independence Day', false) as int) as is_july4
          from model_frame f left join holidays h on cast(f.datetime as date) = h.date)
        window w as (partition by region order by datetime)"""),
    "hour_peaks": (("load_history",), """
        select region, cast(ts_local as date) as date,
               cast(arg_min(hour(ts_local), (-load, ts_local)) as int) as peak_hour, max(load) as load_max
        from load_history group by 1, 2"""),
}


def sql(body: str, *views: str) -> str:
    """``body`` behind WITH clauses for ``views`` and all they need."""
    order: list[str] = []

    def add(v: str) -> None:
        for need in VIEW_SQL[v][0]:
            add(need)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return body
    ctes = ",\n".join(f"{v} as ({VIEW_SQL[v][1]})" for v in order)
    return f"with {ctes}\n{body}"
