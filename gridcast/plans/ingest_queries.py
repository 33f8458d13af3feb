"""Scans, sinks, time parsing and the load-weather join."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions import timeparse as tp
from gridcast.functions.scalar import file_year
from gridcast.operators import joins as J, relational as R
from gridcast.plans import views as V
from gridcast.plans.registry import query
from gridcast.session import scratch_dir
from gridcast.sources import dims, files, ingest, landing, payload


def _load_rows(spark, sf):
    return V.load_history(spark, sf).select(
        tp.format_ts("ts_local").alias("datetime_beginning_ept"),
        F.col("region").alias("load_area"),
        F.col("load").alias("mw"),
        F.year("ts_local").alias("year"),
    )


def _landed_load(spark, sf) -> str:
    path = scratch_dir(spark, "load-csv")
    files.write_yearly_csv(_load_rows(spark, sf), path)
    return f"{path}/*{files.LOAD_GLOB}"


def _weather_rows(spark, sf):
    iso = tp.format_ts("ts_local", tp.ISO_T)
    return V.weather_history(spark, sf).select(
        iso.alias("datetime_beginning_utc"),
        "temp", "humidity", "dew_point", "precip", "wind",
        tp.format_ts("ts_local", tp.ISO_SPACE).alias("datetime_beginning_ept"),
        F.col("region").alias("load_area"),
        F.year("ts_local").alias("year"),
    )


_US = "strftime({}, '%-m/%-d/%Y %-I:%M:%S %p')"
_LOAD_CSV = f"""select {_US.format("ts_local")} as datetime_beginning_ept, region as load_area, load as mw,
                       cast(year(ts_local) as int) as year from load_history"""
_WX_CSV = """select strftime(ts_local, '%Y-%m-%dT%H:%M:%S') as datetime_beginning_utc, temp, humidity, dew_point,
                    precip, wind, strftime(ts_local, '%Y-%m-%d %H:%M:%S') as datetime_beginning_ept,
                    region as load_area from weather_history"""


@query("scan_yearly_csv", _LOAD_CSV, ("load_history",))
def scan_yearly_csv(spark, sf):
    return files.scan_yearly_csv(spark, _landed_load(spark, sf)).drop("source_path")


@query("scan_weather_csv", _WX_CSV, ("weather_history",))
def scan_weather_csv(spark, sf):
    path = scratch_dir(spark, "weather-csv")
    files.write_yearly_csv(_weather_rows(spark, sf), path, "weather_hourly")
    return files.scan_weather_csv(spark, f"{path}/{files.WEATHER_GLOB}").drop("source_path")


_MERGED = "select region, ts_local, dt, mw, temp, humidity, dew_point, precip, wind from merged"


@query("rescan_materialized", _MERGED, ("merged",))
def rescan_materialized(spark, sf):
    path = scratch_dir(spark, "merged")
    df = V.merged(spark, sf).withColumn("year", F.year("ts_local"))
    files.write_merged(df, path, partition_by=["year"])
    return files.rescan_materialized(spark, path).drop("year")


@query("write_merged", _MERGED, ("merged",))
def write_merged(spark, sf):
    path = scratch_dir(spark, "merged-csv")
    df = V.merged(spark, sf)
    files.write_merged(df, path, "csv")
    return files.rescan_materialized(spark, path, "csv", df.schema)


def _payloads(spark, sf):
    """One payload per zone and day; on the 13th it holds no hours."""
    rows = V.load_hourly(spark, sf).select(
        "load_area",
        F.to_date("dt_hour").alias("day"),
        F.struct(
            F.date_format("dt_hour", "yyyy-MM-dd'T'HH:mm").alias("t"), "mw", F.col("n_obs").cast("double").alias("n")
        ).alias("r"),
    )
    a = F.col("a")
    hourly = F.struct(
        a["t"].alias("time"),
        a["mw"].alias("temperature_2m"),
        a["n"].alias("relative_humidity_2m"),
        F.transform(a, lambda x: x["mw"] / 2).alias("dew_point_2m"),
        F.transform(a, lambda x: x["n"] + 1).alias("precipitation"),
        F.transform(a, lambda x: F.lit(None).cast("double")).alias("wind_speed_10m"),
    )
    full = F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"})
    return rows.groupBy("load_area", "day").agg(F.sort_array(F.collect_list("r")).alias("a")).select(
        "load_area", F.when(F.dayofmonth("day") == 13, F.lit('{"error": true}')).otherwise(full).alias("payload")
    )


_PAYLOAD = """select load_area, {} as datetime_beginning_utc, mw as temp, cast(n_obs as double) as humidity,
                     mw / 2 as dew_point, cast(n_obs + 1 as double) as precip, cast(null as double) as wind
              from load_hourly where day(dt_hour) <> 13"""


@query("explode_hourly_payload", _PAYLOAD.format("strftime(dt_hour, '%Y-%m-%dT%H:%M')"), ("load_hourly",))
def explode_hourly_payload(spark, sf):
    return payload.explode_hourly_payload(_payloads(spark, sf))


@query(
    "filter_payload_range",
    _PAYLOAD.format("dt_hour")
    + " and dt_hour between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-20 23:00:00'",
    ("load_hourly",),
)
def filter_payload_range(spark, sf):
    rows = payload.explode_hourly_payload(_payloads(spark, sf))
    rows = rows.withColumn(
        "datetime_beginning_utc", tp.parse_fixed_ts(tp.pad_seconds("datetime_beginning_utc"), tp.ISO_T)
    )
    day = F.to_date(F.lit("2024-01-10")), F.to_date(F.lit("2024-01-20"))
    return payload.filter_payload_range(rows, "datetime_beginning_utc", *day)


@query("write_weather_by_year", _WX_CSV + " order by all", ("weather_history",))
def write_weather_by_year(spark, sf):
    path = scratch_dir(spark, "weather-by-year")
    files.write_weather_by_year(_weather_rows(spark, sf), path)
    return files.scan_weather_csv(spark, f"{path}/year=*").drop("source_path")


@query(
    "scan_audit",
    """select cast(year(ts_local) as int) as file_year, count(*) as n_rows, count(distinct region) as n_areas
       from load_history group by 1""",
    ("load_history",),
)
def scan_audit(spark, sf):
    scan = files.scan_csv(spark, _landed_load(spark, sf), files.LOAD_SCHEMA)
    return files.scan_audit(scan.withColumn("file_year", file_year("source_path")), "file_year")


@query(
    "zone_dimension",
    "select n_name as load_area, n_nationkey, cast(row_number() over (order by n_name) as int) as zone_id from nation",
)
def zone_dimension(spark, sf):
    return dims.zone_ordinal(V.table(spark, sf, "nation").select(F.col("n_name").alias("load_area"), "n_nationkey"))


@query(
    "zone_ordinal",
    """select l.load_area, l.dt_hour, l.mw, z.zone_id from load_hourly l join (
         select load_area, cast(row_number() over (order by load_area) as int) as zone_id
         from (select distinct load_area from load_hourly)) z using (load_area)""",
    ("load_hourly",),
)
def zone_ordinal(spark, sf):
    load = V.load_hourly(spark, sf)
    zones = dims.zone_ordinal(R.distinct_values(load, ["load_area"]))
    return load.select("load_area", "dt_hour", "mw").join(zones, "load_area")


@query(
    "holiday_dimension",
    """select date, holiday_name from holidays
       where date between (select make_date(min(year(l_shipdate)), 1, 1) from lineitem)
                      and (select make_date(max(year(l_shipdate)), 12, 31) from lineitem)""",
    ("holidays",),
)
def holiday_dimension(spark, sf):
    return dims.holiday_dimension_of(V.table(spark, sf, "lineitem"), "l_shipdate")


@query(
    "request_manifest",
    """select n_name as load_area, m as start_date,
              least(cast(last_day(m) as date), date '2001-06-15') as end_date, cast(year(m) as int) as year
       from nation, (select cast(g as date) as m
                     from generate_series(timestamp '1995-01-01', timestamp '2001-12-01', interval 1 month) t(g))
       where m <= date '2001-06-15'""",
)
def request_manifest(spark, sf):
    zones = V.table(spark, sf, "nation").select(F.col("n_name").alias("load_area"))
    return dims.request_manifest(zones, 1995, 2001, F.to_date(F.lit("2001-06-15")))


# Time functions.


@query(
    "parse_fixed_ts",
    "select region, ts_local as t_us, ts_local as t_space, ts_local as t_iso from load_history",
    ("load_history",),
)
def parse_fixed_ts(spark, sf):
    t = V.load_history(spark, sf).select("region", *[
        tp.format_ts("ts_local", f).alias(n)
        for f, n in ((tp.US_12H, "t_us"), (tp.ISO_SPACE, "t_space"), (tp.ISO_T, "t_iso"))
    ])
    return t.select(
        "region",
        tp.parse_fixed_ts("t_us").alias("t_us"),
        tp.parse_fixed_ts("t_space", tp.ISO_SPACE).alias("t_space"),
        tp.parse_fixed_ts("t_iso", tp.ISO_T).alias("t_iso"),
    )


@query(
    "parse_coalesced_ts",
    """select event_id, case event_id % 8 when 2 then cast(cast(ts as date) as timestamp) when 3 then null
              when 4 then ts when 5 then date_trunc('second', ts) - interval 3 hour when 6 then ts - interval 8 hour
              when 7 then cast(cast(ts as date) as timestamp) else date_trunc('second', ts) end as t from events""",
)
def parse_coalesced_ts(spark, sf):
    kind, micros = F.col("event_id") % 8, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = (
        F.when(kind == 0, tp.format_ts("ts"))
        .when(kind == 1, tp.format_ts("ts", tp.ISO_SPACE))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 4, micros)
        # January in New York: five hours behind UTC.
        .when(kind == 5, F.concat(tp.format_ts("ts", tp.ISO_T), F.lit("-02:00")))
        .when(kind == 6, F.concat(micros, F.lit("+0300")))
        .when(kind == 7, F.date_format("ts", "MMM d, yyyy"))
        .otherwise(F.concat(F.lit("no date "), F.col("event_id").cast("string")))
    )
    return V.table(spark, sf, "events").select("event_id", tp.parse_coalesced_ts(text).alias("t"))


@query("localize_or_null", "select region, ts_local, dt from merged", ("merged",))
def localize_or_null(spark, sf):
    return V.load_history(spark, sf).select("region", "ts_local", tp.localize_or_null("ts_local").alias("dt"))


@query(
    "utc_to_local",
    """select region, u, u - to_hours(case when u >= spring and u < autumn then 4 else 5 end) as et from (
         select region, ts_local as u,
                cast(make_date(year(ts_local), 4, 7) as timestamp)
                  - to_days(cast(isodow(make_date(year(ts_local), 4, 7)) % 7 as int)) + interval 7 hour as spring,
                cast(make_date(year(ts_local), 10, 31) as timestamp)
                  - to_days(cast(isodow(make_date(year(ts_local), 10, 31)) % 7 as int)) + interval 6 hour as autumn
         from load_history)""",
    ("load_history",),
)
def utc_to_local(spark, sf):
    load = V.load_history(spark, sf)
    return load.select("region", F.col("ts_local").alias("u"), tp.utc_to_local("ts_local").alias("et"))


@query("floor_hour", "select event_id, date_trunc('hour', ts) as h from events")
def floor_hour(spark, sf):
    return V.table(spark, sf, "events").select("event_id", tp.floor_hour("ts").alias("h"))


@query(
    "format_ts",
    f"""select event_id, {_US.format("ts")} as us, strftime(ts, '%Y-%m-%d %H:%M:%S') as iso,
               strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso_t from events""",
)
def format_ts(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id",
        tp.format_ts("ts").alias("us"),
        tp.format_ts("ts", tp.ISO_SPACE).alias("iso"),
        tp.format_ts("ts", tp.ISO_T).alias("iso_t"),
    )


@query("pad_seconds", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M') || case when event_id % 2 = 0 then ':00' "
       "else strftime(ts, ':%S') end as t from events")
def pad_seconds(spark, sf):
    short = tp.format_ts("ts", "yyyy-MM-dd'T'HH:mm")
    text = F.when(F.col("event_id") % 2 == 0, short).otherwise(tp.format_ts("ts", tp.ISO_T))
    return V.table(spark, sf, "events").select("event_id", tp.pad_seconds(text).alias("t"))


@query("file_name_token", "select region, ts_local, cast(year(ts_local) as int) as year from load_history",
       ("load_history",))
def file_name_token(spark, sf):
    name = F.concat(F.lit("/data/raw/hrl_load_metered_"), F.year("ts_local").cast("string"), F.lit(".csv"))
    return V.load_history(spark, sf).select("region", "ts_local", file_year(name).alias("year"))


@query(
    "relative_dates",
    """select o_orderkey, cast(o_orderdate as date) + 1 as tomorrow, cast(last_day(o_orderdate) as date) as month_end,
              least(cast(last_day(o_orderdate) as date), date '1998-06-15') as request_end from orders""",
)
def relative_dates(spark, sf):
    day = F.to_date("o_orderdate")
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        tp.next_day_of(day).alias("tomorrow"),
        tp.month_end(day).alias("month_end"),
        tp.month_end(day, F.to_date(F.lit("1998-06-15"))).alias("request_end"),
    )


# Deduplication and the main join.


@query(
    "dedup_first",
    """select load_area, wx_hour, order_utc, event_id, temp, humidity, precip, wind from (
         select *, row_number() over (partition by load_area, wx_hour order by order_utc, event_id) as rn
         from weather_obs) where rn = 1""",
    ("weather_obs",),
)
def dedup_first(spark, sf):
    obs = V.weather_obs(spark, sf)
    return R.dedup_first(obs, ["load_area", "wx_hour"], [F.col("order_utc").asc_nulls_last(), F.col("event_id")])


@query(
    "dedup_report",
    """select count(*) as n_before, count(distinct (load_area, wx_hour)) as n_after,
              count(*) - count(distinct (load_area, wx_hour)) as n_removed from weather_obs""",
    ("weather_obs",),
)
def dedup_report(spark, sf):
    return R.dedup_report(V.weather_obs(spark, sf), ["load_area", "wx_hour"])


@query("join_load_weather", _MERGED.replace("merged", "merged_part"), ("merged_part",))
def join_load_weather(spark, sf):
    # Without the weather rows of one flag, so that some hours have none.
    return V.merged(spark, sf, without_flag="R")


@query(
    "join_holiday",
    """select region, ts_local, h.holiday_name, cast(h.date is not null as int) as is_holiday
       from load_history l left join holidays h on cast(l.ts_local as date) = h.date""",
    ("load_history", "holidays"),
)
def join_holiday(spark, sf):
    load = V.load_history(spark, sf).withColumn("date", F.to_date("ts_local"))
    return J.join_holiday(load).select("region", "ts_local", "holiday_name", "is_holiday")


# From text files to the merged table, some lines damaged.


def _damaged(df, number, time, bad_number, bad_time):
    """The rows as text, with numbers that are none and times that are none."""
    return df.withColumns({
        number: F.when(bad_number, F.lit("n/a")).otherwise(F.col(number).cast("string")),
        time: F.when(bad_time, F.lit("no time")).otherwise(F.col(time)),
    })


def _ingested(spark, sf):
    load, wx = scratch_dir(spark, "ingest-load"), scratch_dir(spark, "ingest-weather")
    kind = F.col("mw").cast("bigint") % 50
    files.write_yearly_csv(_damaged(_load_rows(spark, sf), "mw", "datetime_beginning_ept", kind == 7, kind == 8), load)
    kind = F.col("wind").cast("bigint") % 20
    files.write_yearly_csv(_damaged(_weather_rows(spark, sf), "temp", "datetime_beginning_ept", kind == 3, kind == 4), wx, "weather_hourly")
    return ingest.ingest_merged(spark, f"{load}/*{files.LOAD_GLOB}", f"{wx}/{files.WEATHER_GLOB}")


_DST_OR_NULL = f"case when {V._DST.format(t='ts_local')} then null else ts_local end"


@query(
    "ingest_merged",
    f"""select l.region as load_area, l.load as mw, cast(year(l.ts_local) as int) as year, {_US.format("l.ts_local")} as datetime_beginning_ept,
               l.dt, w.temp, w.humidity, w.dew_point, w.precip, w.wind
        from (select *, {_DST_OR_NULL} as dt from load_history where load % 50 not in (7, 8)) l
        left join (
          select * from (
            select *, row_number() over (partition by region, wx order by ts_local, temp, humidity, dew_point nulls last, precip, wind) as rn
            from (select *, {_DST_OR_NULL} as wx from weather_history where wind % 20 not in (3, 4)))
          where rn = 1) w
        on l.region = w.region and l.dt is not distinct from w.wx""",
    ("load_history", "weather_history"),
)
def ingest_merged(spark, sf):
    return _ingested(spark, sf)[0]


@query(
    "ingest_rejects",
    """select 'load' as source, cast(year(ts_local) as int) as year,
              case load % 50 when 7 then 'malformed line' else 'unreadable time' end as reason, count(*) as n
       from load_history where load % 50 in (7, 8) group by 1, 2, 3
       union all
       select 'weather', cast(year(ts_local) as int),
              case wind % 20 when 3 then 'malformed line' else 'unreadable time' end, count(*)
       from weather_history where wind % 20 in (3, 4) group by 1, 2, 3""",
    ("load_history", "weather_history"),
)
def ingest_rejects(spark, sf):
    rejects = _ingested(spark, sf)[1]
    return rejects.groupBy("source", file_year("source_path").alias("year"), "reason").agg(F.count(F.lit(1)).alias("n"))


# Landing of weather payloads: two runs, the second with a later date.


def _landing_payloads(spark, sf, manifest):
    """The payload of each request: the hours of its month up to its last day."""
    hours = V.load_history(spark, sf).select(
        F.col("region").alias("load_area"), F.trunc("ts_local", "month").alias("start_date"),
        F.struct(F.substring(tp.format_ts("ts_local", tp.ISO_T), 1, 16).alias("t"), "load").alias("r"), F.to_date("ts_local").alias("day"),
    )
    rows = manifest.select(*landing.KEYS).join(hours, ["load_area", "start_date"]).where(F.col("day") <= F.col("end_date"))
    a = F.col("a")
    hourly = F.struct(a["t"].alias("time"), a["load"].alias("temperature_2m"))
    grouped = rows.groupBy(*landing.KEYS).agg(F.sort_array(F.collect_list("r")).alias("a"))
    return grouped.select(*landing.KEYS, F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))


@query(
    "land_weather",
    """select region as load_area, cast(date_trunc('month', u) as date) as start_date, strftime(u, '%Y-%m-%dT%H:%M:%S') as datetime_beginning_utc,
              u as utc, et as local, strftime(et, '%Y-%m-%d %H:%M:%S') as datetime_beginning_ept, load as temp
       from (select region, u, load, u - to_hours(case when u >= spring and u < autumn then 4 else 5 end) as et from (
         select region, ts_local as u, load,
                cast(make_date(year(ts_local), 4, 7) as timestamp)
                  - to_days(cast(isodow(make_date(year(ts_local), 4, 7)) % 7 as int)) + interval 7 hour as spring,
                cast(make_date(year(ts_local), 10, 31) as timestamp)
                  - to_days(cast(isodow(make_date(year(ts_local), 10, 31)) % 7 as int)) + interval 6 hour as autumn
         from load_history))
       where u < timestamp '2001-06-16'""",
    ("load_history",),
)
def land_weather(spark, sf):
    path = scratch_dir(spark, "landing")
    zones = V.table(spark, sf, "region").select(F.col("r_name").alias("load_area"))
    for as_of in ("1998-06-15", "2001-06-15"):
        manifest = dims.request_manifest(zones, 1992, 2001, F.to_date(F.lit(as_of)))
        landing.land_weather(spark, manifest, _landing_payloads(spark, sf, manifest), path)
    return landing.read_hours(spark, path).select(
        "load_area", "start_date", "datetime_beginning_utc", "utc", "local", "datetime_beginning_ept", "temp"
    )
