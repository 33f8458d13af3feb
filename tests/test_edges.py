"""Edge cases on hand-made frames, checked by hand or by brute force."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridcast.functions import calendar as cal, scalar as S, timeparse as tp
from gridcast.operators import aggregates as A, evaluation as E, joins as J, labels as L, layout as LY, relational as R
from gridcast.operators.blocks import dense_index
from gridcast.sources import dims, files, ingest as IN, landing as LD, payload

DAY0 = dt.date(2020, 1, 1)


def one(df):
    return df.collect()[0]


def clocks(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "s string").withColumn("w", F.expr("cast(s as timestamp_ntz)"))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_daylight_saving_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2016-11-06 00:00:00", "2016-11-06 01:30:00", "2016-11-06 02:00:00", "2016-03-13 01:59:59",
                 "2016-03-13 02:00:00", "2016-03-13 03:00:00"]
        out = clocks(spark, *texts).select(
            "s", tp.localize_or_null("w").isNull().alias("n"),
            tp.format_ts(tp.parse_fixed_ts("s", tp.ISO_SPACE), tp.ISO_SPACE).alias("p"),
            tp.format_ts(tp.utc_to_local("w"), tp.ISO_SPACE).alias("l"),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [r.n for r in out] == [False, True, False, False, True, False]
    assert [r.p for r in out] == texts
    assert out[0].l == "2016-11-05 20:00:00" and out[4].l == "2016-03-12 21:00:00"


def test_parse_formats_and_garbage(spark):
    df = spark.createDataFrame([("1/2/2016 12:00:00 AM",), ("01/02/2016 01:00:00 PM",), ("13/45/2016 1:00:00 AM",),
                                ("2016-01-02 05:06:07",), ("x",), (None,)], "s string")
    rows = df.select(tp.parse_fixed_ts("s").alias("a"), tp.parse_coalesced_ts("s").alias("b")).collect()
    assert [r.a for r in rows] == [dt.datetime(2016, 1, 2), dt.datetime(2016, 1, 2, 13), None, None, None, None]
    assert rows[3].b == dt.datetime(2016, 1, 2, 5, 6, 7) and rows[2].b is None and rows[4].b is None


def test_calendar_edges(spark):
    df = clocks(spark, "2021-01-03 05:00:00", "2020-12-31 00:00:00")
    a, b = df.select(*[c.alias(n) for n, c in cal.calendar_parts("w").items()],
                     cal.season_of_month(F.month("w")).alias("s"),
                     cal.season_year(F.year("w"), F.month("w")).alias("sy")).collect()
    assert (a.week_of_year, a.day_of_week, a.is_weekend, a.hour) == (53, 6, 1, 5)
    assert (b.s, b.sy, a.s, a.sy, b.day_of_year) == ("Winter", 2021, "Winter", 2021, 366)


def test_holidays_and_observed_days(spark):
    h = {r.date: r.holiday_name for r in dims.holiday_dimension(spark, 2020, 2025).collect()}
    assert h[dt.date(2024, 11, 28)] == "Thanksgiving"
    assert h[dt.date(2024, 5, 27)] == "Memorial Day"
    assert h[dt.date(2021, 7, 5)] == "Independence Day (observed)"
    assert h[dt.date(2021, 12, 24)] == "Christmas Day (observed)"
    assert h[dt.date(2021, 12, 31)] == "New Year's Day (observed)"
    assert h[dt.date(2021, 6, 18)] == "Juneteenth National Independence Day (observed)"
    assert dt.date(2020, 6, 19) not in h
    plain = {r.date for r in dims.holiday_dimension(spark, 2021, 2021, observed=False).collect()}
    assert dt.date(2021, 7, 5) not in plain and len(plain) == 11
    day = spark.createDataFrame([("Independence Day (observed)",), (None,)], "n string")
    f = day.select(*[c.alias(k) for k, c in cal.holiday_name_flags("n").items()]).collect()
    assert f[0].is_july4 == 0 and f[0].is_other_holiday == 1 and sum(f[1]) == 0


def test_argmax_ties_nulls_nan(spark):
    rows = [("a", 3, 5.0), ("a", 1, 5.0), ("a", 2, None), ("b", 4, None), ("c", 1, 1.0), ("c", 2, float("nan"))]
    df = spark.createDataFrame(rows, "region string, hour int, load double").withColumn("date", F.lit(DAY0))
    got = {r.region: r.peak_hour for r in A.argmax_hour(df).collect()}
    assert got == {"a": 1, "b": None, "c": 1}


def test_mark_peak_hour_one_row_per_day(spark):
    rows = [("a", h, float(h % 3)) for h in range(6)] + [("b", h, None) for h in range(3)]
    df = spark.createDataFrame(rows, "region string, hour int, load double").withColumn("date", F.lit(DAY0))
    out = L.mark_peak_hour(df, order=["hour"]).toPandas()
    assert out[out.is_peak_hour == 1][["region", "hour"]].values.tolist() == [["a", 2]]
    assert set(out[out.region == "a"].peak_hour_actual) == {2} and set(out[out.region == "b"].peak_hour_actual) == {-1}


def test_daily_aggregate_edges(spark):
    rows = [("a", 1.0, 50.0, None), ("b", 1.0, 40.0, 1.0), ("b", 3.0, 60.0, 2.0)]
    df = spark.createDataFrame(rows, "region string, load double, temperature double, precipitation double").withColumns(
        {"date": F.lit(DAY0), "humidity": F.lit(1.0), "wind_speed": F.lit(2.0)})
    got = {r.region: r for r in A.daily_weather_agg(df).collect()}
    assert got["a"].temperature_std is None and got["a"].precipitation_sum == 0 and got["a"].precipitation_max is None
    assert got["b"].load_max == 3.0 and math.isclose(got["b"].temperature_std, math.sqrt(200))
    d = A.daily_weather_agg(df, load=None)
    assert "load_max" not in d.columns
    deg = spark.createDataFrame([(None, 90.0, 10.0), (70.0, 90.0, None)], "m double, x double, n double").select(
        *[c.alias(k) for k, c in S.degree_days("m", "x", "n").items()]).collect()
    assert deg[0].hdd is None and deg[0].cdd is None and deg[1].cdd == 5.0 and deg[1].hdd == 0.0


def test_half_even_and_tolerance(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(S.round_half_even("x")).collect()] == [0, 2, 2, 0, 2]
    t = spark.createDataFrame([(23, 0), (5, 6)], "a int, b int").select(S.within_tolerance("a", "b")).collect()
    assert [r[0] for r in t] == [False, True]


def brute_labels(pdf, size, top):
    out = []
    for region, g in pdf.groupby("region"):
        g = g.sort_values("date").reset_index(drop=True)
        for i in range(len(g) - size + 1):
            w = g.iloc[i : i + size]
            best = w.assign(k=w.load_max.fillna(-np.inf)).sort_values(["k", "date"], ascending=[False, True]).date[:top]
            out += [(region, w.date.iloc[0], w.date.iloc[-1], d, int(d in set(best))) for d in w.date]
    return sorted(out)


@pytest.mark.parametrize("block", [9, 16, 256])
def test_rolling_labels_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = []
    for region, n in (("a", 130), ("b", 9), ("c", 10), ("d", 47)):
        days = sorted(rng.choice(900, n, replace=False).tolist())
        rows += [(region, DAY0 + dt.timedelta(days=d), None if rng.random() < 0.1 else float(rng.integers(0, 6))) for d in days]
    pdf = pd.DataFrame(rows, columns=["region", "date", "load_max"])
    df = spark.createDataFrame(rows, "region string, date date, load_max double")
    got = L.rolling_peak_day_labels(df, block=block)
    got = sorted((r.region, r.window_start, r.window_end, r.date, r.is_peak_day) for r in got.collect())
    assert got == brute_labels(pdf, 10, 2)


def test_adjacent_flags_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for region in "ab":
        for d in range(40):
            for h in sorted(rng.choice(24, int(rng.integers(1, 25)), replace=False).tolist()):
                rows.append((region, dt.datetime(2020, 6, 20) + dt.timedelta(days=d, hours=h)))
    df = spark.createDataFrame(rows, "region string, datetime timestamp_ntz").withColumn("date", F.to_date("datetime"))
    df = J.join_holiday(df, dims.holiday_dimension(spark, 2019, 2021))
    got = L.adjacent_holiday_flags(df).toPandas().sort_values(["region", "datetime"])
    for _, g in got.groupby("region"):
        assert g.is_day_before_holiday.tolist() == g.is_holiday.shift(-24).fillna(0).astype(int).tolist()
        assert g.is_day_after_holiday.tolist() == g.is_holiday.shift(24).fillna(0).astype(int).tolist()


def test_dense_index(spark):
    rows = [("a", DAY0 + dt.timedelta(days=37 * i)) for i in range(60)] + [("b", DAY0)]
    df = spark.createDataFrame(rows, "k string, d date").repartition(5)
    got = dense_index(df, ["k"], F.year("d"), ["d"]).orderBy("k", "d").collect()
    assert [r.idx for r in got] == [*range(60), 0]


def test_threshold_sweep_against_loop(spark):
    rng = np.random.default_rng(5)
    grid = np.arange(0.1, 1.0, 0.01)
    assert [r[0] for r in spark.range(90).select(E.threshold_at(F.col("id"))).collect()] == grid.tolist()
    rows = []
    for region in ("a", "b", "c", "low", "none"):
        for _ in range(400):
            p = float(rng.choice(grid)) if rng.random() < 0.3 else float(rng.random())
            p = {"low": 0.01, "none": p}.get(region, p)
            rows.append((region, p, int(region != "none" and rng.random() < 0.1 + 0.5 * p)))
    got = {r.region: (r.threshold, r.loss) for r in
           E.tune_threshold(spark.createDataFrame(rows, "region string, p double, is_peak_day int")).collect()}
    pdf = pd.DataFrame(rows, columns=["region", "p", "y"])
    for region, g in pdf.groupby("region"):
        loss = [4 * ((g.p < t) & (g.y == 1)).sum() + ((g.p >= t) & (g.y == 0)).sum() for t in grid]
        assert got[region] == (grid[int(np.argmin(loss))], min(loss)), region


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("b", 1, 1)], "region string, is_peak_day int, peak_day_pred int")
    got = {r.region: r for r in E.confusion_metrics(df, ["region"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].accuracy) == (0, 0, 0, 1)
    assert got["b"].f1 == 1 and got["b"].total_loss == 0
    w = {r.region: r for r in A.class_weights(df, "is_peak_day").collect()}
    assert w["a"].cost_pos_weight == 1.0 and w["a"].pos_weight is None and w["b"].balanced_pos == 0.5


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0)], "region string, x double, y double")
    z = E.standardize_by_region(df, E.scaling_stats(df, ["x", "y"]), ["x", "y"]).orderBy("x").collect()
    assert [(r.x, r.y) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]


def test_null_hour_meets_null_hour(spark):
    h = dt.datetime(2020, 1, 1, 5)
    load = spark.createDataFrame([("z", h, 1.0), ("z", None, 2.0), ("y", None, 3.0), ("z", h, 4.0)],
                                 "load_area string, dt_ept timestamp_ntz, mw double")
    wx = spark.createDataFrame([("z", None, 2, 20.0), ("z", None, 1, 10.0), ("z", h, 9, 90.0), ("z", h, 8, 80.0)],
                               "load_area string, wx_ept timestamp_ntz, o int, temp double")
    out = J.join_load_weather(load, wx, [F.col("o")], weather_cols=["temp"])
    assert {r.mw: r.temp for r in out.collect()} == {1.0: 80.0, 2.0: 10.0, 3.0: None, 4.0: 80.0}


def test_dedup_limits_groups_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = R.dedup_first(df, ["k"], [F.col("id").desc()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in out.collect()) == [997, 998, 999]


def test_historical_fallbacks(spark):
    d = lambda *a: dt.date(*a)
    train = [("a", d(2018, 7, 1), 5, 9.0), ("a", d(2019, 7, 1), 5, 9.0), ("a", d(2017, 7, 1), 8, 9.0),
             ("a", d(2019, 3, 3), 2, 1.0), ("a", d(2018, 3, 3), 2, 1.0), ("a", d(2017, 3, 3), 2, 1.0)]
    targets = [("a", d(2020, 7, 1)), ("a", d(2020, 2, 29)), ("new", d(2020, 7, 1))]
    out = L.historical_peak_hour(
        spark.createDataFrame(train, "region string, date date, hour int, load double"),
        spark.createDataFrame(targets, "region string, date date"),
    )
    assert {(r.region, r.date): r.pred for r in out.collect()} == dict(zip(targets, [5, 2, 17]))


def test_payload_without_times(spark):
    good = '{"hourly": {"time": ["2020-01-01T00:00", "2020-01-01T01:00"], "temperature_2m": [1.5, null]}}'
    df = spark.createDataFrame([("z", good), ("y", '{"error": 1}'), ("x", "not json")], "load_area string, payload string")
    rows = payload.explode_hourly_payload(df).collect()
    assert [(r.load_area, r.datetime_beginning_utc, r.temp, r.wind) for r in rows] == [
        ("z", "2020-01-01T00:00", 1.5, None), ("z", "2020-01-01T01:00", None, None)]


def test_csv_by_name(spark, tmp_path):
    head = "load_area,zone,mw,datetime_beginning_ept\n"
    (tmp_path / "hrl_load_metered_2019.csv").write_text(head + "AP,x,1.5,1/1/2019 1:00:00 AM\nAP,x,NaN,1/1/2019 2:00:00 AM\n")
    (tmp_path / "hrl_load_metered_2020.csv").write_text(head + "CE,y,,1/1/2020 1:00:00 AM\n")
    rows = files.scan_yearly_csv(spark, f"{tmp_path}/{files.LOAD_GLOB}").orderBy("datetime_beginning_ept").collect()
    assert [(r.load_area, r.mw, r.year) for r in rows] == [("AP", 1.5, 2019), ("CE", None, 2020), ("AP", None, 2019)] or [
        (r.load_area, r.mw, r.year) for r in rows] == [("AP", 1.5, 2019), ("AP", None, 2019), ("CE", None, 2020)]
    with pytest.raises(AnalysisException):
        files.scan_yearly_csv(spark, f"{tmp_path}/nothing_*.csv")


def test_line_has_755_values_for_29_zones(spark):
    zones = dims.default_zones(spark)
    hourly = zones.select(F.lit(DAY0).alias("date"), F.col("load_area").alias("region"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"),
                          F.col("zone_id").alias("z")).select("date", "region", "hour", (F.col("z") * 100 + F.col("hour")).alias("predicted_load"))
    hourly = hourly.where("region <> 'AP'")
    peaks = zones.select(F.lit(DAY0).alias("date"), F.col("load_area").alias("region"), F.lit(17).alias("peak_hour"))
    days = zones.where("load_area = 'VMEU'").select(F.lit(DAY0).alias("date"), F.col("load_area").alias("region"), F.lit(1).alias("peak_day_pred"))
    v = one(LY.forecast_line(hourly, peaks, days, zones)).line.split(",")
    assert len(v) == 755 and v[0] == '"2020-01-01"' and v[1:4] == ["100", "101", "102"]
    assert v[1 + 5 * 24 : 1 + 6 * 24] == ["0"] * 24 and v[697:726] == ["17"] * 29
    assert v[726:] == ["0"] * 28 + ["1"]
    assert one(LY.forecast_line(hourly, peaks, days, zones, float_format=True)).line.split(",")[1] == "100.0"


def test_scan_and_join_sizes_are_checked(spark):
    df = spark.range(20).select(F.col("id").alias("c"))
    with pytest.raises(ValueError):
        LY.bounded_values(df, "c", limit=10)
    assert LY.bounded_values(df, "c", limit=20) == list(range(20))


def test_general_times_with_fraction_offset_and_month_names(spark):
    wanted = {
        "2016-01-02 05:06:07.123": "2016-01-02 05:06:07.123",
        "2016-01-02T05:06:07Z": "2016-01-02 00:06:07",
        "2016-07-02 05:06:07+00:00": "2016-07-02 01:06:07",
        "1/2/2016 5:06 PM": "2016-01-02 17:06:00",
        "Jan 2, 2016": "2016-01-02 00:00:00",
        "2016-13-02": None,
    }
    df = spark.createDataFrame([(t,) for t in wanted], "t string")
    got = df.select("t", tp.parse_coalesced_ts("t").cast("string").alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == wanted


def test_holidays_of_any_year(spark):
    df = spark.sql("select explode(array(date'1899-12-25', date'2101-12-25', date'2101-12-26', null)) as date")
    got = J.join_holiday(df).orderBy(F.col("date").asc_nulls_last()).collect()
    assert [r["is_holiday"] for r in got] == [1, 1, 1, 0]  # 2101-12-25 is a Sunday, observed on the 26th


def test_forecast_of_an_unknown_zone_is_an_error(spark):
    hourly = spark.sql("select date'2020-01-01' as date, explode(array('A', 'B')) as region, 0 as hour, 5 as predicted_load")
    hours = spark.sql("select date'2020-01-01' as date, 'A' as region, 0 as peak_hour")
    days = spark.sql("select date'2020-01-01' as date, 'A' as region, 1 as peak_day_pred")
    zones = spark.sql("select 'A' as load_area, 1 as zone_id")
    with pytest.raises(Exception, match="no number of zone B"):
        LY.forecast_line(hourly, hours, days, zones).collect()
    assert LY.forecast_line(hourly.where("region = 'A'"), hours, days, zones).count() == 1


def test_zones_are_dealt_to_rows_of_a_bounded_size(spark):
    zones = spark.range(2_050).select(F.format_string("z%04d", "id").alias("z"))
    rows = J.key_rows(zones.unionAll(zones), "z").orderBy("_row").collect()
    assert [len(r["_keys"]) for r in rows] == [J.KEYS_PER_ROW, J.KEYS_PER_ROW, 50]
    assert [k for r in rows for k in r["_keys"]] == [f"z{i:04d}" for i in range(2_050)]


# Landing, ingest and null hours.


def _manifest(spark, *rows):
    return spark.createDataFrame([(z, dt.date(2020, m, 1), dt.date(2020, m, d)) for z, m, d in rows], "load_area string, start_date date, end_date date")


def _payload_rows(spark, *rows):
    out = []
    for z, m, d, hours in rows:
        times = ", ".join(f'"2020-{m:02d}-01T{h:02d}:00"' for h in range(hours))
        body = f'{{"hourly": {{"time": [{times}], "temperature_2m": {[float(m)] * hours}}}}}' if hours else '{"error": true}'
        out.append((z, dt.date(2020, m, 1), dt.date(2020, m, d), body))
    return spark.createDataFrame(out, "load_area string, start_date date, end_date date, payload string")


def test_landing_writes_only_what_is_open(spark, tmp_path):
    path = str(tmp_path)
    first = _manifest(spark, ("a", 1, 31), ("b", 1, 31), ("a", 2, 10))
    payloads = _payload_rows(spark, ("a", 1, 31, 3), ("b", 1, 31, 0), ("a", 2, 10, 2))
    assert {(r.load_area, r.start_date.month): r.n_rows for r in LD.land_weather(spark, first, payloads, path).collect()} == {("a", 1): 3, ("a", 2): 2}
    # The payload without hours stays open; a second run with nothing new writes nothing.
    assert [tuple(r)[:1] for r in LD.open_requests(spark, first, path).collect()] == [("b",)]
    january = {f: f.stat().st_mtime_ns for f in (tmp_path / "hours" / "start_date=2020-01-01").glob("*.parquet")}
    assert LD.land_weather(spark, first, payloads, path).isEmpty()
    # A month that grew is replaced, other months keep their files.
    LD.land_weather(spark, _manifest(spark, ("a", 2, 29)), _payload_rows(spark, ("a", 2, 29, 5)), path)
    assert january == {f: f.stat().st_mtime_ns for f in (tmp_path / "hours" / "start_date=2020-01-01").glob("*.parquet")}
    LD.land_weather(spark, first, _payload_rows(spark, ("b", 1, 31, 4)), path)
    rows = LD.read_hours(spark, path).groupBy("load_area", F.month("start_date").alias("m")).count().collect()
    assert {(r.load_area, r.m): r["count"] for r in rows} == {("a", 1): 3, ("a", 2): 5, ("b", 1): 4}
    one = LD.read_hours(spark, path).where("load_area = 'a' and datetime_beginning_utc = '2020-01-01T00:00:00'").first()
    assert str(one.local) == "2019-12-31 19:00:00" == one.datetime_beginning_ept


def test_rejected_lines_and_merged_rows_add_up(spark, tmp_path):
    load, wx = tmp_path / "hrl_load_metered_2020.csv", tmp_path / "weather_hourly_2020.csv"
    load.write_text(
        "datetime_beginning_ept,load_area,mw\n1/1/2020 1:00:00 AM,a,5\n1/1/2020 2:00:00 AM,a,x\nnever,a,6\n"
        "1/1/2020 3:00:00 AM,a\n1/1/2020 4:00:00 AM,a,7,8\n3/8/2020 2:00:00 AM,a,9\n1/1/2020 5:00:00 AM,b,1\n1/1/2020 6:00:00 AM,a,NaN\n"
    )
    wx.write_text(
        "datetime_beginning_utc,temp,humidity,dew_point,precip,wind,datetime_beginning_ept,load_area\n"
        "2020-01-01T06:00:00,1,2,3,4,5,2020-01-01 01:00:00,a\n2020-01-01T05:00:00,9,2,3,4,5,2020-01-01 01:00:00,a\n"
        "2020-01-01T11:00:00,bad,2,3,4,5,2020-01-01 06:00:00,a\n2020-03-08T07:00:00,7,2,3,4,5,2020-03-08 02:00:00,a\n"
    )
    merged, rejects = IN.ingest_merged(spark, str(load), str(wx))
    got = {(r.load_area, r.datetime_beginning_ept): (r.mw, r.temp) for r in merged.collect()}
    # The hour that the clock skips has no local time and meets the weather of such an hour.
    assert got == {
        ("a", "1/1/2020 1:00:00 AM"): (5.0, 9.0), ("a", "3/8/2020 2:00:00 AM"): (9.0, 7.0),
        ("b", "1/1/2020 5:00:00 AM"): (1.0, None), ("a", "1/1/2020 6:00:00 AM"): (None, None),
    }
    bad = sorted((r.source, r.reason, r.line) for r in rejects.collect())
    assert [b[:2] for b in bad] == [("load", IN.MALFORMED)] * 3 + [("load", IN.NO_TIME), ("weather", IN.MALFORMED)]
    assert "1/1/2020 4:00:00 AM,a,7,8" in [b[2] for b in bad] and len(got) + 4 == 8
    assert IN.ingest_merged(spark, str(load), str(wx), ["b"])[0].count() == 1


def test_null_hours_are_dealt_over_many_keys(spark):
    n = 6_400
    load = spark.range(n).select(F.lit("z").alias("load_area"), F.lit(None).cast("timestamp_ntz").alias("dt_ept"), F.col("id").cast("double").alias("mw"))
    wx = spark.range(50).select(
        F.lit("z").alias("load_area"), F.lit(None).cast("timestamp_ntz").alias("wx_ept"), F.col("id").alias("o"),
        *[(F.col("id") + 10.0).alias(c) for c in ("temp", "humidity", "dew_point", "precip", "wind")],
    )
    out = J.join_load_weather(load, wx.withColumn("o", 50 - F.col("o")), [F.col("o")])
    assert out.count() == n and {r.temp for r in out.select("temp").distinct().collect()} == {59.0}
    key = F.pmod(F.xxhash64("load_area", "dt_ept", "mw"), F.lit(J.NULL_KEYS))
    per_key = load.groupBy(key).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert per_key[1] == J.NULL_KEYS and per_key[0] < 2 * n / J.NULL_KEYS


def test_offsets_keep_their_fraction(spark):
    texts = ["2020-01-01 12:00:00.250000+0000", "2020-07-01T12:00:00.5+02:00", "2020-01-01T12:00:00Z", "Jan 5, 2020", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: str(r.v) for r in df.select("i", tp.parse_coalesced_ts("t").cast("string").alias("v")).collect()}
    assert got[0] == "2020-01-01 07:00:00.25" and got[2] == "2020-01-01 07:00:00" and got[3] == "2020-01-05 00:00:00" and got[4] == "None"


def test_zones_are_numbered_without_a_limit(spark):
    zones = spark.range(100_001).select(F.format_string("z%06d", 100_000 - F.col("id")).alias("load_area"), "id").repartition(13)
    got = dims.zone_ordinal(zones)
    assert got.where("zone_id != 100001 - id").isEmpty() and got.select("zone_id").distinct().count() == 100_001
    assert dims.zone_ordinal(zones.limit(0)).count() == 0


def test_sketches_merge_within_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 6).alias("year"), (F.col("id") % 20_000).alias("v"), F.lit(None).cast("string").alias("none"))
    kept = A.distinct_sketches(df, ["year"], {"v": "v", "none": "none"})
    assert kept.count() == 6
    got = one(A.merged_distinct(kept, ["v", "none"]))
    assert abs(got.v - 20_000) <= 3 * A.SKETCH_ERROR * 20_000 and got.none == 0


def test_grid_of_more_zones_than_a_row_holds(spark):
    zones = spark.range(2_500).select(F.format_string("z%04d", "id").alias("region"))
    df = spark.createDataFrame([(DAY0, "z0003", 1, 5.0), (DAY0 + dt.timedelta(1), "z2499", 0, 6.0)], "date date, region string, hour int, load double")
    grid = J.dense_grid(df, zones, hours=range(2))
    assert grid.count() == 2 * 2_500 * 2 and grid.where("load is not null").count() == 2
    assert J.dense_grid(df, zones.limit(0)).count() == 0


def test_calendar_date_history_equals_the_pairs(spark):
    d = lambda y, m=2, day=29: dt.date(y, m, day)
    rows = [("A", d(2000), 1.0), ("A", d(2000), 3.0), ("A", d(2004), None), ("A", d(2008), 7.0), ("A", None, 9.0), (None, d(2000), 5.0)]
    rows += [("B", d(y, 3, 1), float(y)) for y in range(1990, 2010)] + [("B", d(1999, 3, 1), -1.0)]
    history = spark.createDataFrame(rows, "region string, date date, load double")
    targets = history.select("region", "date").union(spark.createDataFrame([("C", d(2001, 3, 1)), ("A", d(2012))], "region string, date date")).distinct()
    pairs = R.same_calendar_date(targets, history).collect()
    got = R.calendar_date_history(targets, history, "load").where("region is not null and target_date is not null").collect()
    assert len(got) == targets.where("region is not null and date is not null").count()
    for r in got:
        mine = [p for p in pairs if (p.region, p.target_date) == (r.region, r.target_date)]
        loads = [p.load for p in mine if p.load is not None]
        want = (len(loads), sum(loads) / len(loads) if loads else None, min(loads, default=None), max(loads, default=None), max((p.date for p in mine), default=None))
        assert (r.n, r["mean"], r.least, r.greatest, r.latest) == want
    assert R.calendar_date_history(targets, history.limit(0), "load").where("n = 0").count() == targets.count()
    assert R.calendar_date_history(targets.limit(0), history, "load").count() == 0


def test_pivot_map_takes_any_number_of_names(spark):
    wide = LY.pivot_map(spark.range(30_000).selectExpr("id % 3 as k", "int(id / 3) as c", "double(id) as v"), ["k"], "c", F.avg("v"))
    rows = {r.k: r["values"] for r in wide.collect()}
    assert [len(rows[k]) for k in range(3)] == [10_000] * 3 and rows[2]["9999"] == 29_999.0
    odd = spark.createDataFrame([("a", None, 1.0), ("a", "x", None), (None, "y", 2.0), (None, "y", 4.0)], "k string, c string, v double")
    assert {r.k: r["values"] for r in LY.pivot_map(odd, ["k"], "c", F.avg("v")).collect()} == {"a": {"x": None}, None: {"y": 3.0}}


def test_clocks_are_localised_after_the_facts_are_reduced(spark):
    from gridcast.plans import views as V

    lines = V.model_frame(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Deeper nodes of a branch come later: nothing below the first aggregate of the load asks for a zone's offset.
    first = next(i for i, x in enumerate(lines) if "Aggregate" in x)
    assert not any("America/New_York" in x for x in lines[first + 1 :] if "Filter" in x)
    assert sum("America/New_York" in x for x in lines) > 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_plain_forms_are_read_as_by_the_formatter(spark, zone):
    texts = ["2000-02-29 00:00:00", "1900-02-29 00:00:00", "0000-01-01 00:00:00", "0001-01-01T00:00:00", "2000-01-01 24:00:00", "2000-01-01 23:59:60",
             "2000-01-01 23:59:59\n", "2000-01-01 23:59:59 ", "2000-1-1 00:00:00", "+12000-01-01 00:00:00", "no time", "2000-04-02T02:30:00", "", None]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for f in (tp.ISO_SPACE, tp.ISO_T):
            slow = tp._shift(tp._epoch(), F.unix_seconds(tp._instant("t", f)))
            assert df.where(~tp.parse_fixed_ts("t", f).eqNullSafe(slow)).isEmpty()
            assert "try_cast" in df.select(tp.parse_fixed_ts("t", f))._jdf.queryExecution().analyzed().toString().lower()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_line_times_are_parsed_once(spark, tmp_path):
    (tmp_path / "hrl_load_metered_2000.csv").write_text("datetime_beginning_ept,load_area,mw\n1/1/2000 1:00:00 AM,a,1\nno time,a,2\n1/1/2000 2:00:00 AM,a,n/a\n")
    lines = IN.scan_lines(spark, str(tmp_path), files.LOAD_SCHEMA, tp.parse_coalesced_ts("datetime_beginning_ept"))
    assert "at" in lines.columns and [r.at is None for r in lines.orderBy("datetime_beginning_ept").collect()].count(True) == 1
    rejects = IN._sorted_out(lines, "load")[1]
    assert "gettimestamp" not in rejects._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(r.reason for r in rejects.collect()) == [IN.MALFORMED, IN.NO_TIME]
