"""Output layouts: pivots, nested cube and the forecast line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.scalar import hour_label
from gridcast.operators.joins import dense_grid
from gridcast.operators.relational import broadcast_if_small


def bounded_values(df: DataFrame, c: str, limit: int = 2_000) -> list:
    """Sorted distinct values for pivot columns; fails beyond ``limit`` instead of dropping some."""
    rows = df.select(c).distinct().orderBy(c).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {c}; use the long form")
    return [r[0] for r in rows]


def pivot_region_hour(
    df: DataFrame, regions: Sequence[str], date: str = "date", region: str = "region", hour: str = "hour",
    value: str = "predicted_load",
) -> DataFrame:
    """AG18: a row per date, a column ``<region>_<hh>`` per zone and hour, mean value."""
    names = [f"{r}_{h:02d}" for r in regions for h in range(24)]
    key = F.concat_ws("_", F.col(region), F.format_string("%02d", F.col(hour)))
    return df.withColumn("_c", key).groupBy(date).pivot("_c", names).agg(F.avg(value))


def pivot_hours(
    df: DataFrame, keys: Sequence[str] = ("date", "region"), hour: str = "hour", value: str = "predicted_load"
) -> DataFrame:
    """AG18: a row per (date, zone), columns hour_00..hour_23."""
    names = [f"hour_{h:02d}" for h in range(24)]
    return df.withColumn("_c", hour_label(hour)).groupBy(*keys).pivot("_c", names).agg(F.avg(value))


def pivot_dates(
    df: DataFrame, dates: Sequence, region: str = "region", date: str = "date", value: str = "peak_hour"
) -> DataFrame:
    """AG18: a row per zone, a column per date, both in order."""
    return (
        df.withColumn("_c", F.col(date).cast("string"))
        .groupBy(region)
        .pivot("_c", [str(d) for d in sorted(dates)])
        .agg(F.max(value))
        .orderBy(region)
    )


def pivot_map(df: DataFrame, keys: Sequence[str], name: Column | str, value: Column, entries: str = "values") -> DataFrame:
    """AG18 without a limit: a row per key with a map from each value of ``name``, as text, to the aggregate
    ``value``.

    No name passes through the driver and no plan grows with their number; read one as ``values['x']``.
    Entries are in the order of their names. Rows without a name are left out. Facts shrink to one row per
    key and name before the second exchange; a key's map is one value, so its names must fit a row.
    """
    named = df.withColumn("_name", (F.col(name) if isinstance(name, str) else name).cast("string")).where("_name is not null")
    cells = named.groupBy(*keys, "_name").agg(value.alias("_value"))
    listed = F.sort_array(F.collect_list(F.struct("_name", "_value")))
    return cells.groupBy(*keys).agg(F.map_from_entries(listed).alias(entries))


def load_cube(
    df: DataFrame, zones: DataFrame, date: str = "date", region: str = "region", hour: str = "hour",
    value: str = "predicted_load",
) -> DataFrame:
    """AG19: per date an array over the zones (by name) of arrays over the 24 hours, holes null.

    A date's cube has zones x 24 entries whatever the size of the data.
    """
    grid = dense_grid(df, zones, date, region, hour, [value])
    rows = grid.groupBy(date, region).agg(F.sort_array(F.collect_list(F.struct(hour, value))).alias("_h"))
    by_zone = F.sort_array(F.collect_list(F.struct(region, F.transform("_h", lambda x: x[value]).alias("v"))))
    return rows.groupBy(date).agg(by_zone.alias("_z")).select(date, F.transform("_z", lambda z: z["v"]).alias("cube"))


def join_values(df: DataFrame, date: str = "date", slot: str = "slot", value: str = "value") -> DataFrame:
    """per date one text line, the quoted date and the values by slot, separated by commas."""
    slots = F.sort_array(F.collect_list(F.struct(F.col(slot), F.col(value).cast("string").alias("v"))))
    quoted = F.concat(F.lit('"'), F.col(date).cast("string"), F.lit('"'))
    return (
        df.groupBy(date)
        .agg(slots.alias("_s"))
        .select(date, F.concat_ws(",", quoted, F.transform("_s", lambda s: s["v"])).alias("line"))
    )


def forecast_line(
    hourly: DataFrame,
    peak_hours: DataFrame,
    peak_days: DataFrame,
    zones: DataFrame,
    dates: DataFrame | None = None,
    date: str = "date",
    region: str = "region",
    zone_id: str = "zone_id",
    missing: str = "0",
    float_format: bool = False,
) -> DataFrame:
    """ML26: per date 24 loads of every zone, then its peak hours, then its peak-day flags.

    ``zones`` numbers the zones from 1; with Z of them the line has 1 + 26 Z values. A value without
    a forecast is ``missing``, one with several is their mean. A forecast of a zone without a number is
    an error. ``float_format`` writes loads as ``855.0`` instead of ``855``.
    """
    z = broadcast_if_small(zones.select(F.col("load_area").alias(region), F.col(zone_id).alias("_z")))
    n = zones.agg(F.max(zone_id)).scalar()
    load_type = "double" if float_format else "bigint"

    def slots(df: DataFrame, slot: Column, value: Column) -> DataFrame:
        unknown = F.raise_error(F.concat(F.lit("no number of zone "), F.coalesce(F.col(region).cast("string"), F.lit("null"))))
        numbered = df.join(z, region, "left").withColumn("_z", F.coalesce("_z", unknown.cast("int")))
        return numbered.select(date, slot.cast("int").alias("slot"), value.cast("double").alias("value"))

    known = (
        slots(hourly, (F.col("_z") - 1) * 24 + F.col("hour"), F.col("predicted_load").cast(load_type))
        .unionByName(slots(peak_hours, n * 24 + F.col("_z") - 1, F.col("peak_hour").cast("int")))
        .unionByName(slots(peak_days, n * 25 + F.col("_z") - 1, F.col("peak_day_pred").cast("int")))
    )
    days = (hourly.select(date).distinct() if dates is None else dates.select(date).distinct())
    empty = days.select(
        date, F.explode(F.sequence(F.lit(0), (n * 26 - 1).cast("int"))).alias("slot"), F.lit(None).cast("double").alias("value")
    )
    wanted = known.join(days, date, "left_semi") if dates is not None else known
    # One exchange on the date serves both aggregations; a date has 26 Z slots.
    filled = (
        wanted.unionByName(empty)
        .repartition(date)
        .groupBy(date, "slot")
        .agg(F.avg("value").alias("value"))
    )
    shown = F.when(F.col("slot") < n * 24, F.col("value").cast(load_type).cast("string"))
    shown = shown.otherwise(F.col("value").cast("int").cast("string"))
    filled = filled.select(date, "slot", F.coalesce(shown, F.lit(missing)).alias("value"))
    return join_values(filled, date)
