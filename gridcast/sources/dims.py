"""Small generated dimensions: zones, holidays, download requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridcast.functions.calendar import holiday_rule, holiday_rule_observed
from gridcast.functions.timeparse import month_end
from gridcast.session import written

# The 29 load areas with latitude and longitude, in output order.
ZONES = (
    ("AECO", 39.45, -74.50),
    ("AEPAPT", 37.25, -81.30),
    ("AEPIMP", 38.45, -81.60),
    ("AEPKPT", 38.20, -83.10),
    ("AEPOPT", 39.90, -82.90),
    ("AP", 37.30, -80.90),
    ("BC", 40.80, -79.95),
    ("CE", 41.85, -86.10),
    ("DAY", 39.75, -84.20),
    ("DEOK", 39.10, -84.50),
    ("DOM", 37.55, -77.45),
    ("DPLCO", 38.90, -75.50),
    ("DUQ", 40.45, -79.90),
    ("EASTON", 39.55, -75.10),
    ("EKPC", 37.75, -84.30),
    ("JC", 40.35, -74.65),
    ("ME", 40.20, -76.00),
    ("OE", 41.10, -81.25),
    ("OVEC", 38.85, -82.85),
    ("PAPWR", 40.70, -77.80),
    ("PE", 40.00, -75.20),
    ("PEPCO", 38.90, -76.95),
    ("PLCO", 40.95, -77.40),
    ("PN", 41.15, -77.80),
    ("PS", 40.75, -74.15),
    ("RECO", 41.00, -74.10),
    ("SMECO", 38.40, -76.70),
    ("UGI", 40.25, -75.65),
    ("VMEU", 37.30, -76.00),
)
ZONE_NAMES = tuple(z[0] for z in ZONES)


def default_zones(spark: SparkSession) -> DataFrame:
    return zone_ordinal(spark.createDataFrame(list(ZONES), "load_area string, lat double, lon double"))


def zone_ordinal(zones: DataFrame, name: str = "load_area", as_name: str = "zone_id") -> DataFrame:
    """SRC5, W6: number the rows of a zone dimension by name; the number is the output slot.

    The rows are range-partitioned by name and written with their place within the partition; a count per
    partition gives where each partition starts. So no task holds the dimension, whatever its size.
    """
    columns = zones.columns
    ordered = zones.repartitionByRange(name).sortWithinPartitions(name, *[c for c in columns if c != name])
    # Partition and row, in the order of both; written, so that both readings below see the same places.
    placed = written(ordered.withColumn("_place", F.monotonically_increasing_id()), "zones")
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, not per zone.
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.select(*columns, (F.col("_start") + row + 1).cast("int").alias(as_name))


def _holidays(days: DataFrame, observed: bool) -> DataFrame:
    rule = holiday_rule_observed("date") if observed else holiday_rule("date")
    return days.select("date", rule.alias("holiday_name")).where(F.col("holiday_name").isNotNull())


def _days(y0: Column, y1: Column) -> Column:
    return F.explode(F.sequence(F.make_date(y0, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(12), F.lit(31))))


def holiday_dimension(spark: SparkSession, y0: int = 1900, y1: int = 2100, observed: bool = True) -> DataFrame:
    """SRC6: (date, holiday_name); at most about 20 rows per year, so its size is known up front."""
    return _holidays(spark.range(1).select(_days(F.lit(y0), F.lit(y1)).alias("date")), observed)


def holiday_dimension_of(df: DataFrame, ts: str, observed: bool = True) -> DataFrame:
    """SRC6 for the years that occur in ``df``."""
    span = df.agg(F.min(F.year(ts)).alias("y0"), F.max(F.year(ts)).alias("y1"))
    return _holidays(span.select(_days(F.col("y0"), F.col("y1")).alias("date")), observed)


def request_manifest(zones: DataFrame, y0: int, y1: int, as_of: Column) -> DataFrame:
    """SRC7: zone x month requests, none in the future, none that ends after the run date."""
    months = F.explode(
        F.sequence(F.to_date(F.lit(f"{y0}-01-01")), F.to_date(F.lit(f"{y1}-12-01")), F.expr("interval 1 month"))
    )
    return (
        zones.withColumn("start_date", months)
        .where(F.col("start_date") <= as_of)
        .withColumn("end_date", month_end("start_date", as_of))
        .withColumn("year", F.year("start_date"))
    )
