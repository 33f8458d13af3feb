"""Landing of weather payloads (SRC7 -> SRC4 -> F9, F4 -> SNK2): only what has not landed yet, month by month.

    <path>/hours    hourly rows, one folder per month of the requests
    <path>/landed   one row (zone, start_date, end_date, n_rows) per request that has landed

A month's folder is replaced as a whole, so a run that is cut off between the two tables is repaired by
the next one, which finds its requests still open and writes the same rows again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.functions import timeparse as tp
from gridcast.session import written
from gridcast.sources.payload import explode_hourly_payload

KEYS = ("load_area", "start_date", "end_date")
HOURS = (
    "load_area string, datetime_beginning_utc string, temp double, humidity double, dew_point double, precip double, "
    "wind double, utc timestamp_ntz, local timestamp_ntz, datetime_beginning_ept string, start_date date"
)
LANDED = "load_area string, start_date date, end_date date, n_rows bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_hours(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/hours", HOURS)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/landed", LANDED)


def open_requests(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Requests of the manifest that have not landed. A month that has landed up to an earlier day is open."""
    return manifest.join(read_landed(spark, path), list(KEYS), "left_anti")


def land_weather(spark: SparkSession, manifest: DataFrame, payloads: DataFrame, path: str, zone: str = tp.LOCAL_ZONE) -> DataFrame:
    """Land the payloads (load_area, start_date, end_date, payload) of open requests; returns (load_area,
    start_date, end_date, n_rows) of what landed now.

    A payload without hours stays open and is asked for again. A zone's month that lands anew replaces the
    rows it had; other months' folders are not touched. A run without open requests writes nothing.
    """
    todo = payloads.join(open_requests(spark, manifest, path).select(*KEYS).distinct(), list(KEYS), "left_semi")
    rows = explode_hourly_payload(todo, "payload", KEYS)
    rows = rows.withColumn("datetime_beginning_utc", tp.pad_seconds("datetime_beginning_utc"))
    rows = rows.withColumn("utc", tp.parse_fixed_ts("datetime_beginning_utc", tp.ISO_T))
    rows = rows.withColumn("local", tp.utc_to_local("utc", zone)).withColumn("datetime_beginning_ept", tp.format_ts("local", tp.ISO_SPACE))
    rows = written(rows, "landing")
    landed = written(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")), "landing-requests")
    if landed.isEmpty():
        return landed
    columns = [c.split()[0] for c in HOURS.split(", ")]
    months = landed.select("start_date").distinct()
    before = read_hours(spark, path).join(F.broadcast(months), "start_date", "left_semi")
    before = before.join(landed.select("load_area", "start_date"), ["load_area", "start_date"], "left_anti")
    # Staged first: a folder cannot be read and replaced by one job.
    month = written(before.select(columns).unionByName(rows.select(columns)), "landing-months")
    (
        month.hint("rebalance", F.col("start_date"))
        .sortWithinPartitions("start_date", "utc", "load_area")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("start_date")
        .parquet(f"{path}/hours")
    )
    landed.write.mode("append").parquet(f"{path}/landed")
    return landed
