"""From yearly text files to the merged table, with a table of the lines that could not be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridcast.functions import timeparse as tp
from gridcast.functions.scalar import file_year, nan_to_null
from gridcast.operators.joins import join_load_weather
from gridcast.operators.relational import dedup_first, filter_in_list
from gridcast.session import written
from gridcast.sources.files import LOAD_SCHEMA, WEATHER_SCHEMA

MALFORMED, NO_TIME = "malformed line", "unreadable time"


def scan_lines(spark: SparkSession, path: str, schema: T.StructType, at: Column) -> DataFrame:
    """Every line of the files as a row of ``schema``, with ``source_path``, ``bad_line``: the text of a line
    that does not fit (values missing, too many, or not numbers), else null, and its wall clock ``at``.

    Text and time are parsed once and written, so both outcomes of a line come from the same parse and no
    condition on the time tries its formats again. NaN becomes null.
    """
    full = T.StructType([*schema, T.StructField("bad_line", T.StringType())])
    df = (
        spark.read.schema(full)
        .options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_line")
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("source_path"))
    )
    cols = [nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema]
    return written(df.select(*cols, "source_path", "bad_line", at.alias("at")), "lines")


def _sorted_out(lines: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows with their wall clock ``at``, and the rejects."""
    judged = lines.withColumn("reason", F.when(F.col("bad_line").isNotNull(), MALFORMED).when(F.col("at").isNull(), NO_TIME))
    line = F.coalesce("bad_line", F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in lines.columns[:-3]]))
    rejects = judged.where("reason is not null").select(F.lit(source).alias("source"), "source_path", "reason", line.alias("line"))
    return judged.where("reason is null").drop("bad_line", "reason"), rejects


def ingest_merged(spark: SparkSession, load_path: str, weather_path: str, zones: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, rejects): load lines with the first weather line of their zone and hour, and the unusable lines.

    merged has a row for each usable load line of ``zones`` (all, if none are named): load_area, mw, year (of
    the file's name), datetime_beginning_ept, dt (the local hour, null where its clock names no or two instants)
    and the weather, null where there is none. Of several weather lines of an hour that with the earliest
    UTC time counts, then the lowest values. Merged rows, rejects of load files and lines of other zones
    add up to the lines of the load files.
    """
    load, bad_load = _sorted_out(scan_lines(spark, load_path, LOAD_SCHEMA, tp.parse_coalesced_ts("datetime_beginning_ept")), "load")
    if zones is not None:
        load = filter_in_list(load, "load_area", zones)
    load = load.withColumn("dt", tp.floor_hour(tp.localize_or_null("at"))).withColumn("year", file_year("source_path"))
    weather, bad_weather = _sorted_out(
        scan_lines(spark, weather_path, WEATHER_SCHEMA, tp.parse_coalesced_ts("datetime_beginning_ept", tp.ISO_SPACE)), "weather"
    )
    weather = weather.withColumn("order_utc", tp.parse_fixed_ts("datetime_beginning_utc", tp.ISO_T))
    order = [F.col("order_utc").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("temp", "humidity", "dew_point", "precip", "wind")]]
    # The first line of a clock is all that an hour can take from it, so only these lines are localised.
    weather = dedup_first(weather, ["load_area", "at"], order).withColumn("wx", tp.floor_hour(tp.localize_or_null("at")))
    merged = join_load_weather(load, weather, order, "load_area", "dt", "wx").drop("at", "source_path")
    return merged, bad_load.unionByName(bad_weather)
