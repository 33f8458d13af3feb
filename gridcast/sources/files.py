"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridcast.functions.scalar import file_year, nan_to_null

LOAD_SCHEMA = T.StructType(
    [
        T.StructField("datetime_beginning_ept", T.StringType()),
        T.StructField("load_area", T.StringType()),
        T.StructField("mw", T.DoubleType()),
    ]
)

WEATHER_SCHEMA = T.StructType(
    [
        T.StructField("datetime_beginning_utc", T.StringType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("dew_point", T.DoubleType()),
        T.StructField("precip", T.DoubleType()),
        T.StructField("wind", T.DoubleType()),
        T.StructField("datetime_beginning_ept", T.StringType()),
        T.StructField("load_area", T.StringType()),
    ]
)

LOAD_GLOB = "hrl_load_metered_*.csv"
WEATHER_GLOB = "*.csv"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read the columns of ``schema`` by name; files may carry more columns, in any order.

    Only a header line is read ahead. A file whose header differs from the first one fails instead
    of being read by position. A path that matches no file raises ``AnalysisException``. NaN becomes
    null here, once, for all code behind the scan.
    """
    header = spark.read.option("header", True).csv(path).columns
    wanted = {f.name: f.dataType for f in schema}
    missing = [c for c in wanted if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    full = T.StructType([T.StructField(c, wanted.get(c, T.StringType())) for c in header])
    df = (
        spark.read.schema(full)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("source_path"))
    )
    cols = [
        nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in schema
    ]
    return df.select(*cols, "source_path")


def scan_yearly_csv(spark: SparkSession, path: str, schema: T.StructType = LOAD_SCHEMA) -> DataFrame:
    """SRC1: yearly files in one multi-file scan, ``year`` taken from each file's name."""
    return scan_csv(spark, path, schema).withColumn("year", file_year("source_path"))


def scan_weather_csv(spark: SparkSession, path: str, schema: T.StructType = WEATHER_SCHEMA) -> DataFrame:
    """SRC2: all weather files of a folder."""
    return scan_csv(spark, path, schema)


def write_yearly_csv(df: DataFrame, path: str, stem: str = "hrl_load_metered", year: str = "year") -> None:
    """Yearly files that :func:`scan_yearly_csv` reads back: one folder
    ``file=<stem>_<year>.csv`` per year, each with as many parts as its size asks for."""
    (
        df.withColumn("file", F.concat(F.lit(f"{stem}_"), F.col(year).cast("string"), F.lit(".csv")))
        .drop(year)
        .hint("rebalance", F.col("file"))
        .write.mode("errorifexists")
        .partitionBy("file")
        .option("header", True)
        .csv(path)
    )


def write_merged(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """SNK1: the merged table, as Parquet or as CSV with a header.

    With partition columns, the rebalance hint keeps the number of files near what the data needs
    and still splits a partition that is too large for one task.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def rescan_materialized(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """SRC3: read a written table back; the new plan starts at the files."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs its schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def merged_size(df: DataFrame) -> DataFrame:
    """Bytes and number of the files behind a scan."""
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("p"), m["file_size"].alias("s")).distinct().agg(
        F.count("*").alias("n_files"), F.sum("s").alias("n_bytes")
    )


def write_weather_by_year(
    df: DataFrame, path: str, utc: str = "datetime_beginning_utc", area: str = "load_area", year: str = "year"
) -> None:
    """SNK2: per-year CSV folders, ordered by (utc, area).

    The range exchange spreads one large year over many tasks and keeps the order across the parts.
    """
    (
        df.repartitionByRange(year, utc, area)
        .sortWithinPartitions(year, utc, area)
        .write.mode("overwrite")
        .partitionBy(year)
        .option("header", True)
        .csv(path)
    )


def append_forecast_line(
    df: DataFrame, path: str, date: str = "date", line: str = "line", known: DataFrame | None = None
) -> None:
    """SNK4: add one line per forecast day. Days in ``known`` (lines read back before) are left out,
    so a repeated run adds nothing twice."""
    if known is not None:
        df = df.join(known.select(F.col("forecast_date").alias(date)).distinct(), date, "left_anti")
    df.select(F.col(line).alias("value")).write.mode("append").text(path)


def read_forecast_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their day, which is the first, quoted value; none where nothing was published yet."""
    try:
        lines = spark.read.schema("value string").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    day = F.to_date(F.regexp_extract("value", r'^"(\d{4}-\d{2}-\d{2})"', 1))
    return lines.select(day.alias("forecast_date"), F.col("value").alias("line"))


def scan_audit(df: DataFrame, by: str = "source_path", distinct: str = "load_area") -> DataFrame:
    """SNK5: rows and distinct areas per file.

    Counted per (file, area) first, so a large file is never gathered in one task.
    """
    return (
        df.groupBy(by, distinct)
        .agg(F.count("*").alias("n"))
        .groupBy(by)
        .agg(F.sum("n").alias("n_rows"), F.count(distinct).alias("n_areas"))
    )
