"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.session import scratch_dir


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact spelling and place, so that other columns whose names differ
    only by case, or that occur twice, do no harm. The first column of a name counts."""
    plain = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"_in{df.columns.index(n)}").alias(n) for n in names])


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor
    costs a read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which it does when their handles
    are collected as garbage. Call it after a step's result has been staged. The first round frees what
    Python still holds in the JVM, the second what that held."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def utf8(text: str | Column) -> Column:
    """Text as UTF-8 bytes, null as no bytes."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(b""))


def per_batch(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]):
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = make(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def text_key(rows: DataFrame, id_col: str) -> DataFrame:
    """rows (with bytes in `text`) and tid, which tells rows of one id apart: 0 where ids are unique, which
    costs a shuffle nothing, else a hash of the text."""
    repeated = rows.groupBy(id_col).count().where("count > 1")
    return rows.withColumn("tid", F.lit(0).cast("bigint") if repeated.isEmpty() else F.xxhash64("text"))
