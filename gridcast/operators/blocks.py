"""Exact row positions and row frames without one task per group.

A zone may hold a large part of all rows, so a window over the whole zone would put them in one
task. Positions are counted per (group, bucket) and made global by the bucket sizes; frames then run
over blocks of consecutive positions, with the few rows past a block's edge copied in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense_index(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], as_name: str = "idx"
) -> DataFrame:
    """0-based position of each row in its group. ``bucket`` must rise with ``order`` (a month, a
    year). The second window sees one row per bucket, not the data."""
    rows = df.withColumn("_bucket", bucket)
    here = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        rows.withColumn("_rn", F.row_number().over(here))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(as_name, F.col("_off") + F.col("_rn") - 1)
        .drop("_bucket", "_rn", "_off")
    )


def blocks_with_following(df: DataFrame, idx: str, size: int, following: int) -> DataFrame:
    """Assign positions to blocks of ``size`` (column ``_block``); the first ``following`` rows of a
    block are copied to the end of the block before, marked ``_copy``."""
    if following > size:
        raise ValueError("a block must hold all following rows")
    own = F.struct((F.col(idx) / size).cast("bigint").alias("b"), F.lit(False).alias("c"))
    prev = F.struct((own["b"] - 1).alias("b"), F.lit(True).alias("c"))
    edge = (F.col(idx) % size < following) & (own["b"] > 0)
    placed = F.explode(F.when(edge, F.array(own, prev)).otherwise(F.array(own)))
    return df.withColumn("_p", placed).select(
        *df.columns, F.col("_p.b").alias("_block"), F.col("_p.c").alias("_copy")
    )
