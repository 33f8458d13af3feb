"""Folds and labels of classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import pick


def fold(id_col: str, of: int) -> Column:
    """CRC-32 of the id as text, modulo `of`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0))


def with_label(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows (with doc_id) that have a label, once per row: `label` as 0 or 1. Null ids and labels are left
    out; of several labels of one id the larger counts."""
    known = pick(labels, "doc_id", label).toDF("doc_id", "label").where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("double")).alias("label"))
    return rows.join(known, "doc_id")
