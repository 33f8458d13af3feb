"""Connected components of a graph given as an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """Node and smallest node of its component, for all nodes that have an edge.

    edges: two long columns u, v. Self loops and repeated edges are allowed, nulls are ignored; no edges
    give no rows. In each round a node hooks onto its smallest neighbour, trees collapse by pointer
    jumping, and the edges are carried over to the roots, until no edge is left between two roots. No
    task ever holds a component: joins meet a table with one row per node, so adaptive execution can
    split a hub's edges over many tasks.
    """
    left = _simple(edges.toDF("u", "v"))
    labels = None
    while True:
        left = staged(left, "components-edges")
        if labels is not None and left.isEmpty():
            return labels
        ends = left.select(F.col("u").alias("node"), F.col("v").alias("other")).union(left.select("v", "u"))
        parent = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("parent"))
        parent = _flat(staged(parent, "components-parent"))
        if labels is None:
            labels = parent.withColumnRenamed("parent", "label")
        else:
            step = parent.select(F.col("node").alias("label"), "parent")
            labels = staged(
                labels.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label")),
                "components-labels",
            )
        if left.isEmpty():
            return labels
        at_u = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        at_v = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        left = _simple(left.join(at_u, "u").join(at_v, "v").select("pu", "pv").toDF("u", "v"))


def _simple(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller end first."""
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _flat(parent: DataFrame) -> DataFrame:
    """Follow parents to the roots; a parent is always smaller than its node, so this ends."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = staged(parent.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "components-jump")
        moved = not jumped.where("moved").isEmpty()
        parent = jumped.select("node", "parent")
        if not moved:
            return parent
