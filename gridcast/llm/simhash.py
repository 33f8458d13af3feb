"""SimHash fingerprints and near-duplicate classes by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridcast.llm.common import per_batch, pick, staged, utf8
from gridcast.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Distinct fingerprints in one table bucket that are still compared one by one; denser buckets are
#: linked through shared neighbours instead (see `links`). Results do not depend on it.
DENSE = 64


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lower-cased, words between white space, shingles joined by one
    space, XXH64 (seed 42). A text of fewer words is one shingle; without words the result is 0."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed, seed = xxhash.xxh64_intdigest, 42
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    for lo in range(0, total, 1 << 15):
        hi = min(total, lo + (1 << 15))
        spans = zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist(), strict=True)
        values = np.array([hashed(joined[s:e], seed) for s, e in spans], np.uint64)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    name = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return per_batch(rows, f"doc_id {name}, fp bigint", make)


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) that connect exactly those within two bits.

    Two tables hold the halves of every fingerprint. If two fingerprints differ by at most two bits, one
    half differs by at most one: each half is looked up exactly and with every zero bit set (the partner
    with the bit set is found, the other way round it would be found twice), and complete distances are
    verified in the join. Fingerprints in a bucket of more than `dense` entries, and those that look it
    up, are linked without comparing pairs: two fingerprints are within two bits if and only if they have
    a common neighbour within one bit, and a value has at most 65 such neighbours.
    """
    half = F.expr("cast(shiftrightunsigned(fp, 32 * s) & 4294967295 as bigint)")
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).withColumn("half", half)
    ball = F.expr(
        "array_append(transform(filter(sequence(0, 31), j -> (shiftright(half, j) & 1) = 0),"
        " j -> half | shiftleft(1L, j)), half)"
    )
    probes = halves.select("s", F.col("fp").alias("probe"), F.col("half").alias("own"), F.explode(ball).alias("half"))
    crowded = staged(halves.groupBy("s", "half").count().where(F.col("count") > dense).select("s", "half"), "simhash-dense")
    parts = []
    if not crowded.isEmpty():
        near = halves.join(crowded, ["s", "half"], "left_semi").select("fp")
        near = near.union(probes.join(crowded, ["s", "half"], "left_semi").select("probe")).distinct()
        around = F.expr("array_append(transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)), fp)")
        shared = near.select("fp", F.explode(around).alias("key"))
        shared = shared.withColumn("first", F.min("fp").over(Window.partitionBy("key")))
        parts.append(shared.where("first < fp").select(F.col("first").alias("u"), F.col("fp").alias("v")).distinct())
        halves = halves.join(crowded, ["s", "half"], "left_anti")
    found = probes.join(halves, ["s", "half"]).where(
        f"bit_count(probe ^ fp) <= {MAX_DISTANCE} and (own != half or probe < fp)"
    )
    parts.append(found.select(F.col("probe").alias("u"), F.col("fp").alias("v")))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """doc_id, fp, component_id of every row: documents are linked if their fingerprints differ by at most
    two bits; component_id is the smallest doc_id reachable.

    Null and empty texts have fingerprint 0 and are linked like others. Repeated rows each come back. A
    null doc_id comes back as null; component_id ignores null ids and is null if no other is reachable.
    An empty table gives no rows; other columns are not looked at.
    """
    rows = staged(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-fingerprints")
    return with_components(rows, dense)


def with_components(rows: DataFrame, dense: int = DENSE) -> DataFrame:
    """Add component_id to a table with doc_id and fp."""
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    labels = components(links(classes.select("fp"), dense)).withColumnRenamed("node", "fp")
    classes = staged(classes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")), "simhash-labelled")
    roots = staged(classes.groupBy("label").agg(F.min("rep").alias("component_id")), "simhash-roots")
    ids = staged(classes.join(roots, "label").select("fp", "component_id"), "simhash-ids")
    return rows.join(ids, "fp")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """Rows of docs, all columns, one per near-duplicate group: that with the smallest doc_id (null ids
    last, then the smallest fingerprint, then the smallest text; of equal rows any)."""
    names = docs.columns
    wide = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    key, text = f"_in{names.index(id_col)}", f"_in{names.index(text_col)}"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)
    at = names.index(text_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        fps = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "fp"])

    rows = staged(per_batch(wide, f"{kinds}, fp bigint", make), "simhash-rows")
    grouped = with_components(rows.select(F.col(key).alias("doc_id"), "fp"), dense)
    # The group of a document without any id in reach is told apart by its own fingerprint's class.
    classes = grouped.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    best = classes.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("best"))
    best = staged(best.select(F.col("best.doc_id").alias("best_id"), F.col("best.fp").alias("best_fp")), "simhash-best")
    kept = rows.join(best, (F.col("fp") == F.col("best_fp")) & F.col(key).eqNullSafe(F.col("best_id")), "left_semi")
    first = F.row_number().over(Window.partitionBy("fp", key).orderBy(text))
    return kept.withColumn("_n", first).where("_n = 1").select(wide.columns).toDF(*names)
