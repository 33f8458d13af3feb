"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import decontamination, lexical, lines, mixing, periods, quality, secrets, simhash, substring, token_counts, topk, toxicity, warc
from gridcast.llm.common import pick
from gridcast.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), "doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def remove_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    counted = token_counts.count_tokens(table(spark, sf, "documents"), model)
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def archive_pages(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_pages(table(spark, sf, "pages"), path)
    return warc.pages_of(warc.read_archives(spark, path, bodies=False))


def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), "doc_id", "text", "source")
    mixed = mixing.mixture(docs)
    return mixed.select("doc_id", "source", "mix_tokens", F.round("mix_weight", 8).alias("mix_weight"), "mix_quota", "mix_block", "mix_place", "mix_copies")


def scan_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(pick(table(spark, sf, "documents"), "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        # Spark passes an element's place to a function of two parameters, so `kind` is none of the lambda's.
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{n}") for k, n in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def score_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def score_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def search_items(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by CRC-32 of the id, repeats its words from some word on
    with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Null ids have no number and stay as they are.
    ws = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = pick(docs, "doc_id", "text").withColumn("ws", ws).withColumn("n", F.size("ws").cast("bigint")).withColumn("g", (h / 10).cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    again = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def find_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periods.find_runs(with_planted_periods(table(spark, sf, "documents"))).withColumn("best", periods.strongest())
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def drop_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.without_repeated_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": mix_sources,
    "op2_quality": score_quality,
    "op3_toxicity": score_toxicity,
    "op4_top_k": top_k,
    "op5_archive_pages": archive_pages,
    "op6_scan_secrets": scan_secrets,
    "op7_decontaminate": decontaminate,
    "op8_near_duplicates": near_duplicates,
    "op9_remove_repeats": remove_repeats,
    "op10_count_tokens": count_tokens,
    "op11_search_items": search_items,
    "op12_find_runs": find_runs,
    "op13_drop_lines": drop_lines,
}
