"""A training-data pipeline over `documents`: toxicity, near-duplicates, contamination, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept, which run() writes as Parquet
and reads again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import decontamination, mixing, secrets, simhash_similar, toxicity
from gridcast.llm.common import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by a Jaccard similarity of five-word
    shingles of 0.8 or more."""
    return simhash_similar.one_per_group(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture reads them, with the mixture's columns. The budget is the
    smallest that reads every source once whole, so mixing repeats documents and drops none."""
    mixed = mixing.mixture(docs, budget_ratio=None)
    return mixing.realised(mixed).withColumn("mix_weight", F.round("mix_weight", 8))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: A trained classifier and XXH64 fingerprints cannot be stated in SQL; no test runs the whole pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
