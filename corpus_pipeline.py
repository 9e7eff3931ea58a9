"""The corpus pipeline: documents in, one row per kept document with the words that the mix takes.

Each stage gets the rows that its predecessor kept, as a written table, and returns the columns
of documents; the last one returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import decontaminate, minhash, mixing, quality_rules, toxicity
from claimweave.sources.storage import written

#: Toxicity learns from labels of these documents; the others measure it.
TOXICITY_LEARNS = "crc32(cast(doc_id AS string)) % 5 <> 0"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.kept_documents(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept_documents(docs, toxicity.fit(docs, labels, learn=F.expr(TOXICITY_LEARNS)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", non_toxic),
    ("minhash_dedup", distinct),
    ("decontaminate", uncontaminated),
    ("mix_sources", mixed),
]

# Nearest neighbours, minhash components and random rounding are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
