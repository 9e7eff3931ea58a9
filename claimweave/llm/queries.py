"""Registered queries: every operator over its whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import (
    centroids, conversations, decontaminate, html_text, jaccard_join, licenses, minhash, mixing, quality_model, quality_rules, toxicity,
    url_filter, warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n: tells learning and held-out documents apart."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels"), metadata=["n_chars"], learn=_remainder(3) != 1)
    return quality_model.score(docs, model, metadata=["n_chars"]).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn=_remainder(5) != 0)
    return toxicity.score(docs, index).select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted", "neighbours")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "similarity", "distance", "start", "n_words")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie as files in a directory of their source and language."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs, path, id_column="doc_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults, repaired."""
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings")).drop("n_met")


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_quality_model, op3_toxicity, op4_quality_rules, op5_decontaminate, op6_minhash_dedup,
    op7_mix_sources, op8_html_text, op9_warc, op10_licenses, op11_conversation_repair, op12_centroid_clustering,
    op13_ngram_jaccard_join)}
