"""Training-data pipeline over the documents table: score, thin out, clean, mix and shard.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet
and read again as the next stage's input. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm import bag_minhash, feistel_shards, mix_fill, ngram_leaks, toxic_gru
from spendlens.llm.shared import discard, written
from spendlens.session import apply_skew_settings


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores as toxic go; it learns from the labelled documents of its input."""
    apply_skew_settings(spark)
    model = toxic_gru.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_gru.score_toxicity(docs, model, keep=docs.columns, clean_only=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays; no text without a near-duplicate goes."""
    apply_skew_settings(spark)
    return bag_minhash.keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    apply_skew_settings(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ngram_leaks.find_leaks(docs, items, keep=docs.columns, clean_only=True).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources have their target weights."""
    apply_skew_settings(spark)
    return mix_fill.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    apply_skew_settings(spark)
    return feistel_shards.shuffle_into_shards(docs, ["doc_id", "text"], shards=8)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No SQL: the first stage is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # the stage's input, unless it is the given table
    return docs
