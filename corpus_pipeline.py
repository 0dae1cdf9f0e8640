"""A corpus from raw documents to packed training sequences.

Stages take (spark, docs, sf_dir); each one's rows are written and read again
as the next one's `docs`. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlane.llm import decontaminate, near_dedup, packing, passages, registry, store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id. Five-word shingles, similarity 0.8."""
    groups = near_dedup.near_duplicates(docs, k=5)
    return store.without_ids(docs, groups.filter("not kept"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that holds them."""
    return passages.without_passages(docs, passages.passages(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return store.without_ids(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, registry.tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), store.mark()
    for _, stage in STAGES[:-1]:
        docs = store.settled(stage(spark, docs, sf_dir), since)  # what a stage made on the way goes
    return STAGES[-1][1](spark, docs, sf_dir)
