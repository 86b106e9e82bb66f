"""Corpus preparation: toxic documents, near duplicates and benchmark leaks go, then the rest is mixed and sharded.

Each stage reads what its predecessor kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atrium.llm import decontamination, jaccard, mixing, sharding, toxicity
from atrium.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity grammar: documents scoring 0.7 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the least doc_id stays."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents stand as often as the source targets take them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: every row with its shard and its place in it."""
    return sharding.shuffle_to_shards(docs)


STAGES = [
    ("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_to_weights),
    ("sharding", shard),
]

#: The toxicity model is trained and the mix is drawn, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.

    Rows without an id, with a null or empty text, of any length and with further columns pass through
    every stage like others; rows are told apart by id and text, and of repeated ones the Jaccard join
    keeps one.  The mix takes texts without words as often as their size allows (they weigh nothing).
    An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
