"""The corpus pipeline: documents through five operators of ``tripmill.llm``, stage by stage.

Every stage but the last returns the columns of its input.  The order keeps each stage's input
as small as the ones before can make it: unreadable text goes first, copies before the search
for benchmark passages, and the mix is made of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.llm import byte_cnn, mixture, sharding, simhash, templates
from tripmill.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the labelled languages, go."""
    return byte_cnn.identified(docs, *byte_cnn.fit_known(docs))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, or one with other values in it, go."""
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixture.mixed(docs, F.array(F.col("source").cast("string")))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row of the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("mixture", mix_sources),
    ("sharding", assign_shards),
]
# Trained weights and seeded hashes have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
