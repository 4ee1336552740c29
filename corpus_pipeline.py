"""A corpus pipeline over documents: language, near-duplicates, benchmark, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import decontaminate, language_id, mixing, near_dedup, sharding
from tablemill.session import new_folder, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; letterless ones and those of unclear language go."""
    return language_id.with_language(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Links are five-word shingles of a
    similarity of 0.8 or more, not those of op5."""
    return near_dedup.one_of_each(docs, width=5, alike=(80, 100))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shards, shuffled: the columns of documents, then shard and slot."""
    stored = sharding.write_shards(docs, new_folder(spark, "shards"))
    return stored.select("record.*", "shard", "slot")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

# Learned models and random samples have no SQL; tests hold each stage against its operator's plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
