"""The corpus pipeline: documents to language-checked, deduplicated, decontaminated, mixed and sharded rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbwatch.llm import decontaminate, langmix, mix, sharding, simhash
from curbwatch.llm.common import documents, stage


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a language that holds half of their text go."""
    return langmix.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mix.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Eight shards of equal bytes, with each row's size, shard and slot."""
    return sharding.shard(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharded),
]
#: SQL can state neither the language model nor the hashes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for name, step in STAGES:
        docs = stage(step(spark, docs, folder), name)
    return docs
