"""A corpus pipeline: classify, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoplot.llm import decontaminate, mixing, neardup, quality_classifier, sharding
from echoplot.llm.common import read, written


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, read(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays."""
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go."""
    return decontaminate.without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: rows hold the words that the mix takes, up to three rows an id."""
    return mixing.mixed_texts(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and slot of 40 shuffled shards."""
    return sharding.shard(docs, 40)


STAGES = [("quality classifier", classified), ("near-duplicate removal", deduplicated), ("decontamination", decontaminated), ("source mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # MinHash candidates and keyed permutations have no SQL form
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
