"""A corpus made ready for training: five stages over documents, each written as Parquet and read again.

Counted as part of the subpackage llm. Every stage works on all that the stage before it kept. Of every stage it holds that
columns other than those it names pass through unseen, that an empty table gives an empty table, and that very long
texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countloom.llm import decontaminate, minhash, mixing, sharding, toxicity
from countloom.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, scores below its threshold. Null and empty texts score as texts of
    unknown words; repeated rows and rows without an id are judged by their texts alone; a column toxic_score stays as it is."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over five-word shingles: the one of least id. Rows
    of one id are one document; rows without an id all stay; null texts and texts without words are like nothing and stay."""
    return minhash.deduplicated(docs, Scratch(spark), percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of `benchmark`; a document of which more than half the words are such passages goes whole.
    Null and empty texts stay as they are; repeated rows and rows without an id are cut alike; n_chars is counted anew."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, not at all to three times. What has no words (null and empty
    texts) is never taken, as a mix is one of words; a null source is a source; repeated rows and rows without an id each
    have their own turn."""
    return mixing.mixed(docs, Scratch(spark))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot (columns of these names are replaced). Null and empty texts, repeated rows and
    rows without an id are placed like any other."""
    return sharding.sharded(docs, Scratch(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier and the hash-based choices are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`. What a stage wrote is dropped once the next one is written."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
