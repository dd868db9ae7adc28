"""Training-data pipeline over ``documents``: each stage applies one operator
to all that its predecessor kept, is written as Parquet and read again.

Null or empty texts pass every filter (they hold nothing to reject), repeated
rows are near duplicates of each other, an empty table stays empty, and extra
columns are carried through to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proselens.llm.catalog import bpe_vocabulary
from proselens.llm.common import Scratch
from proselens.llm.decontaminate import drop_leaks
from proselens.llm.linededup import line_dedup
from proselens.llm.neardup import drop_near_duplicates
from proselens.llm.packing import pack
from proselens.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete the blocks that earlier documents hold."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: shingles of five words, 0.8 or more."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 ids."""
    vocabulary, pattern = bpe_vocabulary()
    return pack(docs, vocabulary, pattern, capacity=1024).drop("ids")


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

# Tokenisers, alignment and trained models are beyond SQL: the stages are
# tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
