"""The corpus pipeline: quality classifier, near-dedup, mixing and packing, each stage over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and works on every row and column of ``docs`` by the operator's own rules for nulls, blank
texts and repeated rows. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seatwise.llm import minhash_join, mixing, packing, quality
from seatwise.llm.common import table, written
from seatwise.llm.queries import TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", good_quality), ("near_dedup", one_of_each_group), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer; tests compare a run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
