"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Each stage takes the documents its predecessor kept and decides on all of them. All but the last return the columns of
``documents``; the last returns the pieces of packed sequences.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagegrid.llm import exact_dedup, mixing, packing, quality_rules, simhash
from pagegrid.llm.queries import TOKENIZER, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (linked SimHash fingerprints) the row with the smallest id stays."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights; the rows lie in the order of the schedule."""
    slot = next(n for n in (f"slot{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    mixed = mixing.mixed_rows(docs, slot_col=slot)
    return mixed.repartitionByRange(slot).sortWithinPartitions(slot).drop(slot)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of at most 2048 tokens, each with its token ids, its copy of the document and its place in a
    sequence.
    """
    return packing.packed_documents(docs, TOKENIZER, with_ids=True, with_copy=True)


STAGES = [("quality_rules", rules_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: the verdict of learned rules and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
