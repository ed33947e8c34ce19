"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, best-fit packing.

Each stage takes and returns documents (the last returns packed pieces); see the operators for what they
do with nulls, ties, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taxaflow.llm import common
from taxaflow.llm.line_dedup import line_dedup
from taxaflow.llm.packing import pack_documents
from taxaflow.llm.quality import quality_filter
from taxaflow.llm.simhash import near_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one that stays."""
    return line_dedup(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near), ("best_fit_packing", pack)]

#: Greedy line dedup and packing are no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs, name)
    return docs
