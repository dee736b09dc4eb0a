"""The corpus pipeline: five operators in turn, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage made to the folder
that executors share, reads it back for the next one and drops what came before. The last gives token ids, the
others documents with all their columns, extra ones too; only line dedup changes text and n_chars.

Null and empty texts have no language and go in the first stage. Rows with a null doc_id pass the dedup stages
as they are. Repeated rows fare alike: in line dedup and near-dedup, rows that share a doc_id are one document.
Of equal lines and of near-duplicates the one with the least doc_id stays. Texts of any length are worked whole. An
empty table gives an empty result in every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from sigspark.llm import decontaminate, langid, lines, sentencepieces, simhash
from sigspark.llm.common import bound_batches, table
from sigspark.plans.storage import settled, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid classifier doesn't reject."""
    bound_batches(spark)
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are like an earlier one."""
    bound_batches(spark)
    return lines.drop_duplicates(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bound_batches(spark)
    return simhash.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with whether decoding them gives the text."""
    bound_batches(spark)
    return sentencepieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("sentencepiece", tokenize),
]

#: SQL cannot express the first stage (trained centroids); tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = settled(spark, functools.partial(stage, spark, docs, sf_dir), before)
    return STAGES[-1][1](spark, docs, sf_dir)
