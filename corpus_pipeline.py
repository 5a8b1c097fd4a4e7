"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads it from Parquet. All but the last
return the columns of ``documents``. Language identification rejects texts without a letter (``und``); exact dedup keeps
the largest doc_id of equal texts; the n-gram join keeps the smallest doc_id of each group of near duplicates; mixing
repeats documents to the sources' targets; packing returns the pieces of the sequences.

Defined results: an empty table passes through every stage (the last returns no pieces); null texts go in the first
stage; other columns are carried along; rows that repeat become one in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pdforge.llm import block_names, byte_gru, ngram_join, pack_nnls, source_mix
from pdforge.llm.common import documents, small_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return byte_gru.accepted(docs, byte_gru.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_names.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_nnls.query(docs)


STAGES = [("language ID", language), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup),
          ("mixing sources", mixing), ("packing", packing)]

#: Network, shingle hashes and token ids are beyond SQL: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
