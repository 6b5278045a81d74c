"""A corpus pipeline over ``documents``: language, exact copies, near copies, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Null, empty and letterless texts leave in the first stage;
rows with a null doc_id are treated like any other, and of rows that are equal in doc_id and text one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taxaloom.llm import bpe, decontaminate, exact_dedup, langid, simhash
from taxaloom.session import scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with a score of a half or more, stay."""
    return langid.keep_identified(docs, least=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints of three-word shingles that differ in two bits or fewer.

    What fingerprints miss follows from what is left: shingles of five words, similarity 0.8 or more.
    """
    return simhash.drop_similar(stored(simhash.drop_near(docs, words=3, bits=2), "pipeline-fingerprints"), words=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of every document that is left."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: The near and token stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``; what stages write on the way is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as whole:
        for name, stage in STAGES:
            with scratch(spark) as own:
                docs = whole.add(own.keep(stored(stage(spark, docs, sf_dir), f"pipeline-{name}")))
        return whole.keep(docs)
