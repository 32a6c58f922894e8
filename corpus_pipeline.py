"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, BPE.

``run(spark, sf_dir)`` applies the stages to the table ``documents``.  Each stage works on all rows that its
predecessor kept, written as Parquet and read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join
from tempora.llm.shared import handed_over, removed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter in it) go, however far the nearest profile is."""
    profiles = language_id.trained(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.recognised(docs, profiles)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for white space) one stays."""
    return exact_dedup.without_copies(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a similarity of 0.8 or more on five-word shingles, the one with the least doc_id stays."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by items of the table ``benchmark`` go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.digests(bpe.encoded(docs))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the language profiles nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, handed_over(stage(spark, docs, sf_dir), name)
        removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
