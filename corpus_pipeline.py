"""A training-corpus pipeline: quality, near copies, benchmark leaks, mixture, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of the documents they were given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm import decontaminate, mixing, ngram_join, quality_gam, queries, token_store
from tripleloom.llm.spool import folder_for, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality_gam.keep_good(docs, quality_gam.train(docs, queries.table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaked(docs, queries.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target marginals."""
    return mixing.sample(docs, queries.TARGETS, rounds=queries.RAKE_ROUNDS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what is left, read back."""
    return token_store.store(docs, queries.tokenizer_file(), queries.END_ID)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("mixture", mixture), ("token_ids", token_ids)]

#: A learned model and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage spools goes once its output is written, the outputs with the process."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder_for(spark, f"pipeline-{name}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
