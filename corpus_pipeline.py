"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Defined results: documents with a null, empty or letterless text go in the first stage; a null key, source or language is a value like any other (a
missing language is filled in); rows that are equal in key and text are one document to the second stage, which keeps one of them, and of a group of
near copies the one with the smallest key, ties by digest; texts of any length are worked on whole, and a text that loses all its
words stays as an empty one; extra columns are carried along, also under names that the operators use inside, but for those that the last stage adds
(size, source_size, target, copies, taken), which replace such columns; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, langid, mixing, near_dup, passages
from tallyspark.llm.store import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Below this score a text is like no learned language at all.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language, go; a missing language is filled in."""
    found = langid.predict(docs, langid.learn(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur more than once go from the texts."""
    return passages.strip(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies."""
    return mixing.mix(docs).where("copies > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: Rank-order profiles, sketches and alignment can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
