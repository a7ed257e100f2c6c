"""Documents to tokens: quality rules, near duplicates, secrets, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import bpe, jaccard, mixing, quality, secrets
from heronlake.llm.common import table, words_column, written
from heronlake.llm.registry import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    masked = secrets.mask_owned(docs, F.col("source"), F.substring_index("source", "/", 1))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mixing.repeat_mixed(docs, words_column(F.col("text")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; the texts decode to themselves."""
    return bpe.round_trip(docs, *vocabulary())


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("secret_scan", secret_scan), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: Neither the robust estimates nor the Newton iterations are SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
