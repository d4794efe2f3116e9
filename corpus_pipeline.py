"""From raw documents to tokens: quality, exact copies, near copies, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapframe.llm import bpe, decontam, exact, jaccard, quality
from mapframe.llm.common import ship, table, written
from mapframe.llm.queries import public_vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ship(spark)
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar texts stays."""
    ship(spark)
    return jaccard.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a confirmed benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the digests of ids and decoded bytes."""
    ship(spark)
    return bpe.digests(bpe.tokenized(docs, *public_vocabulary()), "ids")


STAGES = [("quality_classifier", keep_good), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies),
          ("benchmark_decontamination", drop_leaks), ("byte_bpe", tokenize)]

#: Sampling and item search have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is a table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
