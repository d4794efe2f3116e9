"""What the text operators share: reading tables, shipping code, scratch tables."""

from __future__ import annotations

import gc
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def ship(spark: SparkSession) -> SparkSession:
    """Task code travels with the plan, so executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, text) and the columns ``keep`` of every row, NULL texts as empty ones."""
    return df.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_part(column: str | Column, parts: int) -> Column:
    """crc32 of an id's decimal digits, modulo ``parts``; a NULL id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def written(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it, a lost executor costs one step.

    Shuffle files of plans that the driver has collected go by now instead of when its memory runs short. Wide rows are
    written ``file_rows`` to a file: a reader holds thousands of rows of a file at once.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def counted(df: DataFrame, file_rows: int = 0) -> tuple[DataFrame, int]:
    """``df`` as ``written`` gives it, and its number of rows."""
    seen = Observation()
    out = written(df.observe(seen, F.count("*").alias("n")), file_rows)
    return out, seen.get.get("n") or 0


def packed(df: DataFrame, rows: int, each: int = 1 << 15) -> DataFrame:
    """``df``, the result of a shuffle, in one task for ``each`` of about so many rows, 8 at least and no more than before.

    A short table that is dealt over many partitions takes longer to start tasks and to write files than to work on.
    """
    return df.coalesce(max(8, -(-rows // each)))


def tasks_for(df: DataFrame) -> int:
    """Tasks for a shuffle of as much as ``df`` reads: one for every 16 MB of files, at least the session's.

    Spark knows no size of rows that come from elsewhere and gives a huge one.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 24 if size < 1 << 60 else 0)


FEW = 4 << 20  # rows of one or two numbers that are sent to every task, at most; larger tables are shuffled


def small(rows: DataFrame, most: int = FEW) -> DataFrame:
    """Marks a narrow table for broadcasting if it is counted and found small; else leaves it to a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose doc_id is in ``ids``."""
    ids = ids.select(F.col("doc_id").alias("_wanted")).distinct()
    return df.join(small(ids), F.col("doc_id") == F.col("_wanted"), "left_semi")


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose doc_id is not in ``ids``."""
    ids = ids.select(F.col("doc_id").alias("_unwanted")).distinct()
    return df.join(small(ids), df["doc_id"] == F.col("_unwanted"), "left_anti")

