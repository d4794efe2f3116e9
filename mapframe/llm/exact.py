"""Exact duplicates: groups by a 128-bit hash of the content, compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, whole, without, written


def normalised(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.translate(text, SPACES, "")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without ``[\\x20\\x09-\\x0D]``; NULL counts as empty, and all empty texts
    are equal. Of equal texts the row with most code points in its original text stays, then the one with the
    smallest doc_id (a NULL id is larger than any other). Rows that repeat doc_id and text count as members; all of
    them carry kept = true if theirs is the id that stays. No rows give no rows.

    Equal bytes are found by grouping on (hash, bytes): rows are summed up before they are dealt out by the hash, so a
    text that a third of all rows share leaves each task once. Each group gets a number for its hash (0 unless
    different bytes share a hash), and members find their group by hash and SHA-256 of their bytes.
    """
    rows = whole(docs).select("doc_id", F.length("text").cast("long").alias("len"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "len", "norm", F.unhex(F.md5("norm")).alias("hash"))
    best = F.max(F.struct("len", (-F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("order"), "doc_id"))
    groups = (rows.groupBy("hash", "norm").agg(F.count("*").alias("group_size"), best.alias("best"))
              .select("hash", F.sha2("norm", 256).alias("sha"), "group_size", F.col("best.doc_id").alias("keep_id")))
    members = rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    return (members.join(groups.withColumnRenamed("hash", "group_hash"),
                         (F.col("hash") == F.col("group_hash")) & (F.col("text_sha256") == F.col("sha")))
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return without(docs, written(exact_groups(docs).where(~F.col("kept")).select("doc_id")))
