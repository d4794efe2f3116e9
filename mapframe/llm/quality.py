"""Quality by importance resampling: how much likelier a text is as target text than as raw text.

Two bags of hashed n-grams, one of labelled good texts and one of all texts, give every n-gram a log ratio. A text's
log importance is the mean ratio of its n-grams times ``EVIDENCE``: as if every text had that many n-grams, so that
long texts are not judged by their length. Adding Gumbel noise and taking the k largest samples k texts without
replacement in proportion to their importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import whole, written

BUCKETS = 1 << 16
TARGET_SAMPLE = 20_000  # labelled rows that the target model and the boundary are taken from, at most
EVIDENCE = 200.0
SMOOTHING = 1.0
SEED = 17
_U = np.uint64
#: Letters, digits and bytes above ASCII make words; every run of other visible signs is a token as well.
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(256) if chr(c).isalnum() and c < 128 or c > 127]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram: words, runs of signs with the sign they begin with, and pairs of neighbours.

    A pair of equal words, a word in capitals and a run of signs are n-grams of their own kind.
    """
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    words = textkit.words(data, offsets, _KIND != 1)
    signs = textkit.words(data, offsets, _KIND != 2)
    word_text, sign_text = words.text_of_word(), signs.text_of_word()
    lead, size = data[signs.start].astype(_U), np.minimum(signs.end - signs.start, 4).astype(_U)
    sign_hash = textkit.mix(lead * _U(8) + size + _U(1 << 40))
    capital = (data >= 65) & (data <= 90)
    capitals = np.concatenate([[0], np.cumsum(capital)])
    shout = (capitals[words.end] - capitals[words.start] == words.end - words.start) & (words.end - words.start > 2)
    pairs, same_text = textkit.grams(words.hash, 2), word_text[1:] == word_text[:-1]
    repeated = same_text & (words.hash[1:] == words.hash[:-1])
    pairs = np.where(repeated, textkit.mix(np.full(1, 7, _U)), pairs)
    loud = np.full(int(shout.sum()), textkit.mix(np.full(1, 11, _U))[0], _U)
    hashes = np.concatenate([words.hash, sign_hash, pairs[same_text], loud])
    texts = np.concatenate([word_text, sign_text, word_text[1:][same_text], word_text[shout]])
    return texts, (hashes & _U(BUCKETS - 1)).astype(np.int64)


def _counted(rows: DataFrame, flag: str) -> np.ndarray:
    """n-gram counts of all rows and of those with the flag: each task sums up, what is collected has a fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            data, offsets = textkit.buffers(batch.column("text"))
            good = batch.column(flag).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi in textkit.spans(offsets):
                text, bucket = features(data, offsets[lo:hi + 1])
                counts += np.bincount(bucket + BUCKETS * good[lo:hi][text], minlength=2 * BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    found = rows.select("text", flag).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(2 * BUCKETS)
    for bucket, n in found.collect():
        out[bucket] = n
    out = out.reshape(2, BUCKETS)
    return np.stack([out.sum(axis=0), out[1]])


def sampled_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows (doc_id, column), those with the smallest hashes; a bounded table."""
    return (labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.max(column).cast("int").alias(column))
            .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows))


def fit(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of every bucket: target text is the labelled good rows of the sample, raw text all rows.

    Without good labels all ratios are 0.
    """
    good = sample.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("_good"))
    raw, target = _counted(whole(docs).join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left"), "_good")
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    p, q = ((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in (target, raw))
    return np.log(p / q).astype(np.float32)


def log_importance(text: str | Column, ratios: np.ndarray) -> Column:
    """Log importance of a text column; NULL and texts without n-grams have 0."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            data, offsets = textkit.buffers(array)
            out = np.zeros(len(array))
            for lo, hi in textkit.spans(offsets):
                text, bucket = features(data, offsets[lo:hi + 1])
                total = np.bincount(text, ratios[bucket], hi - lo)
                out[lo:hi] = total / np.maximum(np.bincount(text, minlength=hi - lo), 1)
            yield pa.array(EVIDENCE * out)

    return run(text)


def gumbel(doc_id: str | Column = "doc_id") -> Column:
    """Gumbel noise that depends on the id alone, so that a repeated task draws the same."""
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), F.col(doc_id) if isinstance(doc_id, str) else doc_id), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, log_importance, sort_key) of every row."""
    rows = whole(docs).select("doc_id", log_importance(F.col("text"), ratios).alias("log_importance"))
    return rows.select("doc_id", "log_importance", (F.col("log_importance") + gumbel()).alias("sort_key"))


def cutoff(scores: DataFrame, k: int) -> float:
    """The k-th largest key. Counts of 4096 ranges narrow it down until it is alone; no sort, no rows on the driver."""
    low, high, n = scores.agg(F.min("sort_key"), F.max("sort_key"), F.count("*")).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while True:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return low
        part = scores.where(F.col("sort_key").between(low, high))
        counts = dict(part.groupBy(F.least(F.floor((F.col("sort_key") - low) / width), F.lit(4095)).alias("r"))
                      .count().collect())
        for r in sorted(counts, reverse=True):
            if above + counts[r] >= k:
                break
            above += counts[r]
        bounds = part.where(F.least(F.floor((F.col("sort_key") - low) / width), F.lit(4095)) == r) \
            .agg(F.min("sort_key"), F.max("sort_key")).first()
        if bounds[0] == bounds[1] or counts[r] == 1:
            return bounds[0]
        low, high = bounds


def boundary(scores: DataFrame, sample: DataFrame) -> float:
    """The log importance that parts good labels from bad ones with fewest errors; in the middle of the widest gap that
    does. The bounded sample comes to the driver as two numbers a row. Without labels of both kinds: minus infinity."""
    rows = scores.join(F.broadcast(sample.select(F.col("doc_id").alias("_id"), "quality")), F.col("doc_id") == F.col("_id"))
    rows = np.array(rows.select("log_importance", "quality").collect(), float).reshape(-1, 2)
    good = rows[:, 1] == 1
    if good.all() or not good.any():
        return float("-inf")
    order = np.argsort(rows[:, 0], kind="stable")
    value, good = rows[order, 0], good[order]
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    gaps = np.diff(value, prepend=value[0], append=value[-1])  # gap i lies below row i
    best = np.flatnonzero(errors == errors.min())
    at = int(best[np.argmax(gaps[best])])
    return float((value[max(at - 1, 0)] + value[min(at, len(value) - 1)]) / 2)


def selection(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
    """Scores of all rows as a written table, the ratios, and the smallest sort key that is kept.

    k, the size of the sample, is the number of rows on the good side of the boundary.
    """
    sample = written(sampled_labels(labels, "quality", TARGET_SAMPLE))
    ratios = fit(docs, sample)
    scores = written(scored(docs, ratios))
    k = scores.where(F.col("log_importance") >= boundary(scores, sample)).count()
    return scores, ratios, cutoff(scores, k)


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_importance, sort_key, kept) of every row of (doc_id, text, ...).

    Rows with the same key as the last of the sample stay too. NULL and empty texts have importance 0 like average
    text. No rows give no rows; without labels of both kinds all rows are kept.
    """
    scores, _, least = selection(docs, labels)
    return scores.withColumn("kept", F.col("sort_key") >= least)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are sampled, with all their columns. Scores are computed again instead of joined."""
    _, ratios, least = selection(docs, labels)
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.where(log_importance(text, ratios) + gumbel(docs["doc_id"]) >= F.lit(least))
