"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and L1 keeps those at zero that never made up for it; what is left is a short
list of hashes and weights. Shards of a bounded labelled sample are learned in parallel and averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import crc_part, whole, written

SAMPLE = 20_000  # labelled rows that the model is fit on, at most
SHARD = 5_000  # rows that are learned in one task, about
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
HELD_OUT = (4, 2)  # crc32 of the id modulo 4 is 2: never learned from
THRESHOLD = 0.3
_U = np.uint64


def features(words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first number of each text, hashes): distinct words, pairs of neighbours, and pairs with one word between."""
    skip = textkit.mix(words.hash[:-2] * _U(0x9E3779B97F4A7C15) + words.hash[2:] + _U(3))
    pair, first, parts = textkit.grams(words.hash, 2), words.first.tolist(), []
    for a, b in zip(first, first[1:]):
        parts.append(np.unique(np.concatenate(
            [words.hash[a:b], pair[a:max(a, b - 1)], skip[a:max(a, b - 2)]])) if b > a else words.hash[:0])
    return np.cumsum([0, *map(len, parts)]), np.concatenate(parts) if parts else words.hash[:0]


def learn(texts: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights that are not zero after EPOCHS passes; hash 0 is the constant."""
    hashes, index = np.unique(np.concatenate([np.zeros(1, _U), *texts]), return_inverse=True)
    rows = np.split(index[1:], np.cumsum([len(t) for t in texts])[:-1])
    z, n, bias = np.zeros(len(hashes)), np.zeros(len(hashes)), int(index[0])
    l1 = np.full(len(hashes), L1)
    l1[bias] = 0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1[at], 0.0,
                        (np.sign(zs) * l1[at] - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at = np.append(rows[i], bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - toxic[i]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(len(hashes)))
    return hashes[w != 0], w[w != 0]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their weights, averaged over the shards.

    Learned from at most SAMPLE rows with a label that are not held out, those with the smallest hashes of their id.
    Several labels of one id count as the largest. Without labels the model is empty, and all scores are 0.5.
    """
    parts, out = HELD_OUT
    sample = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_part("doc_id", parts) != out))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("doc_id", "_id"))
    sample = written(sample)
    shards = max(1, round(sample.count() / SHARD))
    rows = (whole(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
            .select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).alias("shard"), "doc_id", "text", "toxic"))

    def shard(found: pa.Table) -> pa.Table:
        found = found.sort_by("doc_id").combine_chunks()
        texts: list[np.ndarray] = []
        for batch in found.to_batches():
            for _, _, words in textkit.batches(batch, "text", textkit.SPACE_PUNCT):
                first, hashes = features(words)
                texts += np.split(hashes, first[1:-1])
        hashes, weights = learn(texts, found.column("toxic").to_numpy())
        return pa.table({"hash": hashes.view(np.int64), "weight": weights})

    learned = rows.groupBy("shard").applyInArrow(shard, "hash long, weight double").groupBy("hash").agg(
        F.sum("weight").alias("w")).collect()
    found = sorted((r.hash % (1 << 64), r.w / shards) for r in learned)
    return np.array([h for h, _ in found], _U), np.array([w for _, w in found], float)


def toxicity(text: str | Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """Score from 0 to 1 of a text column; NULL and texts without words have the score of the constant alone."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, weights = model
        constant = float(weights[hashes == 0].sum())
        seen = np.zeros(1 << 20, bool)
        seen[(hashes & _U((1 << 20) - 1)).astype(np.intp)] = True
        for array in batches:
            data, offsets = textkit.buffers(array)
            out = np.full(len(array), constant)
            for lo, hi in textkit.spans(offsets):
                words = textkit.words(data, offsets[lo:hi + 1], textkit.SPACE_PUNCT)
                kinds = [words.hash, textkit.grams(words.hash, 2),
                         textkit.mix(words.hash[:-2] * _U(0x9E3779B97F4A7C15) + words.hash[2:] + _U(3))]
                hits = []
                for reach, kind in enumerate(kinds):
                    maybe = np.flatnonzero(seen[(kind & _U((1 << 20) - 1)).astype(np.intp)])
                    at = np.minimum(np.searchsorted(hashes, kind[maybe]), len(hashes) - 1)
                    same = hashes[at] == kind[maybe] if len(hashes) else np.zeros(0, bool)
                    maybe, at = maybe[same], at[same]
                    owner = np.searchsorted(words.first, maybe, "right") - 1
                    inside = maybe + reach < words.first[owner + 1]
                    hits.append((owner[inside], at[inside]))
                owner, at = (np.concatenate(x) for x in zip(*hits))
                once = np.unique(owner * max(1, len(hashes)) + at)
                out[lo:hi] += np.bincount(once // max(1, len(hashes)), weights[once % max(1, len(hashes))]
                                          if len(hashes) else None, hi - lo)
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return run(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text, ...); other columns are no inputs."""
    parts, out = HELD_OUT
    rows = whole(docs).select("doc_id", (crc_part("doc_id", parts) == out).alias("held_out"),
                              toxicity(F.col("text"), fit(docs, labels)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
