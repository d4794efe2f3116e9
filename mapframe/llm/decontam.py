"""Benchmark decontamination: passages of all documents as queries on an inverted index of the test items.

BM25 with each item's own score as the unit: a passage that holds all terms of an item scores 1. Every passage of every
document is a query; items above ``LEAST_SCORE`` are found by block-max WAND and confirmed by the word trigrams that
the passage shares with the item's question and with its answer (its last sentence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import whole, without, written

K1, B = 1.2, 0.75
LEAST_SCORE = 0.5
LEAST_OVERLAP = 0.5
GRAM = 3
SLACK = 1e-4  # for the rounding of sums of bounds
BLOCKS = 64  # of items, at most
ITEMS = 20_000  # in an index; more items are searched in several rounds
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
FOUND = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
_U = np.uint64


def terms_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return textkit.words(data, np.array([0, len(data)]), textkit.SPACE_PUNCT).hash


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; a single sentence is both."""
    parts = [p for p in SENTENCE.split(text.strip()) if len(terms_of(p))]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


class Index:
    """Postings of one block of items, with the largest impact of each list and of each of its blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [terms_of(text) for _, text in items]
        self.ids = [i for i, _ in items]
        sides = [map(terms_of, question_and_answer(text)) for _, text in items]
        self.sides = [[(n, np.unique(textkit.grams(t, n))) for t in pair for n in [min(GRAM, len(t))]] for pair in sides]
        self.longest = max(map(len, words))
        mean = sum(map(len, words)) / len(words)
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, found in enumerate(words):
            for term, tf in zip(*(x.tolist() for x in np.unique(found, return_counts=True))):
                postings.setdefault(term, []).append((i, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / mean))))
        n, own = len(items), [0.0] * len(items)
        for term, found in postings.items():
            idf = log(1 + (n - len(found) + 0.5) / (len(found) + 0.5))
            postings[term] = [(i, idf * w) for i, w in found]
            for i, w in postings[term]:
                own[i] += w
        self.terms = np.array(sorted(postings), _U)
        self.lists = []
        for term in self.terms.tolist():
            found = [(i, w / own[i]) for i, w in postings[term]]
            self.lists.append(([i for i, _ in found], [w for _, w in found]))
        self.bound = np.array([max(impacts) for _, impacts in self.lists])
        self.size = -(-n // BLOCKS)  # items in a block
        self.tops = np.zeros((len(self.lists), -(-n // self.size)), np.float32)
        for t, (found, impacts) in enumerate(self.lists):
            np.maximum.at(self.tops[t], np.array(found) // self.size, impacts)
        #: Terms of most items that together cannot reach half the least score: they are counted once for every passage.
        by_length = sorted(range(len(self.lists)), key=lambda t: -len(self.lists[t][0]))
        common = by_length[:int(np.searchsorted(np.cumsum(self.bound[by_length]), LEAST_SCORE / 2))]
        self.common = self.tops[common].sum(axis=0)
        self.leading = self.tops.copy()
        self.leading[common] = 0
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.terms & _U((1 << 18) - 1)).astype(np.intp)] = True

    def term_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes & _U((1 << 18) - 1)).astype(np.intp)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items that score at least LEAST_SCORE for a set of terms, by block-max WAND with a fixed threshold."""
        cursors = [[self.lists[t][0][0], 0, float(self.bound[t]), *self.lists[t], t] for t in terms]
        end = len(self.ids)
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[2]
                if total >= LEAST_SCORE:
                    pivot = c[0]
                    break
            if pivot is None or pivot == end:
                return found
            block = pivot // self.size
            if self.tops[[c[5] for c in cursors if c[0] <= pivot], block].sum() < LEAST_SCORE - SLACK:
                beyond = [c[0] for c in cursors if c[0] > pivot]  # without the next list, nothing in this block is enough
                goal = max(pivot + 1, min([(block + 1) * self.size, *beyond]))
                for c in cursors:
                    if c[0] < goal:
                        self.advance(c, goal, end)
                continue
            score = 0.0
            for c in cursors:
                if c[0] > pivot:
                    break
                self.advance(c, pivot, end)
                if c[0] == pivot:
                    score += c[4][c[1]]
                    self.advance(c, pivot + 1, end)
            if score >= LEAST_SCORE:
                found.append((pivot, score))

    @staticmethod
    def advance(c: list, goal: int, end: int) -> None:
        items, at = c[3], c[1]
        while at < len(items) and items[at] < goal:
            at += 1
        c[1], c[0] = min(at, len(items) - 1), items[at] if at < len(items) else end

    def passages(self, words: textkit.Words) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end word) of passages that can score enough.

        Passages are twice as long as the longest item and overlap by half, so that each item lies within one.
        """
        numbers = self.term_numbers(words.hash)
        known = np.flatnonzero(numbers >= 0)
        if not len(known):
            return
        sizes = np.diff(words.first)
        parts = -(-sizes // self.longest)
        first_part = np.cumsum(parts) - parts
        text = np.searchsorted(words.first, known, "right") - 1
        part = first_part[text] + (known - words.first[text]) // self.longest
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ceiling = np.zeros((int(parts.sum()) + 1, self.tops.shape[1]), np.float32)
        ceiling[part[starts]] = np.add.reduceat(self.leading[numbers[known]], starts, axis=0)
        last = np.zeros(len(ceiling), bool)  # parts behind which their text ends
        last[(first_part + parts - 1)[sizes > 0]] = True
        alone = np.zeros(len(ceiling), bool)  # texts of one part are one passage
        alone[first_part[parts == 1]] = True
        ceiling[:-1] += np.where(last[:-1, None], 0, ceiling[1:])
        enough = ((ceiling + self.common).max(axis=1) >= LEAST_SCORE - SLACK) & (~last | alone)
        enough[-1] = False
        owner = np.repeat(np.arange(len(sizes)), parts)
        for i in np.flatnonzero(enough).tolist():
            text = int(owner[i])
            start = int(words.first[text]) + (i - int(first_part[text])) * self.longest
            end = min(start + 2 * self.longest, int(words.first[text + 1]))
            terms = np.unique(numbers[start:end])
            terms = terms[terms >= 0]
            if self.tops[terms].sum(axis=0).max() >= LEAST_SCORE - SLACK:
                yield text, start, end, terms.tolist()


def _search(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for lo, _, words in textkit.batches(batch, "text", textkit.SPACE_PUNCT):
                for text, start, end, terms in index.passages(words):
                    for item, score in index.search(terms):
                        shares = [float(np.isin(side, textkit.grams(words.hash[start:end], n)).mean())
                                  for n, side in index.sides[item]]
                        if min(shares) >= LEAST_OVERLAP:
                            out.append((ids[lo + text], index.ids[item], start - int(words.first[text]), score, *shares))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 3)],
                ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])

    return rows.mapInArrow(textkit.released(run), FOUND)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, score, question_overlap, answer_overlap): one row for each document and item of
    (item_id, text, ...) that a passage of the document confirms, with the best passage.

    NULL and empty texts, and items without words, are found nowhere. Copies of an item are all found. Rows with a NULL
    doc_id can be reported, with that id. No items or no documents give no rows. Items come to the driver ITEMS at a
    time, sorted by length, and each time all documents are read.
    """
    items = items.where("text IS NOT NULL").select("item_id", "text")
    total = items.count()
    rows, found = whole(docs), None
    blocks = max(1, -(-total // ITEMS))
    bounds = items.select(F.length("text").alias("n")).approxQuantile("n", [i / blocks for i in range(1, blocks)], 0.0) \
        if blocks > 1 else []
    size, block = F.length("text"), F.lit(0)
    for bound in bounds:
        block = block + (size > bound).cast("int")
    for i in range(blocks):
        part = items if blocks == 1 else items.where(block == i)
        chosen = [(r.item_id, r.text) for r in part.collect() if len(terms_of(r.text))]
        if chosen:
            hits = _search(rows, chosen)
            found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("order"), "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.order")).alias("first_word"), "b.score", "b.question_overlap", "b.answer_overlap")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is confirmed, with all their columns."""
    return without(docs, written(leaks(docs, items).select("doc_id")))
