"""Spelling variants: words of a vocabulary that are one insertion, deletion or replacement apart, and their usual forms.

A pair that is one edit apart agrees on its first half or on its second. Words are dealt out by such a half, and each cell
holds FM-indexes of its delimited words in both reading directions. A search matches the half exactly, which leaves an
interval of suffix ranks, and extends it across the other half, allowing one error, up to the delimiter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, whole, written

#: Runs of letters, and which of them lose a letter.
RUN = "[A-Za-zÀ-ÿ]+"
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
TIMES = 2  # a form is so many times as frequent
CELL = 1 << 19  # characters of a cell's words, about
FEW_FORMS = 1 << 18  # words with a form that are sent to every task, at most; more are joined by a shuffle
ASKED = 1 << 12  # words that are searched at a time


def damaged(doc_id: Column, run: Column) -> Column:
    """The lower-case run; if the CRC of ``doc_id:run`` is a multiple of DAMAGED, without the letter the CRC points at."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % DAMAGED == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of every word with at least LEAST_LENGTH code points that occurs LEAST_COUNT times in all."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = whole(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


# Which half: pairs whose longer word has m letters agree on the first m // 2 letters, or on the last m - m // 2.


def dealt(words: DataFrame) -> DataFrame:
    """Rows (cell, i, j, word, n, m, first, indexed, asked): words with a half in common meet in at least one cell.

    Cells are filled by the hash of the half. If the words that share one half have more than CELL characters, they are
    cut into parts, and there is a cell for every pair of parts (i is searched for j), so that no cell grows with the group.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    rows = rows.select("word", "n", "m", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    piece = F.when(F.col("first"), F.substring("word", 1, half)).otherwise(
        F.col("word").substr(F.length("word") - (F.col("m") - half) + 1, F.col("m") - half))
    rows = rows.withColumn("half", F.xxhash64("m", "first", piece))
    sums = rows.groupBy("half").agg(F.sum(F.length("word") + 1).alias("weight"))
    cells = max(1, -(-4 * (words.agg(F.sum(size + 1)).first()[0] or 0) // CELL))
    hot = written(sums.where(F.col("weight") > CELL).select(
        F.col("half").alias("_half"), F.ceil(F.col("weight") / CELL).cast("int").alias("parts")))
    rows = rows.join(small(hot), F.col("half") == F.col("_half"), "left")
    part = F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_indexed = F.transform(every, lambda k: F.struct(part.alias("i"), k.alias("j"), F.lit(True).alias("indexed"), F.lit(False).alias("asked")))
    as_asked = F.transform(every, lambda k: F.struct(k.alias("i"), part.alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asked")))
    once = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("indexed"), F.lit(True).alias("asked")))
    places = F.when(F.col("parts").isNull(), once).otherwise(F.concat(as_indexed, as_asked))
    cell = F.when(F.col("parts").isNull(), F.pmod("half", F.lit(cells))).otherwise(F.col("half"))
    return rows.select(cell.alias("cell"), "word", "n", "m", "first", F.explode(places).alias("place")).select(
        "cell", "place.*", "word", "n", "m", "first")


@dataclass
class Letters:
    """Words as codes from 1 up, end to end."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def backwards(self) -> Letters:
        """The same words, each read from its end."""
        at = np.arange(len(self.flat))
        word = np.repeat(np.arange(len(self.size)), self.size)
        return Letters(self.flat[2 * self.start[word] + self.size[word] - 1 - at], self.start, self.size)

    def take(self, which: np.ndarray) -> Letters:
        size = self.size[which]
        end = np.cumsum(size)
        at = np.repeat(self.start[which] - end + size, size) + np.arange(int(size.sum()))
        return Letters(self.flat[at], end - size, size)


def letters(words: list[str]) -> tuple[Letters, int]:
    """Codes of some words, and how many codes there are with the delimiter 0."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    known, codes = np.unique(points, return_inverse=True)
    size = np.array([len(w) for w in words], np.int64)
    return Letters(codes.astype(np.int64) + 1, np.cumsum(size) - size, size), len(known) + 1


class Index:
    """FM-index of distinct words, each after a delimiter, read as a circle."""

    def __init__(self, words: Letters, codes: int):
        n, count = len(words.flat) + len(words.size), len(words.size)
        delimiter = words.start + np.arange(count)
        text = np.zeros(n, np.int64)
        text[np.delete(np.arange(n), delimiter)] = words.flat
        order, rank = _rotations(text, codes)
        last = text[order - 1]
        by_code = np.argsort(last, kind="stable")
        self.n, self.codes, self.last = n, codes, last
        self.keys = last[by_code] * n + by_code
        self.word = np.empty(count, np.int64)
        self.word[rank[delimiter]] = np.arange(count)

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranks of (code + what the given ranks start with)."""
        return np.searchsorted(self.keys, code * self.n + low), np.searchsorted(self.keys, code * self.n + high)

    def before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, code) of the letters that stand before an interval's suffixes, each once.

        Intervals with more suffixes than there are codes get all codes.
        """
        size = np.minimum(high - low, self.codes)
        whose = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size)
        wide = (high - low > self.codes)[whose]
        code = np.where(wide, at, self.last[np.where(wide, 0, low[whose] + at)])
        once = np.unique(whose * self.codes + code)
        whose, code = once // self.codes, once % self.codes
        return whose[code > 0], code[code > 0]


def _rotations(text: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rotations of a circular text of which no two are equal, and the rank of each, by doubling."""
    n, bits = len(text), int(codes).bit_length()
    reach = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(reach):
        key = (key << bits) | np.roll(text, -i)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order, rank
        key = rank * n + np.roll(rank, -reach)
        reach *= 2


def one_error(index: Index, asked: Letters, exact: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the asked word, number of the indexed word) of all pairs that are one edit apart.

    The last ``exact`` letters must agree. ``longer``: the other word has one letter more; else it has as many or one less.
    """
    count = len(asked.size)
    at = asked.size - 1
    low, high = np.zeros(count, np.int64), np.full(count, len(index.word))
    for i in range(int(exact.max(initial=0))):
        on = np.flatnonzero((exact > i) & (high > low))
        low[on], high[on] = index.step(asked.flat[asked.start[on] + at[on]], low[on], high[on])
        at[on] -= 1
    who = np.flatnonzero(high > low)
    clean = (who, at[who], low[who], high[who])
    wrong = tuple(np.zeros(0, np.int64) for _ in range(4))
    found = []
    while len(clean[0]) or len(wrong[0]):
        who, at, low, high = clean
        whose, code = index.before(low, high)
        more = longer[who[whose]]
        own = np.where(at[whose] >= 0, asked.flat[asked.start[who[whose]] + np.maximum(at[whose], 0)], 0)
        use = more | ((at[whose] >= 0) & (code != own))
        whose, code, more = whose[use], code[use], more[use]
        new_low, new_high = index.step(code, low[whose], high[whose])
        branch = (who[whose], at[whose] - ~more, new_low, new_high)
        skip = (at >= 0) & ~longer[who]
        skipped = (who[skip], at[skip] - 1, low[skip], high[skip])
        wrong = _further(index, asked, wrong, found)
        wrong = tuple(np.concatenate(x) for x in zip(wrong, branch, skipped))
        clean = _further(index, asked, clean, None)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    once = np.unique(np.concatenate(found))
    return once // len(index.word), once % len(index.word)


def _further(index: Index, asked: Letters, states: tuple, found: list | None) -> tuple:
    """States after their next letter; those that are through end at the delimiter and are noted in ``found``."""
    who, at, low, high = states
    done = at < 0
    if found is not None and done.any():
        first, last = index.step(np.zeros(int(done.sum()), np.int64), low[done], high[done])
        hit = last > first
        found.append(who[done][hit] * len(index.word) + index.word[first[hit]])
    who, at, low, high = (x[~done] for x in states)
    low, high = index.step(asked.flat[asked.start[who] + at], low, high)
    alive = high > low
    return who[alive], at[alive] - 1, low[alive], high[alive]


def _same_start(one: Letters, a: np.ndarray, two: Letters, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether words agree on their first ``length`` letters, which they both have."""
    same = np.ones(len(a), bool)
    for i in range(int(length.max(initial=0))):
        on = np.flatnonzero(same & (length > i))
        same[on] = one.flat[one.start[a[on]] + i] == two.flat[two.start[b[on]] + i]
    return same


def near_in_cell(cell: pa.Table) -> pa.Table:
    """(word, n_near, top_n, top): near words of each asked word that this cell is to report, and the most frequent one.

    A pair counts in the class of its longer word, and where both halves agree, with the first half only: so each
    pair is reported once for either word by all cells together.
    """
    cell = cell.combine_chunks()
    indexed = cell.filter(cell.column("indexed")).group_by("word").aggregate([("n", "max")])
    indexed = indexed.sort_by([("n_max", "descending"), ("word", "ascending")]).combine_chunks()
    names, n = indexed.column("word"), indexed.column("n_max").to_numpy()
    asked = cell.filter(cell.column("asked")).combine_chunks()
    asked_names = pc.unique(asked.column("word"))
    none = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("top_n", pa.int64()), ("top", pa.string())])
    if not len(names) or not len(asked_names):
        return none.empty_table()
    both, codes = letters(names.to_pylist() + asked_names.to_pylist())
    known, words = both.take(np.arange(len(names))), both.take(np.arange(len(names), len(names) + len(asked_names)))
    number = pc.index_in(asked.column("word"), value_set=asked_names).to_numpy()
    m, first = asked.column("m").to_numpy().astype(np.int64), asked.column("first").to_numpy(zero_copy_only=False)
    who, other = [], []
    for forward in (True, False):
        which = np.flatnonzero(first == forward)
        one, two = (known.backwards(), words.backwards()) if forward else (known, words)
        index = Index(one, codes)
        for at in range(0, len(which), ASKED):
            block = which[at:at + ASKED]
            queries, half = two.take(number[block]), m[block] // 2
            q, found = one_error(index, queries, half if forward else m[block] - half, queries.size < m[block])
            if not forward:
                rest = ~_same_start(queries, q, one, found, half[q])
                q, found = q[rest], found[rest]
            who.append(number[block][q])
            other.append(found)
    who, other = np.concatenate([np.zeros(0, np.int64), *who]), np.concatenate([np.zeros(0, np.int64), *other])
    order = np.lexsort((other, who))
    who, other = who[order], other[order]
    new = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    best = other[new]
    return pa.table([asked_names.take(pa.array(who[new])), pa.array(np.diff(np.append(new, len(who)))), pa.array(n[best]),
                     names.take(pa.array(best))], schema=none)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, top_n, top) of all words of (word, n) that have a near one; top: the most frequent, then smallest."""
    found = dealt(words).groupBy("cell", "i", "j").applyInArrow(
        near_in_cell, "word string, n_near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), "top"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("top_n"), F.col("best.top").alias("top"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form): each round follows twice as many forms, and a chain ends because its
    counts double, so there are at most six rounds."""
    found = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = small(found.select(F.col("word").alias("_word"), F.col("root").alias("_root")), FEW_FORMS)
        found = written(found.join(on, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return found.drop("moved")
        found = found.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of (doc_id, text, ...).

    form: the most frequent word one edit away (ties: the smallest by code points) if it is at least TIMES as frequent,
    else NULL; root: where following forms ends, the word itself if it has none. NULL and empty texts have no words, a
    NULL doc_id counts as the empty text, repeated rows count as often as they come. Other columns are not read. Words
    of any length are searched whole. No rows, or no word that is frequent enough, give no rows.
    """
    words = written(vocabulary(docs))
    near = near_words(words).withColumnRenamed("word", "_near")
    usual = F.col("top_n") >= TIMES * F.col("n")
    told = written(words.join(near, F.col("word") == F.col("_near"), "left").select(
        "word", "n", F.when(usual, F.col("top")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(usual, F.col("top_n")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return told.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
