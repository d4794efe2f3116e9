"""A hierarchical Pitman-Yor language model of three levels, sampled in parallel.

A token is served in the restaurant of its two previous words, whose parent is the restaurant of the previous word, whose
parent is the root. Words are 64-bit hashes, and every pair of words and every word that a text has is a restaurant of its
own, so restaurants, dishes (words) and customers grow with the corpus. Events are dealt out by previous word: its
restaurant and all below it are in one part, so what a seating needs of whole restaurants is summed up there. Parts meet
at the root only: each sends the root customers of its dishes to one of the ranges that the dishes are split into, where
they are summed and told to all parts that have the dish. A previous word that is a large share of all tokens is dealt
out by both words; its restaurant on the middle level is seated in the ranges then, and its parts are told that too.

Passes: every part seats its customers as it is written; once more against what the ranges told, with SAMPLES states taken;
and the same again (the same random numbers) to read predictive probabilities off those states with the sums that belong
to them. Documents are told apart by a row number; which doc_id a row has travels in parts of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import crc_part, tasks_for, whole, written

DISCOUNT = (0.5, 0.7, 0.8)  # root, previous word, two previous words
STRENGTH = (1.0, 1.0, 1.0)
SAMPLES = 3
MOVES = 4  # customers of each group that change tables between two samples
PARTS_PER_TASK = 8
HOT_SHARE = 1 / 256  # of the tokens of a sample of documents; previous words above it are split
COMMON = 1 << 18  # words of a sample of documents that are sent by number, the others by their hash
HELD_OUT = 10  # crc32 of the id modulo 10 is 0: never learned from
_U = np.uint64
_END, _START = _U(0x1D8AF2E1B2B0C5D7), _U(0x5F0D3C9A7E6B4821)


# --- packing ----------------------------------------------------------------

def pack(array: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    raw = np.ascontiguousarray(array)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1) if len(raw) else np.zeros(0, kind)


# --- tokens -------------------------------------------------------------------

def tokens(words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, dish) of every token: all words of a text, then its end."""
    first = words.first
    texts = len(first) - 1
    text = np.concatenate([words.text_of_word(), np.arange(texts)])
    dish = np.concatenate([words.hash, np.full(texts, _END, _U)])
    order = np.argsort(text, kind="stable")
    return text[order], dish[order]


def before(dish: np.ndarray, text: np.ndarray, start) -> np.ndarray:
    """What comes before each token of a text, ``start`` before its first."""
    out = np.empty_like(dish)
    out[1:] = dish[:-1]
    out[np.diff(text, prepend=-1) != 0] = start
    return out


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Previous words of more than HOT_SHARE of the tokens of about every 16th document, in order, and the COMMON most frequent
    words there, the most frequent first; only the layout depends on them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [before(dish, text, _START) for _, _, words in textkit.batches(batch, "text") for text, dish in [tokens(words)]]
            if found:
                dish, n = np.unique(np.concatenate(found), return_counts=True)
                top = n > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(dish[top], _U(0)).view(np.int64)), pa.array(np.append(n[top], n.sum()))],
                    ["dish", "n"])

    rows = docs.where(crc_part("doc_id", 16) == 0).mapInArrow(run, "dish long, n long").groupBy("dish").agg(
        F.sum("n").alias("n"))
    found = rows.orderBy(F.desc("n"), "dish").limit(COMMON).toArrow()
    dish, n = (found.column(c).to_numpy() for c in ("dish", "n"))
    total = n[dish == 0].sum()
    words = dish.astype(np.int64).view(_U)
    return np.sort(words[(dish != 0) & (n > HOT_SHARE * total)]), words[dish != 0]


def number_of(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The number of each word among the common ones, else -1."""
    at = np.minimum(np.searchsorted(common, words), len(common) - 1) if len(common) else np.zeros(len(words), np.int64)
    return np.where(common[at] == words, at, -1) if len(common) else at - 1


def named(words: np.ndarray, common: np.ndarray) -> list[bytes]:
    """Distinct words in order, as two columns."""
    number = number_of(words, common)
    return [pack(np.diff(number[number >= 0], prepend=0).astype(np.uint32)), pack(words[number < 0])]


def words_of(gaps: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The words that ``named`` wrote."""
    return np.sort(np.concatenate([common[np.cumsum(gaps.astype(np.int64))], others]))


PIECE = "part int, at int, data binary"  # at: -1 for events, else what goes to a range of dishes or comes from it


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    part, at, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array(data, pa.binary())],
                                      ["part", "at", "data"])


def dealt(docs: DataFrame, parts: int, hot: np.ndarray, ranked: np.ndarray) -> DataFrame:
    """Packed events of every batch by part: words, and for each token its two previous words, dish, row and role.

    Parts from ``parts`` on hold the doc_ids of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash = np.argsort(ranked)
        for batch in batches:
            row, train = batch.column("row").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            found = [(lo, *tokens(words)) for lo, _, words in textkit.batches(batch, "text")]
            if not found:
                continue
            text = np.concatenate([lo + t for lo, t, _ in found])
            dish, known = pd.factorize(np.concatenate([d for _, _, d in found]))
            del found
            dish, known = dish.astype(np.int32), np.append(known, _START)
            one = before(dish, text, len(known) - 1)
            two = before(one, text, len(known) - 1)
            part = (textkit.mix(known) % _U(parts)).astype(np.int32)[one]
            split_up = np.flatnonzero(np.isin(known, hot)[one])
            part[split_up] = textkit.mix(known[one[split_up]] + textkit.mix(known[two[split_up]])) % _U(parts)
            order = np.argsort(part * np.int64(len(known)) + one)
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            stamp = ((row - row[0]) * 2 + train)[text].astype(np.uint32)
            number, rows = number_of(known, ranked[by_hash]), []
            number[number >= 0] = by_hash[number[number >= 0]]  # small numbers for frequent words
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if b > a:
                    at = order[a:b]
                    events = np.stack([one[at], two[at], dish[at]])
                    code = number[events]
                    others = code < 0
                    own, code[others] = np.unique(events[others], return_inverse=True)
                    code[others] += len(ranked)
                    code = code.astype(np.uint32)
                    starts = np.flatnonzero(np.diff(code[0], prepend=code[0, 0] + np.uint32(1)))
                    rows.append((p, -1, joined(
                        pack(known[own]), pack(code[0, starts]), pack(np.diff(starts, append=b - a).astype(np.uint32)),
                        pack(code[1]), pack(code[2]), pack(stamp[at]), pack(row[:1]))))
            ids = batch.column("doc_id")
            rows.append((parts + int(textkit.mix(row[:1].astype(_U))[0] % _U(parts)), -1, joined(
                pack(row), pack(ids.cast(pa.int64()).fill_null(0).to_numpy()), pack(np.asarray(ids.is_valid()).view(np.uint8)))))
            yield pieces(rows)

    return docs.mapInArrow(textkit.released(run), PIECE)


def joined(*columns: bytes) -> bytes:
    return b"".join([np.array([len(c) for c in columns], np.uint64).tobytes(), *columns])


def split(data: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of a row that ``joined`` made."""
    begin = 8 * len(kinds)
    ends = (begin + np.cumsum(np.frombuffer(data[:begin], np.uint64).astype(int))).tolist()
    return [unpack(data[a:b], kind) for a, b, kind in zip([begin, *ends], ends, kinds)]


def together(blobs: list[bytes], hot: np.ndarray, ranked: np.ndarray) -> Part:
    """One part from what batches dealt to it."""
    u32, first = np.uint32, len(ranked)
    found = [split(data, _U, u32, u32, u32, u32, u32, np.int64) for data in blobs]
    others, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    places = np.split(place, np.cumsum([len(f[0]) for f in found])[:-1])

    def coded(column):
        out = []
        for f, where in zip(found, places):
            code = (np.repeat(f[1], f[2]) if column == 1 else f[column]).astype(np.int64)
            rare = code >= first
            code[rare] = first + where[code[rare] - first]
            out.append(code)
        return np.concatenate(out)

    one, two, dish = coded(1), coded(3), coded(4)
    stamp = np.concatenate([f[5].astype(np.int64) + 2 * f[6][0] for f in found])
    every = np.concatenate([ranked, others])
    used = np.zeros(len(every), bool)
    for code in (one, two, dish):
        used[code] = True
    used = np.flatnonzero(used)
    used = used[np.argsort(every[used])]  # common words and others in one order
    words, rank = every[used], np.empty(len(every), np.int64)
    rank[used] = np.arange(len(used))
    one, two, dish = rank[one], rank[two], rank[dish]
    pairs, context = np.unique(one * len(words) + two, return_inverse=True)
    previous, parent_of = np.unique(pairs // len(words), return_inverse=True)
    at = np.searchsorted(hot, words[previous])
    split_up = np.append(hot, _U(0))[at] == words[previous] if len(hot) else np.zeros(len(previous), bool)
    order = np.argsort(dish * len(pairs) + context)
    return Part((words[dish[order]], context[order], stamp[order] >> 1, stamp[order] & 1),
                np.where(split_up, at, -1).astype(np.int16), parent_of)


def merged(rows: DataFrame, parts: int, tasks: int, hot: np.ndarray, ranked: np.ndarray, ranges: int) -> DataFrame:
    """One row for each part of events with its first seating, what parts send to the ranges, and doc_ids as they are. A
    task reads its parts one after the other."""
    common = np.sort(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole_part(number, blobs):
            part = together(blobs, hot, ranked)
            first = Sums(np.zeros(0), shape=part.shape)
            (state,) = part.states(first, number, 1)
            seated = Sums(np.zeros(0), first.of(part, state), shape=part.shape)
            return pieces([(number, -1, part.packed(seated, common)), *part.sent(number, ranges, common, part.count, [state])])

        last, blobs = None, []
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                if part >= parts:
                    yield pieces([(part, -1, data)])
                    continue
                if part != last and blobs:
                    yield whole_part(last, blobs)
                    blobs = []
                last = part
                blobs.append(data)
        if blobs:
            yield whole_part(last, blobs)

    return rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(textkit.released(run), PIECE)


# --- seatings -----------------------------------------------------------------

class Seating:
    """Customers at tables, for many groups (one dish in one restaurant) at a time.

    Group g has the customers and table slots offset[g] to offset[g + 1].
    """

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.n, self.d, self.rng = customers, discount, rng
        self.offset = np.concatenate([[0], np.cumsum(customers)])
        self.size = np.zeros(self.offset[-1], np.int64)
        self.seat = np.zeros(self.offset[-1], np.int64)
        self.tables = np.zeros(len(customers), np.int64)

    def open_all(self, fresh: np.ndarray) -> None:
        """Seats everybody, one after the other in each group; ``fresh`` is the weight of a new table in each group.

        A customer opens a table with weight ``fresh`` or follows one before it, with weight 1 if that one followed
        another, 1 - d if it opened its table, which gives size - d for each table. All customers choose at once: whoever
        would follow an opener only with probability 1 - d waits until the chosen one has decided, and if that one
        opened a table, chooses again. A customer's draws do not depend on those of others, so this is the same.
        """
        group = np.repeat(np.arange(len(self.n)), self.n)
        nth = np.arange(len(group)) - self.offset[group]
        leader = np.arange(len(group))
        follows = np.zeros(len(group), np.int8)  # 1 if it does, 0 if it opened a table, -1 if it waits
        second = np.flatnonzero(nth == 1)  # the one before it opened a table
        weight = fresh[group[second]]
        second = second[self.rng.random(len(second)) * (1 - self.d + weight) >= weight]
        leader[second], follows[second] = second - 1, 1
        todo, waiting = np.flatnonzero(nth > 1), np.zeros(0, np.int64)
        while len(todo) or len(waiting):
            others, weight = nth[todo], fresh[group[todo]]
            at = self.rng.random(len(todo)) * (others + weight) - weight  # below 0: a new table
            sure = self.rng.random(len(todo)) >= self.d
            leader[todo] = np.where(at < 0, todo, todo - others + np.clip(at.astype(np.int64), 0, others - 1))
            follows[todo] = np.where(at < 0, 0, np.where(sure, 1, -1))
            waiting = np.concatenate([waiting, todo[(at >= 0) & ~sure]])
            known = follows[leader[waiting]]
            follows[waiting[known == 1]] = 1
            todo, waiting = waiting[known == 0], waiting[known < 0]
        self.tables[:] = np.bincount(group[follows == 0], minlength=len(self.n))
        while True:  # a table is in the slot of the customer who opened it
            above = leader[leader]
            if (above == leader).all():
                break
            leader = above
        self.seat[:] = leader
        self.size[:] = np.bincount(leader, minlength=len(leader))

    def place(self, g: np.ndarray, who: np.ndarray, others: np.ndarray, fresh: np.ndarray) -> None:
        """Seats one customer in each group g next to its first ``others`` ones (all but itself if it isn't the last).

        A table is drawn by a random other customer and taken with probability 1 - d / size, which gives size - d.
        """
        todo = np.arange(len(g))
        while len(todo):
            k, n = g[todo], others[todo]
            new = self.rng.random(len(todo)) * (n + fresh[todo]) < fresh[todo]
            new |= n == 0
            pick = self.offset[k] + np.minimum((self.rng.random(len(todo)) * n).astype(np.int64), np.maximum(n - 1, 0))
            pick += pick >= who[todo]
            table = self.seat[np.minimum(pick, len(self.seat) - 1)]
            good = new | (self.rng.random(len(todo)) * self.size[table] >= self.d)
            self.sit(k[good & ~new], who[todo][good & ~new], table[good & ~new])
            self.sit_alone(k[new], who[todo][new], n[new] + 1)
            todo = todo[~good]

    def sit(self, g, who, table):
        self.seat[who] = table
        self.size[table] += 1

    def sit_alone(self, g, who, slots):
        """At a free one of the group's first slots; there are as many as customers."""
        slot, todo = who.copy(), np.flatnonzero(self.size[who] > 0)
        while len(todo):
            slot[todo] = self.offset[g[todo]] + (self.rng.random(len(todo)) * slots[todo]).astype(np.int64)
            todo = todo[self.size[slot[todo]] > 0]
        self.sit(g, who, slot)
        self.tables[g] += 1

    def move(self, fresh: np.ndarray) -> None:
        """One Gibbs step: a random customer of each group gets up and is seated anew."""
        g = np.flatnonzero(self.n > 1)
        who = self.offset[g] + (self.rng.random(len(g)) * self.n[g]).astype(np.int64)
        self.size[self.seat[who]] -= 1
        self.tables[g[self.size[self.seat[who]] == 0]] -= 1
        self.place(g, who, self.n[g] - 1, fresh[g])


class Part:
    """One part's events, in order of dish and context, as groups on three levels.

    ``parent_of`` each context; without it four contexts in a row share a parent. ``hot`` has for each parent which of the
    frequent words it is, or -1: such a restaurant is spread over parts and seated in the ranges.
    """

    def __init__(self, events: tuple[np.ndarray, ...], hot: np.ndarray, parent_of: np.ndarray | None = None):
        dish, self.context_of, self.row, self.train = events
        context, self.hot_of, self.parent_of = self.context_of, hot, parent_of
        new = np.concatenate([[True], dish[1:] != dish[:-1]])
        self.word = np.cumsum(new) - 1  # of each event
        self.dishes = dish[new]
        inner = new | np.concatenate([[True], context[1:] != context[:-1]])
        self.pair = np.cumsum(inner) - 1
        self.context = context[inner].astype(np.int64)
        parent_context = self.context >> 2 if parent_of is None else parent_of[self.context]
        word_of_pair = self.word[inner]
        upper = np.concatenate([[True], (parent_context[1:] != parent_context[:-1]) | (word_of_pair[1:] != word_of_pair[:-1])])
        self.parent = np.cumsum(upper) - 1  # of each pair
        self.parents_context, self.parents_word = parent_context[upper], word_of_pair[upper]
        self.customers = np.bincount(self.pair, self.train, len(self.context)).astype(np.int64)
        self.count = np.bincount(self.word, self.train, len(self.dishes)).astype(np.int64)
        self.shape = DEFAULT_SHAPE if parent_of is None else (len(parent_of), len(hot))
        self.hot = hot[self.parents_context] if len(hot) else np.full(len(self.parents_word), -1)
        self.hot_groups = np.flatnonzero(self.hot >= 0)

    def packed(self, seated: Sums, common: np.ndarray) -> bytes:
        """Events, and tables of each restaurant."""
        return joined(*named(self.dishes, common), pack(np.bincount(self.word).astype(np.uint32)),
                      pack(self.context_of.astype(np.uint32)), pack(self.row * 2 + self.train), pack(np.bincount(self.parent_of).astype(np.uint32)), pack(self.hot_of),
                      pack(seated.t2.astype(np.uint32)), pack(seated.t1.astype(np.uint32)))

    @classmethod
    def unpacked(cls, data: bytes, common: np.ndarray) -> tuple[Part, np.ndarray, np.ndarray]:
        """The part, and tables of each restaurant on both levels."""
        u32 = np.uint32
        gaps, others, n, context, stamp, below, hot, t2, t1 = split(data, u32, _U, u32, u32, np.int64, u32, np.int16, u32, u32)
        events = np.repeat(words_of(gaps, others, common), n), context, stamp >> 1, stamp & 1
        return cls(events, hot, np.repeat(np.arange(len(below)), below)), t2, t1

    def sent(self, number: int, ranges: int, common: np.ndarray, count: np.ndarray,
             states: list[tuple[np.ndarray, ...]]) -> list[tuple]:
        """For each range its dishes, their tokens and, in every state, their root customers and those of frequent words."""
        bounds = np.searchsorted((self.dishes >> _U(32)) * _U(ranges) >> _U(32), np.arange(ranges + 1).astype(_U))
        groups = np.searchsorted(self.parents_word[self.hot_groups], bounds)
        out = []
        for at, (a, b, x, y) in enumerate(zip(bounds, bounds[1:], groups, groups[1:])):
            if b > a:
                own = self.hot_groups[x:y]
                columns = [self.parents_word[own] - a, self.hot[own], count[a:b],
                           *[c0[a:b] for _, _, _, c0, _ in states], *[c1[own] for _, c1, _, _, _ in states]]
                out.append((number, at, joined(*named(self.dishes[a:b], common), *[pack(c.astype(np.uint32)) for c in columns])))
        return out

    def states(self, sums: Sums, seed: int, samples: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Customers and tables of the groups of all levels, for each sample in turn."""
        rng = np.random.default_rng(seed)
        p1 = sums.guess(self.count)[self.parents_word]
        low = Seating(self.customers, DISCOUNT[2], rng)
        for sample in range(samples):
            fresh = sums.fresh(2, self.context) * p1[self.parent]
            if sample == 0:
                low.open_all(fresh)
            for _ in range(MOVES):
                low.move(fresh)
            c1 = np.bincount(self.parent, low.tables, len(self.parents_word)).astype(np.int64)
            p0 = sums.root(sums.counts(np.bincount(self.parents_word, c1 > 0, len(self.dishes))))
            middle = Seating(np.where(self.hot < 0, c1, 0), DISCOUNT[1], rng)
            fresh = sums.fresh(1, self.parents_context) * p0[self.parents_word]
            middle.open_all(fresh)
            for _ in range(MOVES):
                middle.move(fresh)
            c0 = np.bincount(self.parents_word, middle.tables, len(self.dishes)).astype(np.int64)
            t0 = (c0 > 0).astype(np.int64)  # a second table at the root would need the base measure's tiny share
            p0 = sums.root(sums.counts(c0))
            p1 = sums.serve(1, self.parents_context, *sums.middle(self, c1, middle.tables), p0[self.parents_word])
            yield low.tables.copy(), c1, middle.tables, c0, t0


DEFAULT_SHAPE = 1 << 14, 1 << 12


def root(c0: np.ndarray, total: float, tables: float, words: float) -> np.ndarray:
    """Probability of dishes with ``c0`` customers at the root."""
    base = (STRENGTH[0] + DISCOUNT[0] * tables) / (words + 1)
    return (np.maximum(c0 - DISCOUNT[0], 0) + base) / (STRENGTH[0] + max(total, 1))


class Sums:
    """Numbers of customers and tables of a part's restaurants in one state, as one flat array.

    ``told``: root customers of the part's dishes, if other parts have more of them. ``shape``: how many restaurants there
    are on the lower two levels.
    """

    def __init__(self, told: np.ndarray, flat: np.ndarray | None = None, tokens_: int = 1, words: int = 1,
                 shape: tuple[int, int] = DEFAULT_SHAPE):
        self.told, self.known = told, flat is not None
        self.contexts, self.parents = a, b = shape
        self.flat = np.zeros(2 * (a + b) + 2) if flat is None else flat
        self.tokens, self.words = max(tokens_, 1), words
        self.c2, self.t2, self.c1, self.t1 = np.split(self.flat[:2 * (a + b)], [a, 2 * a, 2 * a + b])
        self.c0, self.t0 = self.flat[2 * (a + b):2 * (a + b) + 2]
        self.word_counts, self.hot = None, None

    @classmethod
    def of_part(cls, part: Part, flat: np.ndarray, totals: Totals, sample: int, columns: Told) -> Sums:
        """A part's own sums with what the ranges know."""
        sums = cls(columns.c0[sample], flat, totals.tokens, totals.words, part.shape)
        sums.c0, sums.t0 = totals.root[sample]
        spread = part.hot_of >= 0
        for own, every in ((sums.c1, totals.customers), (sums.t1, totals.tables)):
            own[spread] = every[sample][part.hot_of[spread]]
        sums.hot = columns.c1[sample], columns.t1[sample]
        return sums

    def of(self, part: Part, state: tuple[np.ndarray, ...]) -> np.ndarray:
        """What a part adds to the sums."""
        t2, c1, t1, c0, t0 = state
        return np.concatenate([
            np.bincount(part.context, part.customers, self.contexts), np.bincount(part.context, t2, self.contexts),
            np.bincount(part.parents_context, c1, self.parents), np.bincount(part.parents_context, t1, self.parents),
            [c0.sum(), t0.sum()]])

    def fresh(self, level: int, context: np.ndarray) -> np.ndarray:
        """Weight of a new table in the restaurants of a level, but for the parent's probability."""
        tables = (self.t1 if level == 1 else self.t2)[context] if self.known else np.zeros(len(context))
        return STRENGTH[level] + DISCOUNT[level] * tables

    def guess(self, own: np.ndarray) -> np.ndarray:
        counts = own if self.word_counts is None else self.word_counts
        return np.maximum(counts, 1) / max(self.tokens, int(own.sum()))

    def counts(self, own: np.ndarray) -> np.ndarray:
        """Root customers of each dish."""
        return self.told if len(self.told) else own

    def middle(self, part: Part, c1: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables on the middle level, those of frequent words as the ranges told."""
        if self.hot is None or not len(part.hot_groups):
            return c1, t1
        out = c1.copy(), t1.copy()
        for whole_, told in zip(out, self.hot):
            whole_[part.hot_groups] = np.maximum(told, whole_[part.hot_groups] > 0)
        return out

    def root(self, c0: np.ndarray) -> np.ndarray:
        return root(c0, *((self.c0, self.t0) if self.known else (c0.sum(), (c0 > 0).sum())), self.words)

    def serve(self, level, context, customers, tables, parent):
        """Probability of a dish in its restaurant."""
        if not self.known:
            return parent
        c, t = (self.c1, self.t1) if level == 1 else (self.c2, self.t2)
        return (customers - DISCOUNT[level] * tables + (STRENGTH[level] + DISCOUNT[level] * t[context]) * parent) \
            / (STRENGTH[level] + c[context])


# --- ranges -------------------------------------------------------------------

class Totals:
    """Numbers that belong to no dish: tokens, words and, by sample, root customers and tables, and customers and tables in the
    restaurants of frequent words. Its size does not depend on the data."""

    def __init__(self, vector: np.ndarray, samples: int, hot: int):
        self.tokens, self.words = int(vector[0]), int(vector[1])
        by_sample = vector[2:].reshape(samples, 2 + 2 * hot)
        self.root, self.customers, self.tables = by_sample[:, :2], by_sample[:, 2:2 + hot], by_sample[:, 2 + hot:]

    @classmethod
    def gathered(cls, rows: DataFrame, samples: int, hot: int) -> Totals:
        total = np.zeros(2 + samples * (2 + 2 * hot))
        for r in rows.where("part IS NULL").select("data").collect():
            total += np.frombuffer(r.data, np.float64)
        return cls(total, samples, hot)


class Told:
    """What ranges told a part: tokens and root customers of its dishes, customers and tables in its groups of frequent words."""

    def __init__(self, pieces_: list[bytes], samples: int):
        found = [split(data, *[np.uint32] * (1 + 3 * samples)) for data in pieces_]
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
        self.count, self.c0 = columns[0], columns[1:1 + samples]
        self.c1, self.t1 = columns[1 + samples:1 + 2 * samples], columns[1 + 2 * samples:]


def in_ranges(sent: DataFrame, ranges: int, hot: int, common: np.ndarray, samples: int, before_: Totals | None) -> DataFrame:
    """What parts sent, summed by dish; frequent words are seated on the middle level. One row for each that was sent, and
    rows without part that hold totals."""
    def told(at: int, numbers: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [split(data, np.uint32, _U, *[np.uint32] * (3 + 2 * samples)) for data in blobs]
        found = [[words_of(*f[:2], common), *f[2:]] for f in found]
        sizes, groups = [len(f[0]) for f in found], [len(f[1]) for f in found]
        words, code = np.unique(np.concatenate([f.pop(0) for f in found]), return_inverse=True)
        words, code = len(words), code.astype(np.int32)
        given = [np.concatenate(c) for c in zip(*found)]
        del found

        def column(i):  # each is asked for once
            out, given[i - 1] = given[i - 1], None
            return out

        of_group = code[column(1) + np.repeat(np.cumsum(sizes) - sizes, groups)].astype(np.int64)
        keys, group = np.unique(of_group * max(hot, 1) + column(2), return_inverse=True)
        word, frequent_ = keys // max(hot, 1), keys % max(hot, 1)
        count = np.bincount(code, column(3), words)
        totals, out = [count.sum(), (count > 0).sum()], [[count.astype(np.uint32)[code]], [], [], []]
        rng = np.random.default_rng([samples, at])
        for s in range(samples):
            c0 = np.bincount(code, column(4 + s), words)
            c1 = np.bincount(group, column(4 + samples + s), len(keys)).astype(np.int64)
            least = c0 + np.bincount(word, c1 > 0, words)
            if before_ is None:
                p0, tables = root(least, least.sum() * ranges, (least > 0).sum() * ranges, totals[1] * ranges), np.zeros(max(hot, 1))
            else:
                p0, tables = root(least, *before_.root[0], before_.words), np.append(before_.tables[0], 0)
            seating = Seating(c1, DISCOUNT[1], rng)
            fresh = (STRENGTH[1] + DISCOUNT[1] * tables[frequent_]) * p0[word]
            seating.open_all(fresh)
            for _ in range(MOVES):
                seating.move(fresh)
            c0 += np.bincount(word, seating.tables, words)
            totals += [c0.sum(), (c0 > 0).sum(), *np.bincount(frequent_, c1, hot)[:hot], *np.bincount(frequent_, seating.tables, hot)[:hot]]
            for columns, values in zip(out[1:], (c0.astype(np.uint32)[code], c1[group], seating.tables[group])):
                columns.append(values)
        dish_ends, group_ends = np.cumsum(sizes), np.cumsum(groups)
        for number, b, y, n, m in zip(numbers, dish_ends, group_ends, sizes, groups):
            yield pieces([(number, at, joined(*[pack(c[b - n:b].astype(np.uint32)) for c in out[0] + out[1]],
                                              *[pack(c[y - m:y].astype(np.uint32)) for c in out[2] + out[3]]))])
        yield pieces([(None, at, np.array(totals, np.float64).tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, numbers, blobs = None, [], []
        for batch in batches:
            for number, at, data in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "data"))):
                if at != last and blobs:
                    yield from told(last, numbers, blobs)
                    numbers, blobs = [], []
                last = at
                numbers.append(number)
                blobs.append(data)
        if blobs:
            yield from told(last, numbers, blobs)

    return sent.repartition(ranges, "at").sortWithinPartitions("at", "part").mapInArrow(textkit.released(run), PIECE)


# --- passes -------------------------------------------------------------------

def by_part(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[tuple[int, bytes, list[bytes], list[bytes]]]:
    """(part, events, what ranges told after the first pass, and after the second) from rows in order."""
    now, held = None, ([], [], [])
    for batch in batches:
        for part, at, data in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "data"))):
            if part != now and now is not None:
                yield now, held[0][0], held[1], held[2]
                held = [], [], []
            now = part
            held[0 if at < 0 else 1 if at < ranges else 2].append(data)
    if now is not None:
        yield now, held[0][0], held[1], held[2]


def started(events: bytes, told: list[bytes], totals: Totals, common: np.ndarray) -> tuple[Part, Sums, Told]:
    """A part with its sums after the first pass."""
    part, t2, t1 = Part.unpacked(events, common)
    columns = Told(told, 1)
    c2 = np.bincount(part.context, part.customers, part.shape[0])
    flat = np.concatenate([c2, t2, np.bincount(part.parent_of, t2, part.shape[1]), t1, [0, 0]])
    sums = Sums.of_part(part, flat, totals, 0, columns)
    sums.word_counts = columns.count
    return part, sums, columns


def sampled(given: DataFrame, totals: Totals, ranges: int, common: np.ndarray) -> DataFrame:
    """What parts send to the ranges in the states that are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, events, told, _ in by_part(batches, ranges):
            part, start, _ = started(events, told, totals, common)
            none = np.zeros(len(part.dishes), np.int64)
            yield pieces(part.sent(number, ranges, common, none, list(part.states(start, number, SAMPLES))))

    return given.mapInArrow(textkit.released(run), PIECE)


def read_off(given: DataFrame, totals: Totals, after: Totals, ranges: int, common: np.ndarray) -> DataFrame:
    """(row, n_tokens, n_known, base, score) of each document as far as a task's parts go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns = [], []
        for number, events, told, told_after in by_part(batches, ranges):
            part, start, first = started(events, told, totals, common)
            then, p = Told(told_after, SAMPLES), np.zeros(len(part.context))
            after.tokens, after.words = totals.tokens, totals.words
            for s, state in enumerate(part.states(start, number, SAMPLES)):
                sums = Sums.of_part(part, start.of(part, state), after, s, then)
                t2, c1, t1, _, _ = state
                p1 = sums.serve(1, part.parents_context, *sums.middle(part, c1, t1), sums.root(sums.told)[part.parents_word])
                p += sums.serve(2, part.context, part.customers, t2, p1[part.parent]) / SAMPLES
            row, at = np.unique(part.row, return_inverse=True)
            rows.append(row)
            columns.append(np.stack([np.bincount(at, minlength=len(row)), np.bincount(at, first.count[part.word] > 0),
                                     np.bincount(at, np.log10(first.count + 0.1)[part.word]),
                                     np.bincount(at, np.log10(p)[part.pair])]))
        if rows:
            row, at = np.unique(np.concatenate(rows), return_inverse=True)
            sums = [np.bincount(at, c) for c in np.concatenate(columns, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(c.astype(np.int64)) for c in sums[:2]),
                                              *map(pa.array, sums[2:])], ["row", "n_tokens", "n_known", "base", "score"])

    return given.mapInArrow(textkit.released(run), "row long, n_tokens long, n_known long, base double, score double")


def ids_of(blobs: DataFrame) -> DataFrame:
    """(row, doc_id) from the parts that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                row, ids, valid = split(data, np.int64, np.int64, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids, mask=valid == 0)], ["row", "doc_id"])

    return blobs.select("data").mapInArrow(run, "row long, doc_id long")


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    Tokens are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case, then one end for each text; NULL and empty texts have
    the end alone. Learned from documents with crc32(doc_id) mod 10 <> 0. base_score is the sum of log10((c + 0.1) / (N +
    0.1 * (V + 1))) over tokens, score that of the model's averaged predictive probabilities. Rows that repeat a doc_id
    are documents of their own; a NULL doc_id counts as the empty text, so such rows are held out. No documents give no
    rows; without training documents all words are equally likely.
    """
    rows = whole(docs).select("doc_id", "text", (crc_part("doc_id", HELD_OUT) != 0).alias("train"),
                              F.monotonically_increasing_id().alias("row"))
    tasks = tasks_for(docs)
    parts, ranges = tasks * PARTS_PER_TASK, max(8, tasks // 3)
    hot, ranked = frequent(rows)
    common = np.sort(ranked)
    dealt_out = written(merged(dealt(rows, parts, hot, ranked), parts, tasks, hot, ranked, ranges))
    told = written(in_ranges(dealt_out.where("at >= 0"), ranges, len(hot), common, 1, None))
    totals = Totals.gathered(told, 1, len(hot))
    n, words = totals.tokens, totals.words
    given = dealt_out.where((F.col("part") < parts) & (F.col("at") < 0)).unionByName(told.where("part IS NOT NULL"))

    def in_order(pieces_):
        return pieces_.repartition(max(8, tasks // 3), "part").sortWithinPartitions("part", "at")

    sent = written(sampled(in_order(given), totals, ranges, common))
    then = written(in_ranges(sent, ranges, len(hot), common, SAMPLES, totals))
    after = then.where("part IS NOT NULL").withColumn("at", F.col("at") + ranges)
    scores = read_off(in_order(given.unionByName(after)), totals, Totals.gathered(then, SAMPLES, len(hot)), ranges, common)
    no_tokens = [F.lit(0).cast(kind).alias(c) for c, kind in
                 (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double"))]
    sums = (scores.withColumn("doc_id", F.lit(None).cast("long"))
            .unionByName(ids_of(dealt_out.where(F.col("part") >= parts)).select("row", "doc_id", *no_tokens))
            .groupBy("row").agg(F.max("doc_id").alias("doc_id"),
                                *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")]))
    total = F.log10(F.lit(n + 0.1 * (words + 1)))
    return sums.select(
        "doc_id", (crc_part("doc_id", HELD_OUT) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * total).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
