"""Exact Jaccard similarity join of word shingle sets with PartEnum signatures.

Sets of similar size share a *frame*: sizes from 2^j up to 2^(j+1), with those of the next frame that can still be
similar to one of them as guests. A frame splits the domain of shingle hashes into about 0.8 * 2^j partitions. Two sets
that are similar enough differ in at most k shingles, so at most k partitions of either differ; each set with more than
k partitions in use therefore shares the whole content of one with every similar set. The content of each partition in
use is one signature. Sets that use k partitions or fewer also enumerate the finest partitions, single shingles, of
which more than k are in use always. A pair is met if either of the two is of the first kind, or both are of the second.

Sets that share a signature form a bucket. Buckets are never expanded into all pairs:

1. Members of a bucket are compared with its first member, first each with the one it shares most signatures with.
2. Buckets in which all members are connected by then are done.
3. Of the others, members are compared with all behind them, 0 to 7, 8 to 63 and so on, as far as they are not
   connected. The first of those that are left need not be the one that all met: members may have met the first one of
   their slice of the input, or the bucket's first member is not among them.
4. Where more than ``HOT`` sets share a signature (a passage that many texts quote), only those sets take part that have k
   partitions or fewer which are not so common: all others share a rare one with each similar set. These sets meet by
   what tells them from the shingles that most of them have, the rarest first (see ``rarest_shingles``), so that many
   variants of one text are only compared if they vary in the same places.

Pairs are dropped before their sets are read if the counts of their shingles in some hundred classes (more for larger
sets) differ by more than k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .common import counted, only, packed, small, tasks_for, whole, without, written
from .components import components, connected

WORDS = 5
SLICE = 1 << 20  # bytes of text whose signatures are made at a time, about
HOT = 32
SETS = 1 << 11  # sets or pairs of them that a task gets, about
FINEST = 32  # added to the number of a frame in the signatures of single shingles
_U = np.uint64
PROFILE = "doc_id long, n long, fp binary, sketch binary, used int, used_below int"
SIGNATURES = "key long, doc_id long, local struct<sig:long,pivot:long>"
MEMBERS = "sig long, doc_id long, pivot long"


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles) of every text; with fewer than WORDS words one for all of them."""
    for lo, hi, words in textkit.batches(batch, "text"):
        grams, first = textkit.grams(words.hash, WORDS), words.first.tolist()
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= WORDS:
                yield lo + i, np.unique(grams[a:b - WORDS + 1])
            else:
                yield lo + i, textkit.grams(words.hash[a:b], b - a) if b > a else words.hash[:0]


def fingerprint(shingles: np.ndarray) -> bytes:
    return np.array([shingles.sum(), np.bitwise_xor.reduce(textkit.mix(shingles + _U(1)))], _U).tobytes()


def frames_of(n: int) -> list[tuple[int, int]]:
    """(frame, largest number of shingles that a similar set of the frame differs in) of sets of n shingles."""
    home = n.bit_length() - 1
    top = (1 << home) - 1  # the largest size of the frame below
    below = [(home - 1, (n + top) // 7)] if home and 3 * n <= 4 * top else []
    return [(home, (n + 4 * n // 3) // 7), *below]


def partitions(shingles: np.ndarray, frame: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each partition in use begins in the sorted set, and its number."""
    index = ((shingles >> _U(32)) * _U(max(1, (4 << frame) // 5))) >> _U(32)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1])
    return starts, index[starts]


def sketch(shingles: np.ndarray) -> bytes:
    """Counts, at most 255 each, of 256 classes or about as many as a third of the set."""
    classes = max(256, 1 << max(len(shingles).bit_length() - 2, 0))
    counts = np.bincount((shingles & _U(classes - 1)).astype(np.intp), minlength=classes)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def apart(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Sum of the differences of two columns of sketches, a lower bound for the number of differing shingles.

    Classes are the last bits of a hash, so a longer sketch is folded to the length of a shorter one.
    """
    out = np.zeros(len(left), np.int64)
    a, b = left.to_pylist(), right.to_pylist()
    short = [i for i in range(len(a)) if len(a[i]) == len(b[i]) == 256]
    if short:
        x, y = (np.frombuffer(b"".join([c[i] for i in short]), np.uint8).reshape(-1, 256).astype(np.int16) for c in (a, b))
        out[short] = np.abs(x - y).sum(axis=1, dtype=np.int64)
    for i in set(range(len(a))) - set(short):
        x, y = (np.frombuffer(c[i], np.uint8).astype(np.int64) for c in (a, b))
        least = min(len(x), len(y))
        x, y = (np.minimum(c.reshape(-1, least).sum(axis=0), 255) for c in (x, y))
        out[i] = np.abs(x - y).sum()
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """Size, fingerprint, class counts (at most 255 each) and partitions in use of every row's shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sketches, used = [], [], [], []
            for _, shingles in shingle_sets(batch):
                sizes.append(len(shingles))
                prints.append(fingerprint(shingles))
                sketches.append(sketch(shingles))
                frames = frames_of(len(shingles)) if len(shingles) else []
                used.append([len(partitions(shingles, f)[0]) for f, _ in frames] + [None] * (2 - len(frames)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(sketches, pa.binary()), *(pa.array([u[i] for u in used], pa.int32()) for i in (0, 1))],
                ["doc_id", "n", "fp", "sketch", "used", "used_below"])

    return whole(docs).mapInArrow(textkit.released(run), PROFILE)


def signatures_of(shingles: np.ndarray) -> list[np.ndarray]:
    """Signatures of a set in all its frames: of partitions in use, and of single shingles if those are too few."""
    out = []
    for frame, most in frames_of(len(shingles)):
        starts, index = partitions(shingles, frame)
        content = np.add.reduceat(shingles, starts)
        out.append(_label(textkit.mix(content + index * _U(0x9E3779B97F4A7C15)), frame))
        if len(starts) <= most:
            out.append(_label(textkit.mix(shingles ^ _U(0xD6E8FEB86659FD93)), FINEST + frame))
    return out


def _label(hashes: np.ndarray, frame: int) -> np.ndarray:
    return (hashes & ~_U(63)) | _U(frame)


def signatures(docs: DataFrame) -> DataFrame:
    """Signatures of all sets. If a slice holds one more than HOT / 4 times, its first row goes on alone; all its rows are
    members already, with their pivot in the slice and a key of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in textkit.slices(batch, "text", SLICE)):
            ids = batch.column("doc_id").to_numpy()
            sigs, rows = [], []
            for row, shingles in shingle_sets(batch):
                for sig in signatures_of(shingles) if len(shingles) else []:
                    sigs.append(sig)
                    rows.append(np.full(len(sig), row, np.int32))
            if not sigs:
                continue
            sig, doc = np.concatenate(sigs).view(np.int64), ids[np.concatenate(rows)]
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            counts = np.diff(starts, append=len(sig))
            many = np.repeat(counts > HOT // 4, counts)
            pivot = np.repeat(doc[starts], counts)
            order = np.concatenate([np.arange(len(sig)), starts[counts > HOT // 4]])
            sig, doc, pivot, many = (x[order] for x in (sig, doc, pivot, many))
            many[len(many) - int((counts > HOT // 4).sum()):] = False
            key = np.where(many, textkit.mix(sig.view(_U) + doc.astype(_U)).view(np.int64), sig)
            local = pa.StructArray.from_arrays([pa.array(sig), pa.array(pivot)], ["sig", "pivot"], mask=pa.array(~many))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), local], ["key", "doc_id", "local"])

    return whole(docs).where("doc_id IS NOT NULL").mapInArrow(textkit.released(run), SIGNATURES)


def buckets(found: DataFrame, tasks: int) -> DataFrame:
    """Members of all signatures that more than one set has, with the first member of each.

    A task reads its rows sorted by signature, one batch after the other, and remembers one bucket's head.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # signature, its first member, that member's row if it isn't told yet
        for batch in batches:
            local = batch.column("local")
            inner = np.asarray(local.is_valid())
            key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            sig, pivot = (local.field(i).fill_null(0).to_numpy() for i in (0, 1))
            parts = [(sig[inner], doc[inner], pivot[inner])]
            if not inner.all():
                k, d = key[~inner], doc[~inner]
                starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                counts = np.diff(starts, append=len(k))
                first, shared = np.repeat(d[starts], counts), np.repeat(counts > 1, counts)
                if last is not None and last[0] == k[0]:
                    first[:counts[0]], shared[:counts[0]] = last[1], True
                    if last[2] is not None:
                        parts.append(tuple(np.array([v]) for v in last[2]))
                last = (k[-1], first[-1], None if shared[-1] else (k[-1], d[-1], d[-1]))
                parts.append((k[shared], d[shared], first[shared]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                             ["sig", "doc_id", "pivot"])

    return found.repartition(tasks, "key").sortWithinPartitions("key", "doc_id").mapInArrow(textkit.released(run), MEMBERS)


def close_enough(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a written table of pairs (a, b, ...) that sizes and class counts do not rule out."""
    rows = pairs.count()
    ids = written(packed(pairs.select(F.explode(F.array("a", "b")).alias("_in")).distinct(), rows))
    known = known.join(small(ids), F.col("doc_id") == F.col("_in"), "left_semi")
    one, other = (known.select(*[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "sketch")])
                  for side in "ab")
    found = packed(pairs.join(one, F.col("a") == F.col("doc_id_a")).join(other, F.col("b") == F.col("doc_id_b")), rows)
    found = found.where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")

    @F.arrow_udf("long")
    def difference(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(apart(left, right), pa.int64())

    return found.where(7 * difference("sketch_a", "sketch_b") <= F.col("n_a") + F.col("n_b")).select(*pairs.columns)


def verified(pairs: DataFrame, docs: DataFrame, count: int) -> DataFrame:
    """Those of ``count`` pairs (a, b) of different sets that are similar enough, counted on the sets themselves.

    The sets of b go to the pair's a, so that only one set for each pair and one for each a are moved.
    """
    def sets(*args) -> Iterator[pa.RecordBatch]:
        *ids, batches = args
        for batch in (part for batch in batches for part in textkit.slices(batch, "text", SLICE)):
            found = pa.array([s.tobytes() for _, s in shingle_sets(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in ids), found], [*ids, "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = whole(docs)
    other = texts.join(small(pairs), F.col("doc_id") == F.col("b")).select("a", "b", "text")
    other = other.mapInArrow(partial(sets, "a", "b"), "a long, b long, shingles binary")
    pivots = only(texts, pairs.select(F.col("a").alias("doc_id"))).mapInArrow(
        partial(sets, "doc_id"), "doc_id long, shingles binary")
    rows = other.join(pivots.select(F.col("doc_id").alias("_a"), F.col("shingles").alias("x")), F.col("a") == F.col("_a"))
    return packed(rows.select("a", "b", "x", F.col("shingles").alias("y")), count, SETS).mapInArrow(compare, "a long, b long")


def similarity_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text, ...).

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case. Sets hold distinct 5-word shingles, as 64-bit
    hashes; texts of 1 to 4 words have one shingle, texts without words (NULL and empty ones) none and no links. Sets
    with 100 * common >= 75 * all are linked, component_id is the smallest doc_id that links reach. A NULL doc_id is
    linked with nothing and has component NULL. Rows that repeat a doc_id with the same text are one text; with different
    texts they count as one document that has the links of either, as far as sets of the first such row show them.
    """
    tasks = tasks_for(docs)
    known = written(profiles(docs))
    one = known.where("doc_id IS NOT NULL AND n > 0")
    first = one.groupBy("fp").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("fp", "a")
    copies = written(one.join(first, "fp").where("doc_id <> a").select("a", F.col("doc_id").alias("b")))
    members, n_members = counted(buckets(signatures(without(docs, copies.select(F.col("b").alias("doc_id")))), tasks))
    met = members.where("doc_id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    met = written(packed(met.agg(F.count("*").alias("shared")), n_members))
    stars, n_stars = counted(close_enough(met, one))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    best, n_best = counted(packed(best.select("a", "b"), n_stars))
    links, n_links = counted(copies.union(verified(best, docs, n_best)))
    labels = components(links, n_links)

    def loose(pairs: DataFrame) -> DataFrame:
        """Pairs that no links connect yet."""
        la, lb = (small(labels.select(F.col("doc_id").alias(f"_{s}"), F.col("label").alias(f"_l{s}"))) for s in "ab")
        return (pairs.join(la, F.col("a") == F.col("_a"), "left").join(lb, F.col("b") == F.col("_b"), "left")
                .where("coalesce(_la, a) <> coalesce(_lb, b)").select("a", "b"))

    def add(pairs: DataFrame) -> None:
        nonlocal labels
        pairs, n = counted(pairs)
        if not n:
            return
        found, n = counted(verified(pairs, docs, n))
        if n:
            labels = connected(labels, found, n)

    add(loose(stars.select("a", "b")))
    cold, crowded = unfinished(members, labels, one, n_members)
    cold = cold.select("sig", "doc_id", F.lit(True).alias("leads"), F.lit(0).alias("own"), F.lit(0).alias("n"))
    rest, n_rest = counted(cold.union(rarest_shingles(docs, crowded)))
    rest, n_rest = counted(opened(rest, labels, n_rest))
    low, high = 0, 1
    while not rest.where("leads").where(F.col("nth") >= low).limit(1).isEmpty():
        head, tail = rest.where("leads").where(F.col("nth").between(low, high - 1)), rest.where(F.col("nth") > low)
        x, y = (side.select(*[F.col(c).alias(f"{c}_{name}") for c in ("sig", "doc_id", "label", "own", "n", "nth")])
                for side, name in ((head, "x"), (tail, "y")))
        pairs = packed(x.join(y, (F.col("sig_x") == F.col("sig_y")) & (F.col("nth_x") < F.col("nth_y"))
                              & (F.col("label_x") != F.col("label_y")) & F.expr("7 * (own_x + own_y) <= n_x + n_y")), n_rest)
        pairs = pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))
        pairs, n_pairs = counted(packed(pairs.distinct(), n_rest))
        if low == 0:
            pairs, n_pairs = counted(packed(pairs.join(met, ["a", "b"], "left_anti"), n_pairs))
        before = labels
        if n_pairs:
            add(close_enough(pairs, one))
        if labels is not before:  # some buckets are done now; the others keep their order
            rest, n_rest = counted(opened(rest.drop("label", "nth"), labels, n_rest))
        low, high = high, 8 * high
    result = labels.select(F.col("doc_id").alias("_id"), "label")
    return known.join(result, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def opened(rows: DataFrame, labels: DataFrame, count: int) -> DataFrame:
    """Of ``count`` rows (sig, doc_id, leads, own, n) those of buckets that are not connected yet, with labels and numbered within each bucket.

    Members that lead come first; pairs of others need no look. Of buckets with the same members (neighbouring shingles of
    one passage) one is enough.
    """
    labels = labels.select(F.col("doc_id").alias("_id"), "label")
    named = rows.join(small(labels), F.col("doc_id") == F.col("_id"), "left") \
        .select(*rows.columns, F.coalesce("label", "doc_id").alias("label"))
    sums = [F.sum(F.xxhash64(F.lit(seed), "doc_id", "leads", "own").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    chosen = (named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"),
                                       F.max("leads").alias("led"), *sums)
              .transform(packed, count).where("lo <> hi AND led").groupBy("size", "h1", "h2").agg(F.min("sig").alias("_sig")).select("_sig"))
    order = Window.partitionBy("sig").orderBy(F.desc("leads"), "doc_id")
    found = named.join(chosen, F.col("sig") == F.col("_sig"), "left_semi").withColumn("nth", F.row_number().over(order) - 1)
    return packed(found, count)


def rarest_shingles(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(sig, doc_id, leads, own, n) of the sets of these documents: what few have in common, with the number of shingles
    that come before it.

    Similar sets are in the same class of sizes or in neighbouring ones, and every set is a member of its own and of the
    one below. In each class a set stands for what tells it from the shingles that more than half of the class have:
    those it has besides and those it lacks, the rarest first. Two sets differ in what these lists differ in, in
    k = (n + n) / 7 at most if they are similar. All that stands before the first thing on both lists is on one of them
    only, so the two numbers before it are k together: no more than n / 3 each, and no more than n / 6 on one, which leads.
    Lists of k things together need not have anything in common, but are those of similar sets: these meet in the middle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in textkit.slices(batch, "text", SLICE)):
            sets = [s for _, s in shingle_sets(batch)]
            held = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32),
                                            pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), held],
                ["doc_id", "row", "n", "held"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, kind = (batch.column(c).to_numpy() for c in ("doc_id", "n", "class"))
            at, sig, own = [], [], []
            for i in range(batch.num_rows):
                held, usual, missed, some, often = (_numbers(batch.column(c)[i])
                                                    for c in ("held", "usual", "missed", "some", "often"))
                lacks = ~np.isin(usual, held, assume_unique=True)
                few = lacks & (missed == 1)  # nobody else lacks these, so nobody meets by them
                lacks &= ~few
                besides = n[i] - (len(usual) - int(lacks.sum()) - int(few.sum()))
                first = besides - len(some) + int(few.sum())
                rest, times = np.concatenate([some, usual[lacks]]), np.concatenate([often, missed[lacks]])
                if 3 * (first + len(rest)) <= n[i]:
                    at.append(i), sig.append([None]), own.append([first + len(rest)])
                rest = rest[np.lexsort((rest, times))][:max(0, n[i] // 3 - first + 1)]
                at.extend([i] * bool(len(rest))), sig.extend([rest] * bool(len(rest)))
                own.extend([first + np.arange(len(rest))] * bool(len(rest)))
            rows = np.repeat(np.array(at, np.intp), [len(s) for s in sig])
            sig = pa.concat_arrays([pa.array(s, pa.int64()) for s in sig]) if sig else pa.array([], pa.int64())
            own = pa.array(np.concatenate([*own, np.zeros(0)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(n[rows]), pa.array(kind[rows]), sig, own],
                                             ["doc_id", "n", "class", "sig", "own"])

    rows = only(whole(docs), ids).withColumn("row", F.monotonically_increasing_id())
    rows = rows.mapInArrow(textkit.released(run), "doc_id long, row long, n long, held array<long>").where("n > 0")
    rows = rows.withColumn("class", F.floor(F.log("n") / log(4 / 3)))
    sets, n_sets = counted(rows.withColumn("class", F.explode(F.array("class", F.col("class") - 1))))
    often = sets.select("class", F.explode("held").alias("sig")).groupBy("class", "sig").agg(F.count("*").alias("often"))
    often = written(often.where("often > 1").join(F.broadcast(sets.groupBy("class").agg(F.count("*").alias("all"))), "class")
                    .withColumn("common", F.expr("2 * often > all")))
    both = F.sort_array(F.collect_list(F.struct("sig", (F.col("all") - F.col("often")).alias("missed"))))
    common = often.where("common").groupBy("class").agg(both.alias("c")).select(
        "class", F.col("c.sig").alias("usual"), F.col("c.missed").alias("missed"))
    sets = sets.join(F.broadcast(common), "class", "left")
    besides = sets.select("row", "class", F.explode(F.expr(
        "CASE WHEN usual IS NULL THEN held ELSE array_except(held, usual) END")).alias("sig"))
    told = packed(besides.join(often.where("NOT common").select("class", "sig", "often"), ["class", "sig"]), n_sets, SETS)
    told = told.groupBy("row", "class").agg(F.collect_list("sig").alias("some"), F.collect_list("often").alias("often"))
    placed = packed(sets.join(told, ["row", "class"], "left"), n_sets, SETS).select(
        "doc_id", "n", "class", "held", "usual", "missed", "some", "often")
    placed = placed.mapInArrow(textkit.released(place), "doc_id long, n long, class long, sig long, own long")
    return packed(placed.groupBy(F.xxhash64("sig", "class").alias("sig"), "doc_id").agg(
        F.max(F.expr("6 * own <= n")).alias("leads"), F.min("own").alias("own"), F.max("n").alias("n")), n_sets, SETS)


def _numbers(values: pa.ListScalar) -> np.ndarray:
    return values.values.to_numpy() if values.is_valid else np.zeros(0, np.int64)


def unfinished(members: DataFrame, labels: DataFrame, known: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Of ``count`` members those (sig, doc_id) of buckets of at most HOT that are not connected yet, and the documents that could hide a
    link in larger ones."""
    labels = labels.select(F.col("doc_id").alias("_id"), "label")
    named = members.join(small(labels), F.col("doc_id") == F.col("_id"), "left") \
        .select("sig", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    spread = (named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
              .where(f"size > {HOT} OR lo <> hi").select(F.col("sig").alias("_sig"), "size", (F.col("lo") != F.col("hi"))
                                                         .alias("open")))
    named = named.join(spread, F.col("sig") == F.col("_sig")).dropDuplicates(["sig", "doc_id"])
    named = written(packed(named.select("sig", "doc_id", "open", (F.col("size") > HOT).alias("hot")), count))
    code = F.col("sig").bitwiseAND(63).cast("int")
    common = (named.where("hot").groupBy("doc_id", code.alias("code")).agg(F.count("*").alias("n_hot"))
              .join(known.select(F.col("doc_id").alias("_known"), "n", "used", "used_below"),
                    F.col("doc_id") == F.col("_known"))
              .withColumn("home", F.floor(F.log2("n") + F.lit(1e-9)).cast("int"))
              .withColumn("in_use", F.when(F.col("code") >= FINEST, F.col("n"))
                          .otherwise(F.when(F.col("code") == F.col("home"), F.col("used")).otherwise(F.col("used_below"))))
              .withColumn("most", F.expr(f"""CASE WHEN code % {FINEST} = home THEN (n + 4 * n div 3) div 7
                                                  ELSE (n + shiftleft(1L, home) - 1) div 7 END"""))
              .where("in_use - n_hot <= most").select(F.col("doc_id").alias("_doc"), F.col("code").alias("_code")))
    crowded = named.where("open AND hot").join(
        common, (F.col("doc_id") == F.col("_doc")) & (code == F.col("_code")), "left_semi").select("doc_id").distinct()
    crowded = packed(crowded, count)
    return named.where("open AND NOT hot").select("sig", "doc_id"), written(crowded)


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that are linked with a document of smaller id."""
    return without(docs, written(similarity_classes(docs).where("component_id <> doc_id").select("doc_id")))
