"""Benchmark search and the language model against brute force, and the pipeline from end to end."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from mapframe.llm import bpe, decontam, lm

SF = "/root/testdata/sf0.001"


# --- benchmark items ------------------------------------------------------------

def random_items(seed, n=150):
    rnd = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    return [(100 + i, " ".join(rnd.choice(common if rnd.random() < 0.5 else rare) for _ in range(rnd.randrange(4, 25)))
             + ". " + " ".join(rnd.choice(rare) for _ in range(5))) for i in range(n)]


def test_search_finds_all_above_the_threshold():
    items, rnd = random_items(4), random.Random(9)
    index = decontam.Index(items)
    scores = {}
    for t, (found, impacts) in enumerate(index.lists):
        for i, w in zip(found, impacts):
            scores.setdefault(t, []).append((i, w))
    hits = 0
    for _ in range(300):
        source = decontam.terms_of(" ".join(items[rnd.randrange(len(items))][1] for _ in range(rnd.randrange(1, 3))))
        known = index.term_numbers(source)
        terms = sorted({int(t) for t in known if t >= 0 and rnd.random() < 0.7})
        total = Counter()
        for t in terms:
            for i, w in scores[t]:
                total[i] += w
        want = {i for i, s in total.items() if s >= decontam.LEAST_SCORE}
        assert {i for i, _ in index.search(terms)} == want
        hits += len(want)
    assert hits > 100


def test_leaks(spark, docs_of, monkeypatch):
    items = random_items(5, 40) + [(7, None), (8, ""), (9, "single short item")]
    rnd = random.Random(1)
    filler = lambda n: " ".join(f"c{rnd.randrange(12)} z{rnd.randrange(5000)}" for _ in range(n))
    rows, want = [(500, None), (501, ""), (502, "c1 c2 c3")], set()
    for i, (item, text) in enumerate(items[:40]):
        rows.append((i, f"{filler(rnd.randrange(300))} {text.upper()}, {filler(rnd.randrange(300))}"))
        rows.append((i + 100, filler(200)))
        want.add((i, item))
    df = docs_of(rows).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == want
    monkeypatch.setattr(decontam, "ITEMS", 15)  # several rounds
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == want
    assert decontam.drop_leaks(df, bench).count() == len(rows) - 40
    assert decontam.leaks(df, bench.limit(0)).count() == 0


# --- language model -------------------------------------------------------------

def test_everybody_is_seated_one_after_the_other():
    """Numbers and sizes of tables of groups with more than 32 customers, against one customer at a time."""
    rnd, rng = random.Random(3), np.random.default_rng(4)

    def one_by_one(n, d, fresh):
        tables = []
        for i in range(n):
            at = rnd.random() * (i - d * len(tables) + fresh) - fresh
            k = 0
            while at >= 0 and k < len(tables) - 1 and at >= tables[k] - d:
                at -= tables[k] - d
                k += 1
            if at < 0 or not tables:
                tables.append(1)
            else:
                tables[k] += 1
        return tables

    for n, d, fresh in ((120, 0.8, 3.0), (90, 0.5, 0.4), (3, 0.7, 0.5), (2, 0.8, 0.01)):
        want = [one_by_one(n, d, fresh) for _ in range(2000)]
        rows = 3000
        seating = lm.Seating(np.full(rows, n), d, rng)
        seating.open_all(np.full(rows, fresh))
        sizes = seating.size.reshape(rows, n)
        assert (sizes.sum(axis=1) == n).all() and (seating.tables == (sizes > 0).sum(axis=1)).all()
        assert (seating.seat // n == np.repeat(np.arange(rows), n)).all()
        assert (np.bincount(seating.seat, minlength=rows * n) == seating.size).all()
        for found, known in (((sizes > 0).sum(axis=1), [len(t) for t in want]),
                             ((sizes == 1).sum(axis=1), [t.count(1) for t in want]),
                             (sizes.max(axis=1), [max(t) for t in want])):
            error = math.hypot(np.std(found) / math.sqrt(rows), np.std(known) / math.sqrt(len(want)))
            assert abs(np.mean(found) - np.mean(known)) <= 4.5 * error, (n, d, fresh)


def test_language_scores(docs_of):
    rnd = random.Random(2)
    pairs = {f"a{i}": [f"b{(7 * i + j) % 40}" for j in range(3)] for i in range(40)}
    rows = [(i, " ".join(f"{a} {rnd.choice(pairs[a])}" for a in rnd.choices(list(pairs), k=rnd.randrange(30))))
            for i in range(200)] + [(900, None), (901, ""), (902, "New NEW words"), (900, "again"),
                                            (None, "a1 b7"), (None, None), (903, "long " * 30000)]
    got = lm.language_scores(docs_of(rows).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))).collect()
    texts = [(i, (text or "").encode().lower().split() + [None]) for i, text in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in texts}
    counts = Counter(w for i, words in texts if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    want = [(-1 if i is None else i, held[i], len(words), sum(counts[w] > 0 for w in words), n,
             sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) for i, words in texts]
    found = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]
    for a, b in zip(sorted(want), sorted(found), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 * abs(a[5]) + 1e-9
    gain = [r.score - r.base_score for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(gain) > 0
    assert lm.language_scores(docs_of([])).count() == 0


def test_probabilities_sum_to_one():
    """All words, seen or not, after one context; every state is read with its own sums."""
    rng = np.random.default_rng(3)
    n, words, hot = 4000, 60, np.zeros(0, np.uint64)
    dish = lm.textkit.mix(rng.zipf(1.4, n).clip(1, words).astype(np.uint64))
    context = rng.integers(0, 6, n).astype(np.uint16)
    every = np.unique(dish)
    dish, train = np.concatenate([dish, every]), np.concatenate([np.ones(n), np.zeros(len(every))])
    context = np.concatenate([context, np.full(len(every), 3, np.uint16)])
    order = np.lexsort((context, dish))
    part = lm.Part((dish[order], context[order], np.arange(len(dish)), train[order].astype(np.uint8)), hot)
    first = lm.Sums(hot)
    start = lm.Sums(hot, sum(first.of(part, s) for s in part.states(first, 1, 1)), n, len(every))
    for state in part.states(start, 1, 2):
        sums = lm.Sums(hot, start.of(part, state), n, len(every))
        t2, c1, t1, c0, _ = state
        p0 = sums.root(c0)
        p1 = sums.serve(1, part.parents_context, c1, t1, p0[part.parents_word])
        p2 = sums.serve(2, part.context, part.customers, t2, p1[part.parent])
        unseen = sums.root(np.zeros(1))
        weight = (lm.STRENGTH[2] + lm.DISCOUNT[2] * sums.t2[3]) / (lm.STRENGTH[2] + sums.c2[3])
        weight *= (lm.STRENGTH[1] + lm.DISCOUNT[1] * sums.t1[0]) / (lm.STRENGTH[1] + sums.c1[0])
        assert abs(p2[part.context == 3].sum() + weight * unseen[0] - 1) < 1e-6
        assert (t2 <= part.customers).all() and (t2[part.customers > 0] > 0).all() and c1.sum() == t2.sum()


def test_two_previous_words_tell_the_next(docs_of):
    """Every pair of previous words has its own counts, also after a word that is a third of all tokens."""
    rnd = random.Random(5)
    texts = [" ".join(f"k{k} x v{7 * k % 600}" for k in rnd.choices(range(600), k=60)) for _ in range(300)]
    rows = lm.language_scores(docs_of(texts)).where("held_out").collect()
    known = sum(r.score for r in rows) / sum(r.n_tokens - 1 for r in rows) * 3  # of k, x and v together
    assert rows and known > -math.log10(600) - 0.7  # k is anyone's guess; v would be, too, were it not for k


def test_packing():
    for kind in (np.uint64, np.int64, np.uint16, np.uint8):
        for n in (0, 1, 1000):
            x = np.random.default_rng(n).integers(0, 200, n).astype(kind)
            assert (lm.unpack(lm.pack(x), kind) == x).all()


# --- pipeline -----------------------------------------------------------------

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = lm.written(stage(spark, docs, SF))
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(now) == len(set(now)) and ids > set(now), name
        ids = set(now)
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    assert not any(item in text for text in texts.values() for item, in items)
    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.tokenize(spark, docs, SF).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in texts.items()}
