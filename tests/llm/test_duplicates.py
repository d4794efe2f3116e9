"""Exact and similar copies against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mapframe.llm import exact, jaccard
from mapframe.llm.components import components, connected


def exact_brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", text or ""), []).append((i, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out)


def test_exact_groups(docs_of):
    rows = [(5, "a b"), (1, "ab "), (2, "a  b "), (3, None), (4, ""), (6, " \t"), (7, "\xa0"), (8, "é" * 3000), (9, "é" * 3000)]
    df = docs_of(rows).withColumn("hash", F.lit(1)).withColumn("norm", F.lit("x"))
    got = exact.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == exact_brute(rows)
    assert sorted(r.doc_id for r in exact.drop_copies(df).collect()) == [2, 6, 7, 8]
    assert exact.drop_copies(df).columns == df.columns
    assert exact.exact_groups(docs_of([])).count() == 0


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def classes_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed, n, quote):
    """Edited copies of a few texts, chains of edits, and texts that share a long passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    bases, passage, rows = [make(rnd.choice([6, 9, 20, 64, 130])) for _ in range(6)], make(30), []
    for i in range(n):
        words = list(rnd.choice(bases)) if rnd.random() < 0.6 else make(rnd.randrange(1, 40))
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < quote:
            words = words[:rnd.randrange(1, 12)] + passage
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.3:
            bases[rnd.randrange(len(bases))] = words
    return rows


def test_similarity_classes(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    rows = corpus(2, 150, 0.4) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"),
                                     (1005, "word " * 5000), (1006, "word " * 6000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs_of(rows)).collect()}
    assert got == classes_brute(rows)


def test_odd_rows(docs_of):
    text = "one two three four five six seven"
    df = docs_of([(7, text), (3, text), (3, text), (None, text), (9, None)]).withColumn("label", F.lit(1))
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.similarity_classes(df).collect())
    assert got == [(-1, -1), (3, 3), (3, 3), (7, 3), (9, 9)]
    kept = jaccard.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 3, 9]
    assert jaccard.similarity_classes(docs_of([])).count() == 0


def test_similar_sets_share_a_signature():
    """The promise of the enumeration, on random pairs just inside the threshold."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        common = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
        extra = int(rng.integers(0, n // 3 + 1))
        split = int(rng.integers(0, extra + 1))
        other = rng.integers(0, 2 ** 63, extra, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, part])) for part in (other[:split], other[split:]))
        assert 100 * n >= 75 * (n + extra)
        both = set(np.concatenate(jaccard.signatures_of(a)).tolist()) & set(np.concatenate(jaccard.signatures_of(b)).tolist())
        assert both, (n, extra, split)


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 9), (7, 7), (20, 10), (20, 30), (30, 40), (40, 50), (50, 60)]
    got = {r.doc_id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 20: 10, 30: 10, 40: 10, 50: 10, 60: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_overrate_the_difference():
    rng = np.random.default_rng(6)
    for n, extra in ((5, 3), (900, 400), (1000, 100), (3000, 1200), (200000, 30)):
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[extra // 2:], rng.integers(0, 2 ** 63, extra, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        got = jaccard.apart(*(pa.array([jaccard.sketch(x)] * 2, pa.binary()) for x in (a, b)))
        assert (got <= differ).all() and (n > 100000 or (got >= 0.3 * differ).all())


def test_members_that_met_only_the_first_of_their_slice(spark, docs_of):
    """Doc 140 shares partitions with so many of its slice that it meets those there, and they alone meet 5."""
    passage, own = [f"p{i}" for i in range(88)], lambda i, k: [f"o{i}x{j}" for j in range(k)]
    first = [(5, " ".join(passage + own(5, 12)))] + [(i, " ".join(own(i, 9))) for i in range(200, 240)]
    second = [(i, " ".join(passage + own(i, 40))) for i in range(100, 140)] + [(140, " ".join(passage + own(140, 12)))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(first + second, 2), docs_of([]).schema)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()}
    assert got == classes_brute(first + second)
    assert got[140][1] == 5


def test_members_of_common_buckets_whose_first_is_left_out(docs_of, monkeypatch):
    """All shingles of two texts are common, and of each bucket only these two are followed up."""
    monkeypatch.setattr(jaccard, "HOT", 4)
    rnd = random.Random(1)

    def sets(words):
        return next(jaccard.shingle_sets(pa.RecordBatch.from_pydict({"text": [" ".join(words)]})))[1]

    def shape(words):
        return len(jaccard.partitions(sets(words), 2)[0])

    def make(k):
        return [f"w{rnd.randrange(10 ** 9)}" for _ in range(k)]

    while True:
        x = make(11)
        y = x[:10] + make(1)
        if shape(x) == shape(y) == 2 and not np.isin(*(jaccard.signatures_of(sets(t))[0] for t in (x, y))).any():
            break
    rows = [(9000, " ".join(x)), (9001, " ".join(y))]
    for run in range(6):
        while len(rows) < 2 + 6 * (run + 1):
            quote = make(3) + x[run:run + 5] + make(3)
            if shape(quote) <= 2:
                rows.append((len(rows), " ".join(quote)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs_of(rows).coalesce(1)).collect()}
    assert got == classes_brute(rows)
    assert got[9001][1] == 9000


def test_variants_of_one_text_meet_by_what_they_lack(docs_of, monkeypatch):
    """Many variants of a text that are not similar to each other are not compared in all pairs."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rnd.sample(range(150), 4 if i < 120 else 2):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    for i in range(0, 120, 10):  # one word behind a similar variant
        rows.append((500 + i, rows[i][1] + f" more{i}"))
    sets = {i: {tuple(text.split()[j:j + 5]) for j in range(len(text.split()) - 4)} for i, text in rows}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    monkeypatch.setattr(jaccard, "HOT", 4)
    compared, close_enough = [], jaccard.close_enough
    monkeypatch.setattr(jaccard, "close_enough", lambda pairs, known: (compared.append(pairs.count()), close_enough(pairs, known))[1])
    found = jaccard.similarity_classes(docs_of(rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == label
    assert len(set(label.values())) > 100 and sum(compared[1:]) < 4000, compared


def test_new_links_join_classes_in_few_tasks(spark):
    """Labels brought up to date are those of all links, and a short table is not written as one file for each partition."""
    rnd = random.Random(3)
    old = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(150)] + [(900 + i, 901 + i) for i in range(20)]
    new = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(60)] + [(5, 910), (700, 701), (3, 950)]
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        labels = components(frame(old))
        want = {r.doc_id: r.label for r in components(frame(old + new)).collect()}
        assert len(labels.inputFiles()) <= 8
        got = connected(labels, frame(new), len(new)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert len(got) == len({r.doc_id for r in got}) and {r.doc_id: r.label for r in got} == want


def test_lists_of_what_tells_sets_apart(docs_of):
    """Same lists as by hand, without a row for every shingle that any set lacks."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):
        words = list(base)
        for at in rnd.sample(range(60), rnd.choice([1, 2, 5])):
            words[at] = f"v{rnd.randrange(3)}x{at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"u{i}y{j}" for j in range(58)) for i in range(6)]
    docs = docs_of(list(enumerate(texts)))
    found = jaccard.rarest_shingles(docs, docs.select("doc_id"))
    assert "LeftAnti" not in found._jdf.queryExecution().toString()
    sets = [next(jaccard.shingle_sets(pa.RecordBatch.from_pydict({"text": [t]})))[1].view(np.int64).tolist() for t in texts]
    want = []
    home = [math.floor(math.log(len(s)) / math.log(4 / 3)) for s in sets]
    for kind in {k - below for k in home for below in (0, 1)}:
        inside = [i for i, k in enumerate(home) if kind in (k, k - 1)]
        often = Counter(s for i in inside for s in sets[i])
        usual = {s for s, n in often.items() if n > 1 and 2 * n > len(inside)}
        for i in inside:
            n = len(sets[i])
            told = sorted([(often[s], s) for s in set(sets[i]) - usual] + [(len(inside) - often[s], s) for s in usual - set(sets[i])])
            want += [(i, own, n, 6 * own <= n) for own, (times, _) in enumerate(told) if times > 1 and 3 * own <= n]
            want += [(i, len(told), n, 6 * len(told) <= n)] * (3 * len(told) <= n)
    assert sorted((r.doc_id, r.own, r.n, r.leads) for r in found.collect()) == sorted(want)
