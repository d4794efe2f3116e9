"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from mapframe.llm import variants


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        top = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (top if top and n[top] >= 2 * n[w] else None, len(others))
    rows = {}
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n[w], n_near, n[form] if form else None)
    return rows


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def corpus(seed, letters, texts=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(80)]
    words += [w[:i] + w[i + 1:] for w in words for i in range(0, len(w), 2)] + ["aaaaa", "aaaaaa", "aaaaaaa", "étéééé"]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=150)).title()) for i in range(texts)]


@pytest.mark.parametrize("seed,letters", [(0, "ab"), (1, "abcéü"), (2, "abcdefghij")])
def test_brute_force(docs_of, seed, letters):
    rows = corpus(seed, letters)
    assert found(variants.variants(docs_of(rows))) == brute(rows)


def test_crowded_halves_are_cut_into_cells(docs_of, monkeypatch):
    """With tiny cells nearly every half is hot, and pairs of parts must meet all the same."""
    monkeypatch.setattr(variants, "CELL", 60)
    rows = corpus(3, "ab", 30)
    got = variants.variants(docs_of(rows))
    assert found(got) == brute(rows)


def test_edge_cases(spark, docs_of):
    long = "x" * 3000
    rows = [(None, "Hello hello HELLO hello"), (1, "hallo hallo"), (1, "hallo hallo"), (2, None), (3, ""), (4, "École école école école"),
            (5, f"{long} {long} {long}y {long}y {long}y {long} 12 !! {long}"), (6, "×÷×÷× " * 3)]
    assert found(variants.variants(docs_of(rows))) == brute(rows)
    assert variants.variants(docs_of(rows).where("false")).count() == 0
    assert variants.variants(docs_of([(1, "rare words only")])).count() == 0


def test_extra_columns_with_clashing_names(spark, docs_of):
    rows = corpus(4, "abc", 10)
    docs = docs_of(rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS _word", "4 AS cell", "5 AS run")
    assert found(variants.variants(docs)) == brute(rows)


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)]
    forms = spark.createDataFrame(chain, "word string, form string")
    got = {r.word: r.root for r in variants.roots(forms.where("form IS NOT NULL")).collect()}
    assert got == {f"w{i}": "w40" for i in range(40)}
