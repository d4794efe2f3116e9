"""Quality, toxicity, secrets, licences and URLs."""

import base64
import hashlib
import json
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapframe.llm import common, licenses, quality, secrets, textkit, toxicity, urls

SF = "/root/testdata/sf0.01"


# --- words --------------------------------------------------------------------

def test_words_like_python():
    texts = ["", "One two", " \t\n", "ÄB\x0bc\x0cd\re", "a" * 5000, "x y", "x", "é é", "\xa0 z", "end "]
    data, offsets = textkit.buffers(pa.array(texts))
    seen = {}
    for lo, hi in textkit.spans(offsets):
        found = textkit.words(data, offsets[lo:hi + 1])
        for i in range(lo, hi):
            want = texts[i].encode().lower().split()
            got = found.hash[found.first[i - lo]:found.first[i - lo + 1]].tolist()
            assert len(got) == len(want)
            for word, h in zip(want, got):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = pa.array(["skip", None, "One two"]).slice(1)
    data, offsets = textkit.buffers(sliced)
    assert textkit.words(data, offsets).first.tolist() == [0, 0, 2]


# --- quality ----------------------------------------------------------------

def test_quality_keeps_good_rows(spark):
    docs, labels = (common.table(spark, SF, t) for t in ("documents", "labels"))
    got = {r.doc_id: r.kept for r in quality.resampled(docs.withColumn("sort_key", F.lit("clash")), labels).collect()}
    told = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([got[i] for i, q in told.items() if q == want] for want in (1, 0))
    assert len(got) == docs.count() and np.mean(good) > 0.99 and np.mean(bad) < 0.06


def test_quality_without_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality.resampled(docs_of(["a", None, ""]), labels).collect())
    assert quality.resampled(docs_of([]), labels).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 50, 100])
def test_cutoff(spark, k):
    keys = [random.Random(i // 2).random() ** 9 for i in range(100)]  # every key twice
    scores = spark.createDataFrame([(x,) for x in keys], "sort_key double")
    cut = quality.cutoff(scores, k)
    want = sorted(keys, reverse=True)[k - 1] if 0 < k < 100 else float("-inf") if k else float("inf")
    assert sum(x >= cut for x in keys) == sum(x >= want for x in keys)


# --- toxicity ---------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark, docs_of, as_dicts):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 7 == 0
        words = [f"w{rnd.randrange(300)}" for _ in range(30)] + ["Nasty!"] * toxic
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "nasty")]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = as_dicts(toxicity.scored(docs_of(rows).withColumn("toxic", F.lit(9)), labels))
    assert all(got[i]["predicted"] == t for i, t in marks)
    assert 100 < sum(got[i]["held_out"] for i, _ in marks) < 200
    assert got[1000]["score"] == got[1001]["score"] < 0.3 and got[None]["predicted"] == 1
    empty = toxicity.scored(docs_of(["a", None]), labels.limit(0)).collect()
    assert [r.score for r in empty] == [0.5, 0.5]


# --- secrets ----------------------------------------------------------------

def base_spans(text):
    found = []
    for kind, pattern, flags, group, least in (
            (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
            (1, "AKIA[A-Z0-9]+", 0, 0, 18), (2, "[0-9a-f]+", 0, 0, 16)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found)


def element(tag, content):
    size = len(content)
    return bytes([tag]) + (bytes([size]) if size < 128 else b"\x82" + size.to_bytes(2, "big")) + content


KEY = element(0x30, element(0x02, b"\0") + element(0x02, b"\x01" * 130) + element(0x02, b"\x01\0\x01"))


def test_pattern_spans_like_plain_search(docs_of, as_dicts):
    rnd = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "abc.def-123456", "AKIA", "Z9" * 9, "AKIA1", "0f" * 8,
             "deadbeef", " ", "é", "secret", "'", "\n", "😀", "ſecret=aaaaaaaaaaaaaa"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(300)] + [None, "", "a" * 100000]
    got = as_dicts(secrets.summary(secrets.secret_spans(docs_of(texts))))
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert set(filter(None, told.split(","))) <= set(got[i]["spans"].split(","))
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == counts

        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_headers_and_hex_of_either_case():
    key = element(0x30, element(2, b"\x00") + element(2, bytes(range(1, 100))))
    body = base64.b64encode(bytes(range(64))).decode()
    locked = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}\n" \
             "-----END RSA PRIVATE KEY-----"
    assert (0, "armour", len(locked)) in secrets.spans_of(locked)
    assert not any(k == "armour" for _, k, _ in secrets.spans_of(locked.replace("Proc-Type: 4,ENCRYPTED\n", "")))
    for text in (key.hex(), key.hex().upper()):
        assert (0, "key", len(text)) in secrets.spans_of(text)
        assert not any(k == "key" for _, k, _ in secrets.spans_of(text[:-2]))
    assert secrets.spans_of("-----BEGIN A-----" * 20000) == []


def test_structure_decides():
    flat = base64.b64encode(KEY).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2lnbmF0dXJl"
    assert secrets.spans_of(f"x {flat} y") == [(2, "key", 2 + len(flat))]
    assert secrets.spans_of(KEY.hex())[1][1] == "key"
    assert secrets.spans_of(token) == [(0, "signed", len(token))]
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{flat}\n-----END RSA PRIVATE KEY-----"
    assert ("armour", len(armour)) in [(k, e) for _, k, e in secrets.spans_of(armour)]
    broken = base64.b64encode(KEY[:-1]).decode()
    assert secrets.spans_of(broken) == [] and secrets.spans_of(f"{part({'x': 1})}.{part({})}.abcd") == []
    assert secrets.spans_of("eyJ" + "[" * 9) == []


# --- licences ---------------------------------------------------------------

def test_licences(docs_of):
    rows = ["Hello. Licensed under the Apache License, Version 2.0. Bye.", "Released under the MIT licence.\nFoo",
            "Licensed under the Apache License, Version 1.1.", "copyright is a long word in a text about other things",
            None, "", "This work is licensed under the GNU General Public License, version 3.\n" * 2]
    got = sorted((r.doc_id, r.license, r.missing, rows[r.doc_id][r.start:r.end]) for r in
                 licenses.notices(docs_of(rows).withColumn("license", F.lit("clash"))).collect())
    gpl = rows[6].split("\n")[0]
    assert [g[:2] for g in got] == [(0, "Apache-2.0"), (1, "MIT"), (6, "GPL-3.0"), (6, "GPL-3.0")]
    assert got[0][3] == "Licensed under the Apache License, Version 2.0." and got[1][2] == ["license"]
    assert [g[3] for g in got[2:]] == [gpl, gpl]


def wrapped(text, width):
    return "".join(f"# {line}\n" for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


def test_wrapped_licences_are_read_whole(docs_of):
    """Notices over many lines, with all words, and those that differ in one clause."""
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
           "License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any "
           "later version.")
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only",
             "Apache-2.0"]
    rows = [f"Foo.\n{gpl}\nint main() {{ return 1; }}\n"] + [
        f"# Copyright (c) 2020 Foo\n#\n{wrapped(licenses.TEMPLATES[name][-1], width)}import os\n" for name in names
        for width in (40, 76)]
    got = {}
    for r in licenses.notices(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.missing, r.added))
    assert got == {0: [("GPL-3.0-or-later", [], [])]} | {
        1 + 2 * i + j: [(name, [], [])] for i, name in enumerate(names) for j in (0, 1)}
    (row,) = [r for r in licenses.notices(docs_of(rows[:1])).collect()]
    assert rows[0][row.start:row.end] == gpl


def test_numbers_of_clauses_are_not_versions():
    assert licenses.words("met:\n# 1. Redistributions. 2. Others") == ["met", "redistributions", "others"]
    assert licenses.words("Version 2.0. See version\n3. Or v. 2. End") == ["version", "2.0", "see", "version", "3", "or", "v",
                                                                         "2", "end"]


# --- URLs -------------------------------------------------------------------

PAGES = [
    ("http://a.example.com/en/1?x=1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://WWW.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://b.www.example.com/en/x#y?z", "b.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
    ("http://x.net/frr", "x.net", "/frr", None, None), ("http://x.com", "x.com", "", None, None),
    ("http://x.com?a/b", "x.com", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None),
    ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("x://ÄB.com/é", "Äb.com", "/é", "com/", "allow")]


def test_urls(spark):
    df = spark.createDataFrame([(i, p[0], "<p>") for i, p in enumerate(PAGES)], "page_id long, url string, host string")
    result = urls.judged(df)
    got = {r.page_id: r for r in result.collect()}
    for i, (_, host, path, rule, verdict) in enumerate(PAGES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert not re.search("Python|Arrow|Pandas", result._jdf.queryExecution().toString())
    assert urls.judged(df.limit(0)).count() == 0


def test_trees_learn(spark):
    rows = [(i, f"u{i}", float(i % 10), float(i % 7), "s", int(i % 10 > 4) ^ int(i % 7 == 3)) for i in range(700)]
    names = ["page_id", "url", "url_length", "depth", "suffix", "blocked"]
    df = spark.createDataFrame(rows, names).select("*", *[F.lit(0.0).alias(f) for f in urls.FEATURES[:-1]
                                                          if f not in names])
    model = urls.fit(df)
    right = model.with_suffix(df).agg(F.avg(((model.margin() > 0).cast("int") == F.col("blocked")).cast("int"))).first()[0]
    assert right > 0.95
