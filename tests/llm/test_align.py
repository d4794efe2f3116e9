"""Alignment of tokenizers against a brute-force version."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mapframe.llm import align

TEXTS = ["", None, "a", "Hello, world", "  two  spaces \t\n\r\n", "café 漢字 \U0001f600 \x00", "x▁y <|endoftext|> <s> </s> <0x41>",
         "!!!!!!!!!! -----", " 　", "naïve " * 40, "same text", "same text"]


@pytest.fixture(scope="module")
def files():
    return [open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def brute(texts, files):
    """Straight from the definitions, with the public libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_str(files[0].decode())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    rows, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        a_bytes = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
                   for i in b]
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            rows.append(None)
            continue
        where = [[], []]
        for side, tokens in enumerate((a_bytes, b_bytes)):
            at = 0
            for t in tokens:
                where[side].append((at, at := at + len(t)))
        links = [(x, y) for x, (s, e) in zip(a, where[0]) for y, (u, v) in zip(b, where[1]) if s < v and u < e]
        groups, done = [], [0, 0]
        for end in sorted({e for _, e in where[0]} & {e for _, e in where[1]}):
            parts = []
            for side, ids in enumerate((a, b)):
                until = sum(e <= end for _, e in where[side])
                parts.append(",".join(map(str, ids[done[side]:until])))
                done[side] = until
            groups.append("|".join(parts))
        rows.append((len(a), len(b), len(groups), len(links), links, ";".join(groups)))
        counts.update(links)
    most = Counter()
    for (_, y), k in counts.items():
        most[y] = max(most[y], k)
    return [(0,) * 6 + ("",) if r is None else (*r[:4], sum(counts[x] == most[x[1]] for x in r[4]), sum(counts[x] for x in r[4]),
                                               hashlib.sha256(r[5].encode()).hexdigest()) for r in rows]


def found(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_brute_force(docs_of, files):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(" abcdeAZéß漢\n.,1") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += [" ".join(rng.choice(["the", "thing", "ouis", "école", "re-do"]) for _ in range(400)) for _ in range(4)]
    want = [(i, *row) for i, row in enumerate(brute(texts, files))]
    assert found(align.aligned(docs_of(texts), *files)) == sorted(want)


def test_small_slices_give_the_same(docs_of, files, monkeypatch):
    texts = TEXTS + [f"text number {i} of the corpus" for i in range(30)]
    monkeypatch.setattr(align, "SLICE", 64)
    assert found(align.aligned(docs_of(texts), *files)) == sorted((i, *row) for i, row in enumerate(brute(texts, files)))


def test_nulls_repeats_clashes_and_empty_tables(docs_of, files):
    rows = [(None, "some text here"), (7, "some text here"), (7, "some text here"), (8, None)]
    docs = docs_of(rows).selectExpr("*", "1 AS slice", "2 AS a", "3 AS b", "4 AS count", "5 AS n_a")
    got = align.aligned(docs, *files).collect()
    want = brute([t for _, t in rows], files)
    assert sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted(want)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 7), (False, 7), (False, 8), (True, 0)]
    assert align.aligned(docs.where("false"), *files).count() == 0
    assert [r.n_links for r in align.aligned(docs_of([None, ""]), *files).collect()] == [0, 0]


def test_very_long_text(docs_of, files):
    text = "The quick brown fox, jumping. " * 20_000
    row = align.aligned(docs_of([text]), *files).first()
    assert row.n_a > 100_000 and row.n_links >= max(row.n_a, row.n_b) and row.n_groups <= min(row.n_a, row.n_b)


def test_quick_encoding_is_that_of_the_json(files):
    """Texts of settled characters take another library; ids must be the same."""
    from tokenizers import Tokenizer

    slow, side, rng = Tokenizer.from_str(files[0].decode()), align.byte_level(files[0]), random.Random(5)
    signs = [chr(c) for c in range(32, 127)] + [chr(c) for c in range(0xC0, 0x100)] + list("  \n\n\t\r''")
    texts = [" " + "".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += [" don't they'll I'VE it's 's 're\n\n  x", " " * 50 + "\n" * 9 + "x", " 1234567890 ½²"]
    assert side.encode(texts) == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    assert all(align.SETTLED.fullmatch(t) for t in texts[:3000])


def test_tasks_grow_with_the_slices(docs_of, files, monkeypatch):
    """A task, and a file that is read at once, holds a bounded number of slices, whose rows are wide."""
    monkeypatch.setattr(align, "SLICE", 16)
    docs = docs_of([f"text number {i} of the corpus" for i in range(600)])
    slices, n = align.counted(align.aligned_slices(docs, lambda: (align.byte_level(files[0]), align.pieces(files[1]))), align.TOGETHER)
    assert n == 600 and max(r["count"] for r in slices.groupBy(F.input_file_name()).count().collect()) <= align.TOGETHER
    rows = align.aligned(docs, *files).select("doc_id", F.spark_partition_id().alias("task"))
    assert rows.groupBy("task").count().count() > 30 and rows.select("doc_id").distinct().count() == 600
