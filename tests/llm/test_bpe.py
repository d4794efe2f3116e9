"""Encoding against the public library, and exact round trips."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mapframe.llm import bpe

RAW = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PIECES = ["a", "b", " ", "  ", "\n", "'", "s", "re", "ll", "1", "é", "中", ".", "!", "\x85", "\xa0", "\x1c", "\t", "A", "'ve",
          "the", " of", "😀", "̀", "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RAW, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.mark.parametrize("leaf,leaf_bytes", [(4, 3), (9, 5), (4096, 48)])
def test_random_texts(codec, library, monkeypatch, leaf, leaf_bytes):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf_bytes)
    monkeypatch.setattr(bpe, "WINDOW", 2)
    rnd = random.Random(leaf)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(60))) for _ in range(150)]
    for text in texts:
        assert codec.encode(text) == library.encode_ordinary(text), text
        assert codec.plain(codec.encode(text)) == text.encode("utf-8")


@pytest.mark.parametrize("text", ["a" * 9000, "xq1z" * 2000, "日本語" * 1500, " " * 9000, "ab \n" * 4000, "Straße, it's " * 3000])
def test_long_texts(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


def test_column_and_digests(spark, docs_of, as_dicts, library):
    texts = [(1, "Hello world, it's me"), (2, None), (3, ""), (4, "x" * 9000 + " y"), (4, "again"), (None, "no id")]
    df = docs_of(texts).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    tokens = bpe.tokenized(df, RAW, public_tokenizers.PATTERN)
    got = {(r.doc_id, bytes(r.decoded).decode()): list(r.ids) for r in tokens.collect()}
    assert got == {(i, t or ""): library.encode_ordinary(t or "") for i, t in texts}
    one = as_dicts(bpe.digests(tokens.where("doc_id = 1")))[1]
    ids = library.encode_ordinary(texts[0][1])
    assert one == {"doc_id": 1, "n_tokens": len(ids),
                   "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   "decoded_sha256": hashlib.sha256(texts[0][1].encode()).hexdigest()}
    assert bpe.tokenized(docs_of([]), RAW, public_tokenizers.PATTERN).count() == 0


def test_chunks_in_use_are_not_learned_again(monkeypatch):
    """A full cache forgets what no text has used lately, and nothing else."""
    monkeypatch.setattr(bpe, "CACHED", 200)
    codec = bpe.Codec(RAW, public_tokenizers.PATTERN)
    learned, learn = Counter(), codec.learn
    monkeypatch.setattr(codec, "learn", lambda chunks: (learned.update(chunks), learn(chunks)))
    want = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for turn in range(40):
        text = "".join(f" often{i}" for i in range(30)) + "".join(f" only{turn}x{i}" for i in range(40)) + " end"
        assert codec.encode(text) == want.encode_ordinary(text)
        assert len(codec.known) + len(codec.older) < 400
    assert max(learned.values()) == 1
