"""Byte-level BPE as a monoid over pieces of text.

A text is halved until it is short, the halves are encoded, and neighbours are
joined. A join encodes anew only a window around the seam. Two facts bound it:

* Splitting into pieces has no memory: the next match depends only on where it
  starts and on what follows. A space before a non-space always starts a match,
  whatever surrounds it. So tokens outside a window that lies between two such
  spaces stay.
* Inside one piece, a token sequence is the encoding of its bytes if every two
  neighbours are the encoding of theirs (a merge over a boundary would happen
  between these two alone as well). So tokens outside a window stay as soon as
  the window's encoding begins and ends with the tokens it began and ended with.

Windows grow until that holds. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import whole

LEAF_CHARS = 4096
LEAF_BYTES = 48
CACHED = 150_000  # chunks of text that a task remembers
FEW = 64  # pieces that are merged one by one
GROUP = 1 << 19  # characters that are encoded together
SLICE = 2 << 20  # bytes of text that a task hands on together
NONE = 1 << 30  # rank of a pair that is no token
WINDOW = 64  # characters on either side of a seam to begin with
GATHERED = 1 << 16  # tokens that are decoded at once
LOOSE = regex.compile(r" (?=\s|\Z)|\x00")
CUT = regex.compile(r" (?=\S)")


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """Encoder and decoder for one file of ranks. Token sequences are int32 arrays, kept as bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        spelled = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        self.flat, self.size = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(b) for b in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(spelled))]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(1 << 62))
        #: Tokens all of whose pairs rank behind them: equal merges may then be done at once.
        self.early = np.ones(max(self.ranks.values()) + 1, bool)
        for pair, rank in pairs.items():
            for part in (pair >> 32, pair & 0xFFFFFFFF):
                self.early[part] &= rank > part
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], np.int32(NONE))

    # --- bytes of one piece ---------------------------------------------------

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NONE))

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Merges of many short runs of bytes at a time: of each the lowest rank, leftmost first."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(tokens), NONE, np.int32)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self.pair_rank(tokens[inner], tokens[inner + 1])
        done_tokens, done_pieces = [], []
        while len(tokens):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            lengths = np.diff(starts, append=len(tokens))
            best = np.minimum.reduceat(rank, starts)
            if (best == NONE).any():
                finished = np.repeat(best == NONE, lengths)
                done_tokens.append(tokens[finished])
                done_pieces.append(piece[finished])
                tokens, piece, rank = tokens[~finished], piece[~finished], rank[~finished]
                lengths, best = lengths[best != NONE], best[best != NONE]
                if not len(tokens):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            fresh = np.diff(piece[at], prepend=-1) != 0
            run = np.diff(at, prepend=-2) != 1
            run |= fresh
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[fresh | (self.early[rank[at]] & (nth % 2 == 0))]
            tokens[at] = rank[at]
            stays = np.ones(len(tokens), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))
            tokens, piece, rank = tokens[stays], piece[stays], rank[stays]
            rank[at] = NONE
            changed = np.concatenate([at[at > 0] - 1, at[at < len(tokens) - 1]])
            changed = changed[piece[changed] == piece[changed + 1]]
            rank[changed] = self.pair_rank(tokens[changed], tokens[changed + 1])
        if not done_tokens:
            return [b""] * len(pieces)
        piece = np.concatenate(done_pieces)
        order = np.argsort(piece, kind="stable")
        flat = np.concatenate(done_tokens)[order].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(piece, minlength=len(pieces)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merged_one(self, piece: bytes) -> list[int]:
        """The same for one short run, without arrays."""
        get, ranks, bytes_of = self.ranks.get, self.ranks, self.bytes_of
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != NONE:
            at = pairs.index(best)
            parts[at] = bytes_of[best]
            del parts[at + 1], pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NONE)
        return [ranks[p] for p in parts]

    def tree(self, piece: bytes) -> list[int]:
        """A long piece: its leaves at once, then neighbours joined up the tree."""
        leaves = self.merged([piece[i:i + LEAF_BYTES] for i in range(0, len(piece), LEAF_BYTES)])
        parts = [np.frombuffer(leaf, np.int32).tolist() for leaf in leaves]
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encoded neighbours inside one piece."""
        reach = 1
        while True:
            a, b = left[-reach:], right[:reach]
            raw = self.plain(a + b)
            window = self.merged_one(raw) if len(raw) <= 4 * LEAF_BYTES else \
                np.frombuffer(self.merged([raw])[0], np.int32).tolist()
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[:len(left) - len(a)] + window + right[len(b):]
            reach *= 2

    # --- texts ------------------------------------------------------------------

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Tokens of matches of the pattern. One that is a token itself is never merged differently."""
        tokens: dict[str, bytes | None] = dict.fromkeys(pieces)
        todo, short = [], []
        get, spelled = self.ranks.get, self.id_bytes
        for piece in tokens:
            raw = piece.encode("utf-8")
            rank = get(raw)
            if rank is not None:
                tokens[piece] = spelled[rank]
            elif len(raw) <= LEAF_BYTES:
                todo.append(raw)
                short.append(piece)
            else:
                tokens[piece] = np.array(self.tree(raw), np.int32).tobytes()
        if len(todo) > FEW:
            tokens.update(zip(short, self.merged(todo)))
        else:
            tokens.update((piece, np.array(self.merged_one(raw), np.int32).tobytes()) for piece, raw in zip(short, todo))
        return [tokens[piece] for piece in pieces]

    def learn(self, chunks: list[str]) -> None:
        """Tokens of texts that stand between sure cuts."""
        pieces, counts = [], []
        for chunk in chunks:
            found = self.pattern.findall(chunk)
            pieces += found
            counts.append(len(found))
        tokens = self.encode_pieces(pieces)
        at = 0
        for chunk, count in zip(chunks, counts):
            self.known[chunk] = tokens[at] if count == 1 else b"".join(tokens[at:at + count])
            at += count

    def cut(self, text: str) -> list[str]:
        """Parts of a leaf between sure cuts. If spaces stand in a row or at the end, single matches."""
        if LOOSE.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").lstrip("\0").split("\0") if text else []

    def encode_many(self, texts: list[str]) -> list[bytes]:
        leaves = [[self.cut(text[lo:hi]) for lo, hi in self.leaves(0, len(text))] for text in texts]
        wanted = set().union(*(parts for leaf in leaves for parts in leaf))
        if len(self.known) > CACHED // 2:  # what no text has used since the last time is forgotten
            self.known, self.older = {}, self.known
        missing = wanted - self.known.keys()
        again = missing & self.older.keys()
        for chunk in again:
            self.known[chunk] = self.older.pop(chunk)
        self.learn(list(missing - again))
        get = self.known.__getitem__
        return [self.halves(text, 0, len(text), iter([b"".join(map(get, parts)) for parts in leaf]))
                for text, leaf in zip(texts, leaves)]

    def encode_groups(self, texts: list[str]) -> list[bytes]:
        """The same for any number of texts, about GROUP characters at a time."""
        tokens: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP:
                tokens += self.encode_many(group)
                group, size = [], 0
        return tokens + self.encode_many(group)

    def leaves(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        if hi - lo <= LEAF_CHARS:
            yield lo, hi
        else:
            mid = (lo + hi) // 2
            yield from self.leaves(lo, mid)
            yield from self.leaves(mid, hi)

    def halves(self, text: str, lo: int, hi: int, leaves: Iterator[bytes]) -> bytes:
        if hi - lo <= LEAF_CHARS:
            return next(leaves)
        mid = (lo + hi) // 2
        left = self.halves(text, lo, mid, leaves)
        return self.join_texts(text, lo, mid, hi, left, self.halves(text, mid, hi, leaves))

    def join_texts(self, text: str, lo: int, mid: int, hi: int, left: bytes, right: bytes) -> bytes:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        reach, start = WINDOW, lo
        while mid - reach > lo:  # the last sure cut of the left half
            cuts = [m.start() for m in CUT.finditer(text, mid - reach, mid)]
            if cuts:
                start = cuts[-1]
                break
            reach *= 2
        found = CUT.search(text, mid, hi)
        end = found.start() if found else hi
        if (start, end) == (lo, hi) and all(self.one(text, *part) for part in ((lo, hi), (lo, mid), (mid, hi))):
            ids = self.join(*(np.frombuffer(side, np.int32).tolist() for side in (left, right)))
            return np.array(ids, np.int32).tobytes()
        window = b"".join(self.encode_pieces(self.pattern.findall(text[start:end])))
        left_size, right_size = (len(part.encode("utf-8")) for part in (text[start:mid], text[mid:end]))
        return left[:self.split(left, left_size, True)] + window + right[self.split(right, right_size, False):]

    def one(self, text: str, lo: int, hi: int) -> bool:
        """Is this stretch a single match?"""
        m = self.pattern.match(text, lo, hi)
        return m is not None and m.end() == hi

    def split(self, tokens: bytes, size: int, from_end: bool) -> int:
        """Where the last (or first) ``size`` bytes of text begin (or end) in a token sequence."""
        ids = np.frombuffer(tokens, np.int32)
        at = 0
        while size:
            size -= len(self.bytes_of[int(ids[len(ids) - 1 - at] if from_end else ids[at])])
            at += 1
        return 4 * (len(ids) - at if from_end else at)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()

    def plain(self, ids: list[int]) -> bytes:
        """Bytes of tokens, concatenated up the tree."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.plain(ids[:half]) + self.plain(ids[half:])

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The same for many tokens: leaves are gathered from the table of bytes, then concatenated up the tree."""
        if len(ids) <= GATHERED:
            size = self.size[ids]
            ends = np.cumsum(size)
            return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(int(size.sum()))]
        half = len(ids) // 2
        return np.concatenate([self.spelled(ids[:half]), self.spelled(ids[half:])])

    def decoded(self, tokens: list[bytes]) -> pa.Array:
        """Texts of token sequences."""
        ids = np.frombuffer(b"".join(tokens), np.int32)
        ends = np.append(0, np.cumsum(self.size[ids]))[np.cumsum([0, *map(len, tokens)]) // 4]
        return pa.Array.from_buffers(pa.binary(), len(tokens),
                                     [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.spelled(ids))])


def listed(tokens: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, tokens)]) // 4
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(tokens))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(column: str | Column, ranks: bytes, pattern: str) -> Column:
    """Token ids (array of int) of a text column; NULL counts as empty, an empty text has no ids.

    Special tokens are ordinary text. Texts of any length are whole rows of one task.
    """
    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(ranks, pattern)
        for array in texts:
            yield listed(codec.encode_groups(array.fill_null("").to_pylist()))

    return run(column)


def decode(column: str | Column, ranks: bytes, pattern: str) -> Column:
    """Bytes (binary) of a column of token ids; NULL counts as no ids. An unknown id is an error."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(ranks, pattern)
        for array in batches:
            yield pa.array([codec.plain(ids.values.to_numpy().tolist()) if ids.is_valid else b"" for ids in array],
                           pa.binary())

    return run(column)


def tokenized(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, text, ...); other columns are not carried along.

    Both directions in one pass over slices of a batch: what a task holds besides its input is some megabytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here refers to itself, and the cache would make every collection long
        try:
            codec = Codec(ranks, pattern)
            for batch in (part for batch in batches for part in textkit.slices(batch, "text", SLICE)):
                tokens = codec.encode_groups(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), listed(tokens), codec.decoded(tokens)], ["doc_id", "ids", "decoded"])
        finally:
            gc.enable()

    return whole(docs).mapInArrow(textkit.released(run), "doc_id long, ids array<int>, decoded binary")


def digests(tokens: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a tokenized table, and more of its columns."""
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), *more)
