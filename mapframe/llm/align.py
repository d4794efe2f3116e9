"""Alignment of two tokenizers: which tokens of a text overlap, and which pairs of ids go together in the corpus.

Tokens are intervals of the bytes of space + text. For the tokens of a batch, ``merge_asof`` finds the token of the other
side that covers each start, keyed by document; both directions together are all overlaps. Pairs of ids are counted once
per slice of a batch, so that a pair which every text has is one row a slice, and the corpus-wide counts come back to the
slices in one join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import counted, whole, written

SLICE = 1 << 20  # bytes of text that are aligned and counted together; a longer text is a slice of its own
TOGETHER = 16  # slices in a file and, about, in a task that sums: their rows are wide, and batches are bounded by rows alone


SAFE = np.zeros(256, bool)  # printable ASCII but the space: neither side has a token from such a byte into a space
SAFE[0x21:0x7F] = True
#: How byte-level BPE splits a text before it merges, and characters about which all versions of Unicode agree.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = re.compile("[\t\n\r -~À-ÿ]*")
JOINED = 1 << 13  # bytes of distinct chunks that are tokenized in one go, about


@dataclass
class Side:
    """A tokenizer: ids of texts that begin with a space, and the bytes of each id laid end to end.

    ``cuttable``: the text may be cut before a space that follows a printable character; no token, and no rule of the
    tokenizer, reaches over such a place.
    """

    encode: Callable[[list[str]], list[list[int]]]
    cuttable: bool
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, encode, cuttable: bool, tokens: list[bytes]) -> Side:
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(encode, cuttable, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts end to end, and how many each has."""
        lists = self.encode(texts)
        count = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count

    def chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each chunk has, whether their bytes are the chunk's).

        Chunks that end as they are cut are joined; the rest, and what does not come out byte by byte, goes one by one.
        """
        data, offsets = textkit.buffers(chunks)
        n, size = len(chunks), np.diff(offsets)
        last, before = data[offsets[1:] - 1], data[np.maximum(offsets[1:] - 2, 0)]
        joined = np.flatnonzero(SAFE[last] | (last >= 0x80) & (before == 0xC3) & (size > 1)) if self.cuttable \
            else np.zeros(0, np.int64)
        number = np.cumsum(size[joined]) // JOINED
        groups = np.split(joined, np.flatnonzero(np.diff(number)) + 1) if len(joined) else []
        texts = [data[np.repeat(offsets[g] - np.cumsum(size[g]) + size[g], size[g]) + np.arange(int(size[g].sum()))].tobytes().decode()
                 for g in groups]
        count, right, parts, alone = np.zeros(n, np.int64), np.ones(n, bool), [], [np.setdiff1d(np.arange(n), joined)]
        order = []
        if groups:
            ids, each = self.encoded(texts)
            for g, found in zip(groups, np.split(ids, np.cumsum(each)[:-1])):
                token_ends, chunk_ends = np.cumsum(self.size[found]), np.cumsum(size[g])
                at = np.searchsorted(token_ends, chunk_ends)
                if len(token_ends) and token_ends[-1] == chunk_ends[-1] and (token_ends[at] == chunk_ends).all() and (
                        self.bytes_of(found) == data[np.repeat(offsets[g] - chunk_ends + size[g], size[g])
                                                     + np.arange(chunk_ends[-1])]).all():
                    count[g] = np.diff(at, prepend=-1)
                    parts.append(found)
                    order.append(g)
                else:
                    alone.append(g)
        alone = np.concatenate(alone)
        if len(alone):
            ids, each = self.encoded(chunks.take(pa.array(alone)).to_pylist())
            count[alone] = each
            for i, found in zip(alone.tolist(), np.split(ids, np.cumsum(each)[:-1])):
                right[i] = self.bytes_of(found).tobytes() == data[offsets[i]:offsets[i + 1]].tobytes()
            parts.append(ids)
            order.append(alone)
        ids, order = np.concatenate(parts), np.concatenate(order)
        moved = np.empty(n, np.int64)
        given = np.cumsum(count[order]) - count[order]
        moved[order] = given
        ends = np.cumsum(count)
        return ids[np.repeat(moved - ends + count, count) + np.arange(int(count.sum()))], count, right


def tokens(sides: tuple[Side, ...], raw: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each side (ids, how many each text has, whether their bytes are the text's); texts begin at ``begins``.

    Words repeat, so texts are cut into chunks and each distinct chunk is tokenized once.
    """
    edge = np.zeros(len(raw) + 1, bool)
    edge[begins] = edge[-1] = True
    if all(side.cuttable for side in sides):
        latin = np.append(False, (raw[:-1] == 0xC3) & (raw[1:] >= 0x80))  # second byte of a letter of Latin-1
        edge[1:-1] |= (raw[1:] == 0x20) & (SAFE[raw[:-1]] | latin[:-1]) & ~edge[2:]  # a space that ends a text stays
    cuts = np.flatnonzero(edge)
    chunks = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
    coded = chunks.dictionary_encode()
    which, of_text, out = coded.indices.to_numpy(), np.searchsorted(cuts, begins), []
    for side in sides:
        ids, count, right = side.chunks(coded.dictionary)
        first, size = np.cumsum(count) - count, count[which]
        ends = np.cumsum(size)
        spread = ids[np.repeat(first[which] - ends + size, size) + np.arange(int(size.sum()))]
        out.append((spread, np.add.reduceat(size, of_text), np.logical_and.reduceat(right[which], of_text)))
    return out


def byte_level(code: bytes) -> Side:
    """From the JSON of a byte-level BPE; special tokens in a text are plain text.

    If ids are ranks (each merge makes the next id), texts of settled characters are encoded by the faster of two
    public libraries, which then gives the same ids (tested); all others by the one that reads the JSON.
    """
    import tiktoken
    from tokenizers import Tokenizer

    # Byte-level vocabularies write a byte that is printable in Latin-1 as itself, the others as U+0100 and up.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    said = json.loads(code)
    vocabulary, special = said["model"]["vocab"], {t["content"] for t in said.get("added_tokens") or []}
    tokens = [b""] * (max([*vocabulary.values(), *(t["id"] for t in said.get("added_tokens") or [])], default=-1) + 1)
    for token, number in vocabulary.items():
        if token not in special:
            tokens[number] = bytes(byte[c] for c in token)
    split = said.get("pre_tokenizer") or {}
    cuttable = said.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) \
        and not split.get("add_prefix_space")
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in said["model"]["merges"]]
    ranked = [vocabulary[m] for m in merged]
    quick, slow = None, []
    if cuttable and ranked == sorted(set(ranked)) and len(vocabulary) - len(special & set(vocabulary)) == len(ranked) + 256:
        ranks = {tokens[n]: n for t, n in vocabulary.items() if t not in special}
        quick = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        found = [quick.encode_ordinary(t) if quick and SETTLED.fullmatch(t) else None for t in texts]
        rest = [i for i, ids in enumerate(found) if ids is None]
        if rest:
            if not slow:
                slow.append(Tokenizer.from_str(code.decode()))
                slow[0].encode_special_tokens = True
            for i, e in zip(rest, slow[0].encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                found[i] = e.ids
        return found

    return Side.of(encode, cuttable, tokens)


def pieces(code: bytes) -> Side:
    """From a sentencepiece model, which puts the space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=code)
    tokens, cuttable = [], model.normalize("x \ufb01  y ") == "▁x▁\ufb01▁▁y▁"
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode())
        cuttable &= "▁" not in piece.lstrip("▁")
    return Side.of(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), cuttable, tokens)


def overlaps(a_at: np.ndarray, a_doc: np.ndarray, b_at: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of A tokens, numbers of B tokens) of all pairs that share a byte, from where tokens begin.

    Both sides cover the same bytes of each document without gaps. A pair shares a byte exactly if one token begins
    within the other; pairs that begin together are left to the first direction.
    """
    a = pd.DataFrame({"at": a_at, "doc": a_doc, "a": np.arange(len(a_at))})
    b = pd.DataFrame({"at": b_at, "doc": b_doc, "b": np.arange(len(b_at))})
    covering_b = pd.merge_asof(a, b, on="at", by="doc")
    covering_a = pd.merge_asof(b, a, on="at", by="doc", allow_exact_matches=False).dropna(subset="a")
    into = covering_a["a"].to_numpy().astype(np.int64)
    after = into + 1  # where the A token before this start ends: at the next A token of the document, if there is one
    more = after < len(a_at)
    nearest = np.where(more, after, 0)
    inside = ~(more & (a_doc[nearest] == covering_a["doc"].to_numpy()) & (a_at[nearest] <= covering_a["at"].to_numpy()))
    first = (covering_b["a"].to_numpy(), covering_b["b"].to_numpy().astype(np.int64))
    second = (into[inside], covering_a["b"].to_numpy()[inside])
    return tuple(np.concatenate(x) for x in zip(first, second))


def _written_out(ids: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with its separator (0: none), as bytes, and the bytes of each."""
    top = int(ids.max(initial=0))
    width = len(str(top))
    place, every = 10 ** np.arange(width - 1, -1, -1), np.arange(top + 1)[:, None]
    digits = np.zeros((top + 1, width + 1), np.uint8)
    digits[:, :width] = every // place % 10 + 48
    known = np.ones(digits.shape, bool)
    known[:, :width - 1] = every >= place[:-1]
    cells, shown = digits[ids], known[ids]
    cells[:, width] = separators
    shown[:, width] = separators > 0
    return cells[shown], shown.sum(1)


def group_digests(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, group_doc: np.ndarray,
                  n_docs: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document's groups; '' for documents without."""
    n_a, n_b = np.bincount(a_group, minlength=len(group_doc)), np.bincount(b_group, minlength=len(group_doc))
    b_before, a_until = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    at_a, at_b = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_until[b_group]
    ids[at_a], ids[at_b] = a, b
    last_a, last_b = a_until + b_before - 1, a_until + b_before + n_b - 1
    signs[last_a], signs[last_b] = ord("|"), ord(";")
    last_of_doc = np.append(group_doc[1:] != group_doc[:-1], True) if len(group_doc) else np.zeros(0, bool)
    signs[last_b[last_of_doc]] = 0
    out, size = _written_out(ids, signs)
    ends = np.cumsum(size)
    digests, begin = [""] * n_docs, 0
    for doc, end in zip(group_doc[last_of_doc].tolist(), ends[last_b[last_of_doc]].tolist()):
        digests[doc] = hashlib.sha256(out[begin:end].data).hexdigest()
        begin = end
    return digests


def align(texts: list[str], sides: tuple[Side, Side]) -> dict:
    """Counts and digests of each text, and the distinct pairs of ids with how often each text links them."""
    n = len(texts)
    raw = [(" " + t).encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    raw = np.frombuffer(b"".join(raw), np.uint8)
    good, sided = size > 1, tokens(sides, raw, np.cumsum(size) - size)
    for _, _, right in sided:
        good &= right
    found = []
    for side, (ids, count, _) in zip(sides, sided):
        kept = np.repeat(good, count)
        ids, doc = ids[kept], np.repeat(np.arange(n), count)[kept]
        size = side.size[ids]
        end = np.cumsum(size)
        found.append((ids, doc, end - size, end))
    (a, a_doc, a_at, a_end), (b, b_doc, b_at, b_end) = found
    left, right = overlaps(a_at, a_doc, b_at, b_doc)
    in_a, in_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    in_a[a_end], in_b[b_end] = True, True
    a_last, b_last = in_b[a_end], in_a[b_end]  # tokens that end a group
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    group_doc = a_doc[a_last]
    pairs, which, times = np.unique((b[right] << 32) | a[left], return_inverse=True, return_counts=True)
    in_doc, n_in_doc = np.unique(a_doc[left] * max(1, len(pairs)) + which, return_counts=True)
    doc, pair = in_doc // max(1, len(pairs)), in_doc % max(1, len(pairs))
    return {"n_a": np.bincount(a_doc, minlength=n), "n_b": np.bincount(b_doc, minlength=n),
            "n_groups": np.bincount(group_doc, minlength=n), "n_links": np.bincount(a_doc[left], minlength=n),
            "groups_sha256": group_digests(a, a_group, b, b_group, group_doc, n),
            "a": pairs & 0xFFFFFFFF, "b": pairs >> 32, "times": times,
            "pair": pair, "n_pair": n_in_doc, "pairs_of": np.bincount(doc, minlength=n)}


DOC = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
LISTS = "a array<int>, b array<int>, times array<int>, pair array<int>, n_pair array<int>, pairs_of array<int>"


def aligned_slices(docs: DataFrame, sides: Callable[[], tuple[Side, Side]]) -> DataFrame:
    """One row for each slice of a batch: the fields of ``align`` as arrays, with the ids of its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in textkit.slices(batch, "text", SLICE):
                found = align(part.column("text").to_pylist(), both)
                row = {"slice": [number], "doc_id": [part.column("doc_id").to_pylist()]}
                for name, values in found.items():
                    kind = pa.string() if name == "groups_sha256" else pa.int64() if name.startswith("n_") and \
                        name != "n_pair" else pa.int32()
                    row[name] = pa.array([values], pa.list_(kind))
                row["doc_id"] = pa.array(row["doc_id"], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(row)
                number += 1

    rows = whole(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(textkit.released(run), f"slice long, {DOC}, {LISTS}")


def pair_counts(slices: DataFrame) -> DataFrame:
    """(a, b, count, best): links of every pair of ids in the corpus; best if no other pair of its B id has more.

    A B id has at most as many pairs as A has ids, and there are as many maxima as B has ids, so they fit any task.
    """
    counts = written(slices.select(F.explode(F.arrays_zip("a", "b", "times")).alias("p"))
                     .groupBy("p.a", "p.b").agg(F.sum("p.times").alias("count")))
    most = counts.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.col("b") == F.col("_b")).select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def summed(slices: DataFrame, counts: DataFrame, n_slices: int) -> DataFrame:
    """One row per document: its numbers, n_best and count_sum. Tasks are as many as slices ask for, so none grows."""
    tasks = max(8, -(-n_slices // TOGETHER))
    own = slices.select("slice", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p"))
    own = own.select("slice", "at", F.col("p.a").alias("pa"), F.col("p.b").alias("pb"))
    told = (own.join(counts, (F.col("pa") == F.col("a")) & (F.col("pb") == F.col("b")))
            .select(F.col("slice").alias("_slice"), "at", "count", "best").repartition(tasks, "_slice").groupBy("_slice")
            .agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("told")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = (slices.select("slice", *names, "pair", "n_pair", "pairs_of").repartition(tasks, "slice")
            .join(told, F.col("slice") == F.col("_slice"), "left")
            .select(*names, "pair", "n_pair", "pairs_of", F.col("told.count").alias("count"), F.col("told.best").alias("best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i].values for name in batch.schema.names}
                n = len(cell["doc_id"])
                doc = np.repeat(np.arange(n), cell["pairs_of"].to_numpy())
                pair, times = cell["pair"].to_numpy(), cell["n_pair"].to_numpy().astype(np.int64)
                if cell["count"] is None:
                    times_count = times_best = times
                else:
                    times_count = times * cell["count"].to_numpy()[pair]
                    times_best = times * cell["best"].to_numpy(zero_copy_only=False)[pair]
                out = {name: cell[name] for name in names}
                for name, values in (("n_best", times_best), ("count_sum", times_count)):
                    total = np.zeros(n, np.int64)
                    np.add.at(total, doc, values)
                    out[name] = pa.array(total)
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(textkit.released(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "n_best long, count_sum long")


def aligned(docs: DataFrame, byte_level_json: bytes, piece_model: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of (doc_id, text, ...).

    A is a byte-level BPE (its JSON), B a sentencepiece model; both read space + text without special tokens. Bytes
    between common ends form a group. n_best: links whose pair is the most frequent of its B id (ties included);
    count_sum: over links, how often the corpus links that pair of ids. NULL and empty texts, and texts that one
    side does not give back byte by byte, have no tokens: zeros and ''. Repeated rows count as often as they come and
    each has its row; a NULL doc_id stays NULL. Other columns are not read. A text is tokenized whole, in the memory of
    one task. No rows give no rows.
    """
    slices, n = counted(aligned_slices(docs, lambda: (byte_level(byte_level_json), pieces(piece_model))), TOGETHER)
    return summed(slices, pair_counts(slices), n).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
