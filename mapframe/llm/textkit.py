"""Words of whole Arrow batches as numpy arrays: where they lie and a 64-bit hash of each.

Everything works on the UTF-8 bytes of a batch. A word is a longest run of bytes
that a 256-entry table does not mark as separators; A-Z count as a-z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes of text that are worked on at a time
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SPACE_PUNCT = SPACE.copy()
SPACE_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for base in (_BASE, _BACK):
            factors = np.full(size, base, _U)
            factors[0] = 1
            made.append(np.cumprod(factors, dtype=_U))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of some texts. Those of text i have the numbers first[i] up to first[i + 1]."""

    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without NULLs."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset: array.offset + len(array) + 1] \
        if offsets is not None and len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def spans(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes each; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    """Words of the texts that lie between the given offsets."""
    base, top = int(offsets[0]), int(offsets[-1])
    data, offsets = data[base:top], offsets - base
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), np.zeros(0, _U), none, none, data, offsets)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    forward, back = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((LOWER[data].astype(_U) + _U(1)) * forward[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * back[start] + (end - start).astype(_U))
    return Words(np.searchsorted(start, offsets), hashed, start, end, data, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, numbered by its first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.zeros(count, _U)
    for i in range(n):
        out *= _U(_BASE)
        out += hashes[i: i + count]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text, so that what is made of them stays small."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1, at + 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


def batches(batch: pa.RecordBatch, column: str, separators: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of ranges of a batch."""
    data, offsets = buffers(batch.column(column))
    for lo, hi in spans(offsets):
        yield lo, hi, words(data, offsets[lo: hi + 1], separators)


def released(run: Callable) -> Callable:
    """A task function that gives freed memory back when it ends: its worker stays for other tasks and would keep it."""
    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)
    return task
