"""Secret scans: patterns find candidates, and encoded ones count only if their structure holds."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{28,}={0,2}")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----((?>[^-]+|-(?!----))*+)-----END \1-----")
HEADER = re.compile(r"^[ \t]*([A-Za-z0-9-]+): (.*)$", re.MULTILINE)
KINDS = ("assign", "access", "hex", "key", "signed", "armour")
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
LONGEST_NEST = 12


def der(data: bytes, depth: int = 0) -> bool:
    """Do these bytes hold ASN.1 elements one after the other, with nested lengths that fit exactly?"""
    at = 0
    while at < len(data):
        if at + 2 > len(data) or depth > LONGEST_NEST:
            return False
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return False
            size = int.from_bytes(data[at:at + width], "big")
            at += width
        if at + size > len(data) or tag & 0x1F == 0x1F or tag == 0:
            return False
        if tag & 0x20 and not der(data[at:at + size], depth + 1):
            return False
        at += size
    return True


def key_bytes(data: bytes) -> bool:
    """A key in one of the usual encodings: one ASN.1 sequence around integers or strings, or length-prefixed fields."""
    if data[:1] == b"\x30" and len(data) >= 16:
        width = data[1] & 0x7F if data[1] & 0x80 else 0
        inner = data[2 + width:3 + width]
        return inner in (b"\x02", b"\x30") and _one_sequence(data) and der(data)
    if data.startswith(b"openssh-key-v1\0"):
        return fields(data[15:], 3)
    return data[4:8] == b"ssh-" and fields(data, 2)


def _one_sequence(data: bytes) -> bool:
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    size = int.from_bytes(data[2:2 + width], "big") if width else data[1]
    return 2 + width + size == len(data)


def fields(data: bytes, least: int) -> bool:
    """At least ``least`` fields, each behind its length in four bytes."""
    at, n = 0, 0
    while at + 4 <= len(data) and n < least:
        at += 4 + int.from_bytes(data[at:at + 4], "big")
        n += 1
        if at > len(data):
            return False
    return n == least


def unbase64(text: str) -> bytes:
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def unhex(text: str) -> bytes:
    return bytes.fromhex(text) if len(text) % 2 == 0 else b""


def signed(text: str) -> bool:
    """A token of three parts whose header names an algorithm and whose claims are an object."""
    head, claims, _ = text.split(".")
    try:
        head, claims = (json.loads(unbase64(part)) for part in (head, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def armoured(body: str) -> bool:
    """A key behind any header lines, or whole cipher blocks where the headers say that it is encrypted."""
    headers = dict(HEADER.findall(body))
    data = unbase64(HEADER.sub("", body))
    if "ENCRYPTED" in headers.get("Proc-Type", "") and headers.get("DEK-Info"):
        return len(data) >= 16 and len(data) % 8 == 0
    return key_bytes(data)


def spans_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then by kind."""
    found = []
    low = text.lower()
    if any(word in low for word in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in ANY_HEX.finditer(text) if key_bytes(unhex(m[0]))]
    found += [(m.start(), 3, m.end()) for m in BASE64.finditer(text) if key_bytes(unbase64(m[0]))]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if signed(m[0])]
    if "-----BEGIN " in text:
        found += [(m.start(), 5, m.end()) for m in ARMOUR.finditer(text) if armoured(m[2])]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(set(found))]


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of (doc_id, text, ...): all secrets of the whole text in code points, end exclusive.

    ``assign``, ``access`` and ``hex`` are patterns. ``key`` is base64 or hex that decodes to a key, ``signed`` a token with
    a header that names its algorithm, ``armour`` a text block around a key, encrypted ones too. NULL and empty texts have no spans.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in spans_of(text)]
                     for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return whole(docs).mapInArrow(run, SPANS)


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of the pattern spans, and all spans as text."""
    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))
