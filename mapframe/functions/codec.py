"""WKB codec over Arrow batches.

``decode`` turns one Arrow batch of WKB values into flat numpy arrays, so that
measures run once per batch instead of once per row.  Rows of equal length and
plain layout (2-D little-endian points, lines, one-ring polygons) are decoded
as one matrix; everything else goes through ``parse``.

Accepted: both byte orders, the EWKB SRID flag, and Z/M in the flag and in the
thousands convention (Z and M are dropped).  Anything undecodable is NULL.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
TYPE_NAMES = {
    1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT",
    5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION",
}
JSON_NAMES = {
    1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint",
    5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection",
}

MANY = 1 << 16  # bytes of a value with many parts


# --- one geometry ---------------------------------------------------------

def parse(wkb):
    """``(code, payload)`` of one WKB value, or None when undecodable.

    Payload: point ``(x, y)`` or None, line ``array(n, 2)``, polygon list of
    arrays, multi types and collections a list of ``(code, payload)``.
    """
    if wkb is None or len(wkb) < 5:
        return None
    try:
        return _read(memoryview(wkb), 0)[0]
    except (struct.error, ValueError, IndexError):
        return None


def _read(buf, pos):
    order = "<" if buf[pos] == 1 else ">"
    raw = struct.unpack_from(order + "I", buf, pos + 1)[0]
    pos += 5
    if raw & 0x20000000:
        pos += 4
    code16 = raw & 0xFFFF
    thousands = code16 // 1000
    dims = 2 + bool(raw & 0x80000000 or thousands in (1, 3)) + bool(raw & 0x40000000 or thousands in (2, 3))
    code = code16 % 1000

    def coords(count, at):
        if at + 8 * dims * count > len(buf):
            raise ValueError("truncated")
        flat = np.frombuffer(buf, order + "f8", count * dims, at).reshape(count, dims)
        return flat[:, :2].astype("f8"), at + 8 * dims * count

    def number(at):
        return struct.unpack_from(order + "I", buf, at)[0], at + 4

    if code == POINT:
        xy, pos = coords(1, pos)
        return (POINT, None if np.isnan(xy).any() else tuple(xy[0].tolist())), pos
    if code == LINE:
        count, pos = number(pos)
        xy, pos = coords(count, pos)
        return (LINE, xy), pos
    if code == POLYGON:
        rings = []
        count, pos = number(pos)
        for _ in range(count):
            size, pos = number(pos)
            xy, pos = coords(size, pos)
            rings.append(xy)
        return (POLYGON, rings), pos
    if MULTIPOINT <= code <= COLLECTION:
        members = []
        count, pos = number(pos)
        for _ in range(count):
            member, pos = _read(buf, pos)
            members.append(member)
        return (code, members), pos
    raise ValueError("unsupported geometry code")


def encode(geom) -> bytes | None:
    """Little-endian 2-D WKB of a parsed geometry."""
    if geom is None:
        return None
    code, body = geom
    head = struct.pack("<BI", 1, code)
    if code == POINT:
        return head + struct.pack("<dd", *(body or (float("nan"), float("nan"))))
    if code == LINE:
        return head + struct.pack("<I", len(body)) + np.asarray(body, "<f8").tobytes()
    if code == POLYGON:
        rings = [struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in body]
        return head + struct.pack("<I", len(body)) + b"".join(rings)
    return head + struct.pack("<I", len(body)) + b"".join(encode(m) for m in body)


def edges_as_lines(edges: np.ndarray) -> bytes:
    """WKB of a line of two vertices for each row, end to end."""
    block = np.empty((len(edges), 41), "u1")
    block[:, :9] = np.frombuffer(struct.pack("<BII", 1, LINE, 2), "u1")
    block[:, 9:] = np.ascontiguousarray(edges, "<f8").view("u1").reshape(len(edges), 32)
    return block.tobytes()


def multiline_head(n: int) -> bytes:
    """What stands before the WKB of ``n`` lines."""
    return struct.pack("<BII", 1, MULTILINE, n)


def _plain_multiline(data: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Vertices of each line and all vertices of a plain value: little-endian 2-D lines without an SRID; else None."""
    if len(data) < 18 or data[:5].tobytes() != struct.pack("<BI", 1, MULTILINE):
        return None
    buf, head, pos = memoryview(data), struct.pack("<BI", 1, LINE), 9
    n, first = struct.unpack_from("<I", buf, 5)[0], struct.unpack_from("<I", buf, 14)[0]
    if n * (9 + 16 * first) == len(data) - 9:  # lines of equal length, if all begin alike
        block = data[9:].reshape(n, -1)
        if (block[:, :9] == block[0, :9]).all() and block[0, :5].tobytes() == head:
            return np.full(n, first, "i8"), np.ascontiguousarray(block[:, 9:]).view("<f8").reshape(-1, 2)
    if n > len(data) // 9:
        return None
    size = np.empty(n, "i8")
    for i in range(n):
        if pos + 9 > len(data) or buf[pos:pos + 5] != head:
            return None
        size[i] = count = struct.unpack_from("<I", buf, pos + 5)[0]
        pos += 9 + 16 * count
        if pos > len(data):
            return None
    starts = np.cumsum(9 + 16 * size) - 16 * size + 9
    kept = np.ones(pos, bool)
    kept[:9] = False
    for i in range(1, 10):
        kept[starts - i] = False
    return size, data[:pos][kept].view("<f8").reshape(-1, 2)


def some_lines(value: pa.Scalar, size: int):
    """WKB of about ``size`` bytes each that hold the lines of a plain value of lines of equal length; else None."""
    data = np.frombuffer(value.as_buffer(), "u1")
    if len(data) < 18 or data[:5].tobytes() != struct.pack("<BI", 1, MULTILINE):
        return None
    n, vertices = struct.unpack_from("<I", data, 5)[0], struct.unpack_from("<I", data, 14)[0]
    if n * (9 + 16 * vertices) != len(data) - 9:
        return None
    block, step = data[9:].reshape(n, -1), max(1, size // (9 + 16 * vertices))
    if not (block[:, :9] == np.frombuffer(struct.pack("<BII", 1, LINE, vertices), "u1")).all():
        return None
    return (multiline_head(len(block[at:at + step])) + block[at:at + step].tobytes() for at in range(0, n, step))


def simple_parts(geom):
    """``(member, part, code, payload)`` of every point, line and polygon inside."""
    if geom is None:
        return
    code, body = geom
    if code in (POINT, LINE, POLYGON):
        if body is not None and len(body):
            yield 0, 0, code, body
    else:
        for i, member in enumerate(body):
            for _, part, c, b in simple_parts(member):
                if code == COLLECTION:
                    yield i, part, c, b
                else:
                    yield 0, i, c, b


# --- a batch --------------------------------------------------------------

@dataclass
class Batch:
    """Flat rings of ``n`` geometries; ring arrays are ordered by geometry."""

    n: int
    kind: np.ndarray    # per geometry: type code, 0 = NULL or undecodable
    geom: np.ndarray    # per ring: owning geometry
    member: np.ndarray  # per ring: member of a collection
    part: np.ndarray    # per ring: part of a multi geometry
    ring: np.ndarray    # per ring: 0 = shell, line or point; 1.. = hole
    code: np.ndarray    # per ring: POINT, LINE or POLYGON
    start: np.ndarray   # per ring, plus one: offset of its first vertex
    x: np.ndarray
    y: np.ndarray

    @property
    def size(self):
        return np.diff(self.start)


def _binary_parts(array):
    """(valid mask, start offsets, lengths, bytes) of an Arrow binary array."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_binary(array.type):
        array = array.cast(pa.binary())
    n = len(array)
    valid = np.asarray(array.is_valid())
    offsets_buffer, data_buffer = array.buffers()[1:3]
    if n == 0 or data_buffer is None:
        return valid, np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(0, "u1")
    offsets = np.frombuffer(offsets_buffer, "i4", n + 1, array.offset * 4).astype("i8")
    return valid, offsets[:-1], np.diff(offsets), np.frombuffer(data_buffer, "u1")


def lengths(array) -> np.ndarray:
    """Bytes of every value."""
    return _binary_parts(array)[2]


def decode(array) -> Batch:
    valid, begin, length, data = _binary_parts(array)
    n = len(valid)
    kind = np.zeros(n, "i1")
    todo = valid & (length >= 5)
    # per ring columns, collected in pieces: geom, member, part, ring, code, size
    rows, xs, ys = [], [], []

    lengths, counts = np.unique(length[todo], return_counts=True)
    if len(lengths) <= 64 or n > 64 * len(lengths):
        for size in lengths[(lengths >= 21) & (counts >= 8)]:
            at = np.flatnonzero(todo & (length == size))
            block = data[begin[at][:, None] + np.arange(size)]
            if (size - 5) % 16 == 0 and size == 21:
                code, head, vertices = POINT, b"\x01\x01\0\0\0", 1
            elif (size - 9) % 16 == 0:
                vertices = (size - 9) // 16
                code, head = LINE, b"\x01\x02\0\0\0" + struct.pack("<I", vertices)
            elif (size - 13) % 16 == 0:
                vertices = (size - 13) // 16
                code, head = POLYGON, b"\x01\x03\0\0\0\x01\0\0\0" + struct.pack("<I", vertices)
            else:
                continue
            plain = (block[:, : len(head)] == np.frombuffer(head, "u1")).all(axis=1)
            at, block = at[plain], block[plain]
            if not len(at):
                continue
            xy = np.ascontiguousarray(block[:, len(head):]).view("<f8").reshape(-1, 2)
            if code == POINT:
                filled = ~np.isnan(xy).any(axis=1)
                kind[at] = code
                todo[at] = False
                at, xy = at[filled], xy[filled]
            kind[at] = code
            todo[at] = False
            zeros = np.zeros(len(at), "i8")
            rows.append(np.stack([at, zeros, zeros, zeros, zeros + code, zeros + vertices]))
            xs.append(xy[:, 0])
            ys.append(xy[:, 1])

    for i in np.flatnonzero(todo & (length >= MANY)):  # their lines are not made one by one
        plain = _plain_multiline(data[begin[i]: begin[i] + length[i]])
        if plain is None:
            continue
        size, xy = plain
        kind[i], todo[i], zeros = MULTILINE, False, np.zeros(len(size), "i8")
        rows.append(np.stack([zeros + i, zeros, np.arange(len(size)), zeros, zeros + LINE, size])[:, size > 0])
        xs.append(xy[:, 0])
        ys.append(xy[:, 1])

    slow = []
    for i in np.flatnonzero(todo):
        geom = parse(data[begin[i]: begin[i] + length[i]].tobytes())
        if geom is None:
            continue
        kind[i] = geom[0]
        for member, part, code, body in simple_parts(geom):
            rings = body if code == POLYGON else [np.asarray(body, "f8").reshape(-1, 2)]
            for r, xy in enumerate(rings):
                if len(xy):
                    slow.append((i, member, part, r, code, len(xy)))
                    xs.append(xy[:, 0])
                    ys.append(xy[:, 1])
    if slow:
        rows.append(np.array(slow, "i8").T)

    table = np.concatenate(rows, axis=1) if rows else np.zeros((6, 0), "i8")
    x = np.concatenate(xs) if xs else np.zeros(0)
    y = np.concatenate(ys) if ys else np.zeros(0)
    if len(rows) > 1:
        order = np.argsort(table[0], kind="stable")
        first = np.concatenate([[0], np.cumsum(table[5])[:-1]])
        table = table[:, order]
        pick = spans(first[order], table[5])
        x, y = x[pick], y[pick]
    geom, member, part, ring, code, size = table
    return Batch(n, kind, geom, member, part, ring, code,
                 np.concatenate([[0], np.cumsum(size)]).astype("i8"), x, y)


def spans(start, size):
    """Concatenated index ranges ``start[i] .. start[i] + size[i]``."""
    total = int(size.sum())
    if total == 0:
        return np.zeros(0, "i8")
    jump = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return jump + np.arange(total)


def binary_array(values) -> pa.Array:
    return pa.array(values, pa.binary())


def fixed_width(block: np.ndarray) -> pa.Array:
    """Arrow binary array from the rows of a ``(n, width)`` byte matrix."""
    n, width = block.shape
    offsets = np.arange(0, width * (n + 1), width, dtype="i4") if n else np.zeros(1, "i4")
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(block))])


def encode_points(x: np.ndarray, y: np.ndarray) -> pa.Array:
    block = np.empty((len(x), 21), "u1")
    block[:, :5] = np.frombuffer(b"\x01\x01\0\0\0", "u1")
    block[:, 5:] = np.column_stack([x, y]).astype("<f8").view("u1").reshape(len(x), 16)
    return fixed_width(block)


def encode_boxes(x0, y0, x1, y1) -> pa.Array:
    ring = np.column_stack([x0, y0, x0, y1, x1, y1, x1, y0, x0, y0]).astype("<f8")
    block = np.empty((len(ring), 93), "u1")
    block[:, :13] = np.frombuffer(b"\x01\x03\0\0\0\x01\0\0\0\x05\0\0\0", "u1")
    block[:, 13:] = ring.view("u1").reshape(len(ring), 80)
    return fixed_width(block)


def encode_chains(code: int, offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    """Lines, or polygons of one ring, from the vertices between neighbouring offsets."""
    size = np.diff(offsets)
    head = np.frombuffer(struct.pack("<BI", 1, code) + (struct.pack("<I", 1) if code == POLYGON else b""), "u1")
    first = len(head) + 4
    ends = np.concatenate([[0], np.cumsum(first + 16 * size)])
    data = np.empty(int(ends[-1]), "u1")
    data[ends[:-1, None] + np.arange(len(head))] = head
    data[ends[:-1, None] + len(head) + np.arange(4)] = size.astype("<u4").view("u1").reshape(-1, 4)
    at = spans(ends[:-1] + first, 16 * size)
    vertex = spans(offsets[:-1], size)
    data[at] = np.column_stack([x[vertex], y[vertex]]).astype("<f8").view("u1").reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype("i4")), pa.py_buffer(data)])


# --- text -----------------------------------------------------------------

def number(v: float) -> str:
    """Shortest round-trip text, integers without a fraction: ``1``, ``1.5``, ``1e+20``."""
    text = repr(float(v))
    return text[:-2] if text.endswith(".0") else text


def to_wkt(geom) -> str | None:
    if geom is None:
        return None
    return f"{TYPE_NAMES[geom[0]]} {_wkt_body(geom)}"


def _wkt_body(geom) -> str:
    code, body = geom
    if body is None or not len(body):
        return "EMPTY"

    def vertices(xy):
        return "(" + ", ".join(f"{number(x)} {number(y)}" for x, y in np.asarray(xy).tolist()) + ")"

    if code == POINT:
        return vertices([body])
    if code == LINE:
        return vertices(body)
    if code == POLYGON:
        return "(" + ", ".join(vertices(r) for r in body) + ")"
    if code == MULTIPOINT:
        return "(" + ", ".join("EMPTY" if m[1] is None else vertices([m[1]])[1:-1] for m in body) + ")"
    if code == COLLECTION:
        return "(" + ", ".join(to_wkt(m) for m in body) + ")"
    return "(" + ", ".join(_wkt_body(m) for m in body) + ")"


def to_geojson(geom) -> str | None:
    if geom is None:
        return None
    code, body = geom
    name = JSON_NAMES[code]
    if code == COLLECTION:
        return f'{{"type":"{name}","geometries":[{",".join(to_geojson(m) for m in body)}]}}'
    return f'{{"type":"{name}","coordinates":{_json_coords(geom)}}}'


def _json_coords(geom) -> str:
    code, body = geom
    if body is None:
        return "[]"

    def pair(xy):
        return f"[{xy[0]!r},{xy[1]!r}]"

    def chain(xy):
        return "[" + ",".join(pair(p) for p in np.asarray(xy).tolist()) + "]"

    if code == POINT:
        return pair(body)
    if code == LINE:
        return chain(body)
    if code == POLYGON:
        return "[" + ",".join(chain(r) for r in body) + "]"
    return "[" + ",".join(_json_coords(m) for m in body) + "]"


def from_geojson(obj):
    """Parsed geometry of a GeoJSON geometry object (Z values are dropped)."""
    if not obj or "type" not in obj:
        return None
    codes = {name.lower(): code for code, name in JSON_NAMES.items()}
    code = codes.get(str(obj["type"]).lower())
    if code is None:
        return None
    if code == COLLECTION:
        members = [from_geojson(g) for g in obj.get("geometries") or []]
        return COLLECTION, [m for m in members if m is not None]
    return _from_coords(code, obj.get("coordinates") or [])


def _from_coords(code, c):
    if code == POINT:
        return POINT, (float(c[0]), float(c[1])) if len(c) >= 2 else None
    if code == LINE:
        return LINE, np.array([p[:2] for p in c], "f8").reshape(-1, 2)
    if code == POLYGON:
        return POLYGON, [np.array([p[:2] for p in ring], "f8").reshape(-1, 2) for ring in c]
    single = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}[code]
    return code, [_from_coords(single, member) for member in c]


# --- coordinates in place -------------------------------------------------------------------------

@dataclass
class Places:
    """Coordinates of a batch: owning geometry, byte position of x, and both values."""

    geom: np.ndarray
    at: np.ndarray
    x: np.ndarray
    y: np.ndarray


def with_coordinates(array, places: Places, x, y) -> pa.Array:
    """Plain values with other numbers in the given places."""
    data = np.array(_binary_parts(array)[3])
    eight = np.arange(8)
    for at, value in ((places.at, x), (places.at + 8, y)):
        data[at[:, None] + eight] = np.ascontiguousarray(value, "<f8").view("u1").reshape(-1, 8)
    buffers = array.buffers()
    return pa.Array.from_buffers(array.type, len(array), [*buffers[:2], pa.py_buffer(data)], offset=array.offset)


def coordinates(array) -> tuple[Places, np.ndarray]:
    """Where the coordinates of plain values stand, and which values are not plain: collections, values with empty
    parts, and those that are not little-endian 2-D WKB without an SRID, or cannot be decoded.

    The length of a plain value follows from its rings. Headers are looked at as well, so a value of another layout
    never passes for a plain one.
    """
    valid, begin, length, data = _binary_parts(array)
    b = decode(array)
    size, first = b.size, np.append(True, b.geom[1:] != b.geom[:-1]) if len(b.geom) else np.zeros(0, bool)
    new_part = first | (b.ring == 0)
    multi = (b.kind >= MULTIPOINT)[b.geom] if len(b.geom) else np.zeros(0, bool)
    part_head = np.select([b.code == POINT, b.code == LINE], [5, 9], 13)
    head = np.where(new_part, part_head, 4) + np.where(first & multi, 9, 0)
    ends = np.cumsum(head + 16 * size)
    before = ends - head - 16 * size
    start_of = before[first][np.cumsum(first) - 1] if len(first) else before
    at = begin[b.geom] + before - start_of + head  # first coordinate of each ring
    total = np.bincount(b.geom, head + 16 * size, b.n).astype("i8")
    good = (total == length) & (b.kind > 0) & (b.kind < COLLECTION)
    ok = good[b.geom] if len(b.geom) else np.zeros(0, bool)
    for wanted, where in ((b.kind[b.geom], begin[b.geom]), (b.code, at - part_head)):
        rows = ok & (new_part if wanted is b.code else True)
        place = where[rows]
        fits = (data[place] == 1) & (data[place + 1] == wanted[rows]) & (data[place + 2] == 0) & (data[place + 3] == 0) & (data[place + 4] == 0)
        good[b.geom[rows][~fits]] = False
    keep = good[b.geom] if len(b.geom) else np.zeros(0, bool)
    pick = spans(b.start[:-1][keep], size[keep])
    within = np.arange(len(pick)) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep])
    places = Places(np.repeat(b.geom[keep], size[keep]), np.repeat(at[keep], size[keep]) + 16 * within, b.x[pick], b.y[pick])
    return places, valid & ~good
