"""Spatial functions as columns.

Everything that is plain arithmetic on bytes or numbers is a column expression;
the rest are Arrow UDFs that work on whole batches.  ``register`` installs the
same functions under their SQL names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codec, crs, measures, overlay, predicates
from .codec import POINT
from .measures import AREA_KIND, BOX_KIND, POINT_KIND  # noqa: F401

BBOX = ("_bbox_xmin", "_bbox_ymin", "_bbox_xmax", "_bbox_ymax")
BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
PART = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("ring", T.IntegerType()),
    T.StructField("type", T.StringType()), T.StructField("xs", T.ArrayType(T.DoubleType())),
    T.StructField("ys", T.ArrayType(T.DoubleType()))])

RING_LIST = T.ArrayType(T.StructType([
    T.StructField("ring", T.IntegerType()), T.StructField("xs", T.ArrayType(T.DoubleType())),
    T.StructField("ys", T.ArrayType(T.DoubleType()))]))
NESTED_PART = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("rings", RING_LIST)])


# --- helpers inside tasks -------------------------------------------------

def _floats(array) -> np.ndarray:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _nullable(values, null) -> pa.Array:
    return pa.array(values, mask=np.asarray(null, bool))


def _each(array, fn, out):
    """``fn`` of every distinct value of the batch, spread back to the rows."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    coded = array.dictionary_encode()
    done = pa.array([fn(v) for v in coded.dictionary.to_pylist()], out)
    return done.take(coded.indices)


def _points_against(op, px, py, shape):
    """Relation of many points to one other geometry."""
    edges = shape.edges
    same = np.zeros(len(px), bool)
    for x, y in shape.points:
        same |= (px == x) & (py == y)
    where = shape.locate(px, py)
    if op == "distance":
        best = np.full(len(px), np.inf)
        for x, y in shape.points:
            best = np.minimum(best, np.hypot(px - x, py - y))
        if len(edges):
            step = max(1, predicates._BLOCK // len(edges))
            for lo in range(0, len(px), step):
                part = slice(lo, lo + step)
                near = predicates._to_segments(np.column_stack([px[part], py[part]]), edges).min(axis=1)
                best[part] = np.minimum(best[part], near)
        return np.where(where > 0, 0.0, best)
    on = predicates.on_edges(shape.line_edges, px, py)
    if op == "intersects":
        return (where > 0) | on | same
    for line in shape.lines:  # the ends of an open line are its boundary
        if tuple(line[0]) != tuple(line[-1]):
            for x, y in (line[0], line[-1]):
                on &= ~((px == x) & (py == y))
    return (where == 2) | on | same


def _relate(op, left, right) -> pa.Array:
    """``op`` of two binary columns, computed once per distinct pair of the batch."""
    n = len(left)
    a, b = codec.decode(left), codec.decode(right)
    null = (a.kind == 0) | (b.kind == 0)
    result = np.zeros(n, "f8" if op == "distance" else bool)
    if op != "within" and not null.all() and (b.kind[~null] == POINT).all() and not (a.kind[~null] == POINT).all():
        left, right, a, b = right, left, b, a
    points = ~null & (a.kind == POINT)
    px, py = measures.bounds(a)[:2]
    if op == "distance":
        qx, qy = measures.bounds(b)[:2]
        both = points & (b.kind == POINT)
        result[both] = np.hypot(px[both] - qx[both], py[both] - qy[both])
        points &= ~both
    points &= ~np.isnan(px)
    codes_b = _codes(right)
    shapes = {}

    def shape(array, codes, row):
        key = id(array), codes[row]
        if key not in shapes:
            shapes[key] = predicates.Shape.of(array[int(row)].as_py())
        return shapes[key]

    done = np.zeros(n, bool)
    if op == "distance" and points.any():
        sizes = np.bincount(b.geom, weights=b.size, minlength=n)
        small = points & (sizes > 0) & (sizes <= predicates._BLOCK)
        result[small] = predicates.point_distances(px, py, b, small)[small]
        result[points & (sizes == 0)] = np.nan  # nothing is near an empty geometry
        done = points & (small | (sizes == 0))
        points &= ~done

    rest = ~null & ~points & ~done & ((a.kind != POINT) | (op != "distance") | (b.kind != POINT))
    if op == "intersects" and points.sum() < 8 * len(np.unique(codes_b[points])):
        rest, points = rest | points, points & False  # hardly a geometry occurs twice
    rows = np.flatnonzero(points)
    order = rows[np.argsort(codes_b[rows], kind="stable")]
    for group in np.split(order, np.flatnonzero(np.diff(codes_b[order])) + 1) if len(order) else []:
        result[group] = _points_against(op, px[group], py[group], shape(right, codes_b, group[0]))

    if op != "distance":
        box_a, box_b = measures.bounds(a), measures.bounds(b)
        rest &= _boxes_allow(op, box_a, box_b)
    rest = np.flatnonzero(rest)
    if op == "intersects":
        sizes = [np.bincount(v.geom, weights=v.size, minlength=n) for v in (a, b)]
        small = sizes[0][rest] * sizes[1][rest] < predicates._BLOCK
        result |= predicates.intersects_batch(a, b, rest[small])
        rest = rest[~small]  # large pairs one by one, in blocks of their own
    if len(rest):
        codes_a = _codes(left)
        fn = getattr(predicates, op)
        known = {}
        for i in rest:
            key = codes_a[i], codes_b[i]
            if key not in known:
                known[key] = fn(shape(left, codes_a, i), shape(right, codes_b, i))
            result[i] = known[key]
    if op == "distance":
        null = null | np.isnan(result)
    return _nullable(result, null)


def _boxes_allow(op, a, b):
    """Rows whose boxes leave the relation possible; False for empty geometries."""
    if op == "within":
        return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def _codes(array) -> np.ndarray:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


# --- Arrow UDFs -----------------------------------------------------------

@F.arrow_udf(T.BinaryType())
def _point(x: pa.Array, y: pa.Array) -> pa.Array:
    out = codec.encode_points(_floats(x), _floats(y))
    if x.null_count or y.null_count:
        valid = pa.compute.and_(x.is_valid(), y.is_valid())
        out = pa.compute.if_else(valid, out, pa.scalar(None, pa.binary()))
    return out


@F.arrow_udf(T.BinaryType())
def _box(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    values = [_floats(v) for v in (x0, y0, x1, y1)]
    out = codec.encode_boxes(*values)
    missing = np.isnan(np.vstack(values)).any(axis=0)
    if missing.any():
        out = pa.compute.if_else(pa.array(~missing), out, pa.scalar(None, pa.binary()))
    return out


def _chain(code):
    @F.arrow_udf(T.BinaryType())
    def made(xs: pa.Array, ys: pa.Array) -> pa.Array:
        """NULL where a list or a number in it is missing, or the lists differ in length."""
        xs, ys = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in (xs, ys))
        n = len(xs)
        sizes = [pa.compute.fill_null(pa.compute.list_value_length(v), 0).to_numpy(zero_copy_only=False) for v in (xs, ys)]
        bad = (sizes[0] != sizes[1]) | np.asarray(xs.is_null()) | np.asarray(ys.is_null())
        for v in (xs, ys):
            bad[pa.compute.list_parent_indices(v).filter(v.flatten().is_null()).to_numpy()] = True
        valid = pa.array(~bad)
        x, y = (_floats(v.filter(valid).flatten()) for v in (xs, ys))
        ends = np.concatenate([[0], np.cumsum(sizes[0][~bad])]).astype("i8")
        out = codec.encode_chains(code, ends, x, y)
        if not bad.any():
            return out
        place = np.full(n, -1)
        place[~bad] = np.arange(len(out))
        return out.take(pa.array(place, mask=bad))
    return made


_line = _chain(codec.LINE)
_polygon = _chain(codec.POLYGON)


@F.arrow_udf(BOX)
def _bounds(geom: pa.Array) -> pa.Array:
    b = measures.bounds(codec.decode(geom))
    return pa.StructArray.from_arrays(
        [_nullable(v, np.isnan(v)) for v in b], names=["xmin", "ymin", "xmax", "ymax"])


@F.arrow_udf(T.IntegerType())
def _plain_kind(geom: pa.Array) -> pa.Array:
    return pa.array(measures.plain_kind(codec.decode(geom)), pa.int32())


MEASURED = 1 << 22  # bytes of geometries that are decoded at once, about


def _measure(fn):
    """``fn`` adds up over the parts of a geometry, so one with very many lines is measured some lines at a time."""
    @F.arrow_udf(T.DoubleType())
    def measured(geom: pa.Array) -> pa.Array:
        size = codec.lengths(geom)
        large, out = np.flatnonzero(size > MEASURED), [np.zeros(0)]
        null = np.zeros(len(size), bool)
        cuts = np.unique(np.concatenate([large, large + 1, np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), MEASURED)),
                                         [0, len(size)]]))
        for lo, hi in zip(cuts, cuts[1:]):
            parts = codec.some_lines(geom[lo], MEASURED) if size[lo] > MEASURED else None
            if parts is not None:
                out.append(np.sum([fn(codec.decode(pa.array([part], pa.binary()))) for part in parts], axis=0))
                continue
            batch = codec.decode(geom.slice(lo, hi - lo))
            out.append(fn(batch))
            null[lo:hi] = batch.kind == 0
        return _nullable(np.concatenate(out), null)
    return measured


_area = _measure(measures.area)
_length = _measure(measures.length)


@F.arrow_udf(T.BinaryType())
def _centroid(geom: pa.Array) -> pa.Array:
    x, y = measures.centroid(codec.decode(geom))
    out = codec.encode_points(x, y)
    empty = np.isnan(x)
    return pa.compute.if_else(pa.array(~empty), out, pa.scalar(None, pa.binary())) if empty.any() else out


@F.arrow_udf(T.StringType())
def _text(geom: pa.Array) -> pa.Array:
    return _each(geom, lambda v: codec.to_wkt(codec.parse(v)), pa.string())


@F.arrow_udf(T.StringType())
def _geojson(geom: pa.Array) -> pa.Array:
    return _each(geom, lambda v: codec.to_geojson(codec.parse(v)), pa.string())


@F.arrow_udf(T.BinaryType())
def _from_geojson(text: pa.Array) -> pa.Array:
    def one(v):
        try:
            return codec.encode(codec.from_geojson(json.loads(v))) if v else None
        except (ValueError, TypeError, IndexError, AttributeError):
            return None
    return _each(text, one, pa.binary())


@F.arrow_udf(T.IntegerType())
def _srid(geom: pa.Array) -> pa.Array:
    """For SQL only: Spark has an ST_SRID of its own that a SQL function cannot replace."""
    def one(v):
        if v is None or len(v) < 9:
            return None if v is None else 0
        order = "little" if v[0] == 1 else "big"
        flagged = int.from_bytes(v[1:5], order) & 0x20000000
        return int.from_bytes(v[5:9], order, signed=True) if flagged else 0
    return pa.array([one(v) for v in geom.to_pylist()], pa.int32())


@F.arrow_udf(T.BooleanType())
def _intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    return _relate("intersects", a, b)


@F.arrow_udf(T.BooleanType())
def _within(a: pa.Array, b: pa.Array) -> pa.Array:
    return _relate("within", a, b)


@F.arrow_udf(T.DoubleType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return _relate("distance", a, b)


@F.arrow_udf(T.BinaryType())
def _difference(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x, y):
        left, right = codec.parse(x), codec.parse(y)
        return None if left is None or right is None else codec.encode(overlay.difference(left, right))
    rows, found = overlay.lines_without(codec.decode(a), codec.decode(b))
    out = np.empty(len(a), object)
    out[rows] = np.fromiter(found, object, len(found))
    rest = np.setdiff1d(np.arange(len(a)), rows)
    left, right = (side.take(pa.array(rest, pa.int64())).to_pylist() for side in (a, b))
    for row, x, y in zip(rest, left, right):
        out[row] = one(x, y)
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def _union(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x, y):
        left, right = codec.parse(x), codec.parse(y)
        return None if left is None or right is None else codec.encode(overlay.union([left, right]))
    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.binary())


@F.arrow_udf(T.BinaryType())
def _buffer(geom: pa.Array, distance: pa.Array) -> pa.Array:
    """Circles of a whole batch at once, anything else row by row."""
    def one(v, d):
        parsed = codec.parse(v)
        return None if parsed is None or d is None else codec.encode(overlay.buffer(parsed, d))

    if isinstance(geom, pa.ChunkedArray):
        geom, distance = geom.combine_chunks(), distance.combine_chunks()
    b, d = codec.decode(geom), _floats(distance)
    x, y = measures.bounds(b)[:2]
    round_ = (b.kind == POINT) & ~np.isnan(x) & (d > 0)
    rings = overlay.circles(x[round_], y[round_], d[round_])
    vertices = rings.shape[1]
    made = codec.encode_chains(codec.POLYGON, np.arange(len(rings) + 1) * vertices, *rings.reshape(-1, 2).T)
    if round_.all():
        return made
    rest = np.flatnonzero(~round_)
    apart = [one(geom[i].as_py(), distance[i].as_py()) for i in rest.tolist()]
    place = np.empty(len(geom), "i8")
    place[round_], place[rest] = np.arange(len(made)), len(made) + np.arange(len(rest))
    return pa.concat_arrays([made, pa.array(apart, pa.binary())]).take(pa.array(place))


@F.arrow_udf(T.BinaryType())
def _transform(geom: pa.Array, source: pa.Array, target: pa.Array) -> pa.Array:
    """Coordinates of a whole batch at once; the few values that are not plain are parsed and written anew."""
    if isinstance(geom, pa.ChunkedArray):
        geom, source, target = (v.combine_chunks() for v in (geom, source, target))
    places, odd = codec.coordinates(geom)
    codes = [v.dictionary_encode() for v in (source, target)]
    one, two = (c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in codes)
    names = [c.dictionary.to_pylist() for c in codes]
    known = (one >= 0) & (two >= 0)
    x, y = places.x.copy(), places.y.copy()
    for s, t in {*zip(one[known].tolist(), two[known].tolist())}:
        at = ((one == s) & (two == t))[places.geom]
        if at.any():
            x[at], y[at] = crs.convert(x[at], y[at], names[0][s], names[1][t])
    moved = codec.with_coordinates(geom, places, x, y)
    moved = pa.compute.if_else(pa.array(known), moved, pa.scalar(None, pa.binary()))
    rows = np.flatnonzero(odd & known)
    if not len(rows):
        return moved
    apart = [_moved(codec.parse(geom[i].as_py()), names[0][one[i]], names[1][two[i]]) for i in rows.tolist()]
    return pa.compute.replace_with_mask(moved, pa.array(odd & known), pa.array(map(codec.encode, apart), pa.binary()))


def _moved(parsed, source, target):
    if parsed is None or parsed[1] is None:
        return parsed
    code, body = parsed
    if code in (POINT, codec.LINE):
        at = np.asarray(body, "f8").reshape(-1, 2)
        at = np.column_stack(crs.convert(at[:, 0], at[:, 1], source, target))
        return code, tuple(at[0].tolist()) if code == POINT else at
    if code == codec.POLYGON:
        return code, [_moved((codec.LINE, ring), source, target)[1] for ring in body]
    return code, [_moved(member, source, target) for member in body]


def _drawable(b):
    """Kept rings, their coordinate lists, and type names by ring code."""
    keep = np.flatnonzero(measures.drawable_rings(b))
    pick = codec.spans(b.start[:-1][keep], b.size[keep])
    offsets = pa.array(np.concatenate([[0], np.cumsum(b.size[keep])]), pa.int32())
    xs, ys = (pa.ListArray.from_arrays(offsets, pa.array(v[pick])) for v in (b.x, b.y))
    return keep, xs, ys, np.array([None, "Point", "LineString", "Polygon"])


def _lists(owner, n, values, mask=None):
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)


@F.arrow_udf(T.ArrayType(PART))
def _parts(geom: pa.Array) -> pa.Array:
    """Rings of all drawable parts; NULL for NULL and undecodable geometries."""
    b = codec.decode(geom)
    keep, xs, ys, names = _drawable(b)
    rings = pa.StructArray.from_arrays(
        [pa.array(b.part[keep], pa.int32()), pa.array(b.ring[keep], pa.int32()),
         pa.array(names[b.code[keep]], pa.string()), xs, ys], names=["part", "ring", "type", "xs", "ys"])
    return _lists(b.geom[keep], b.n, rings, pa.array(b.kind == 0))


@F.arrow_udf(T.ArrayType(NESTED_PART))
def _nested_parts(geom: pa.Array) -> pa.Array:
    """Drawable parts with their rings inside."""
    b = codec.decode(geom)
    keep, xs, ys, names = _drawable(b)
    rings = pa.StructArray.from_arrays([pa.array(b.ring[keep], pa.int32()), xs, ys], names=["ring", "xs", "ys"])
    first = np.flatnonzero(b.ring[keep] == 0)
    of_ring = np.cumsum(b.ring[keep] == 0) - 1
    owned = pa.StructArray.from_arrays(
        [pa.array(b.part[keep][first], pa.int32()), pa.array(names[b.code[keep][first]], pa.string()),
         _lists(of_ring, len(first), rings)], names=["part", "type", "rings"])
    return _lists(b.geom[keep][first], b.n, owned, pa.array(b.kind == 0))


# --- columns --------------------------------------------------------------

def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double(v) -> Column:
    return (F.lit(v) if isinstance(v, (int, float)) else _column(v)).cast("double")


def st_point(x, y):
    return _point(_double(x), _double(y))


def st_makeenvelope(x0, y0, x1, y1):
    return _box(_double(x0), _double(y0), _double(x1), _double(y1))


def st_makeline(xs, ys):
    """Line through the places of two lists."""
    return _line(_column(xs), _column(ys))


def st_makepolygon(xs, ys):
    """Polygon of one closed ring, its places in two lists."""
    return _polygon(_column(xs), _column(ys))


def bounds(geom):
    """Struct ``xmin, ymin, xmax, ymax``; NULL members for NULL and empty geometries."""
    return _bounds(_column(geom))


def plain_kind(geom):
    """``POINT_KIND``, ``BOX_KIND`` for a rectangle along the axes, ``AREA_KIND`` for another polygon, 0 for the rest."""
    return _plain_kind(_column(geom))


def st_envelope(geom):
    b = bounds(geom)
    return _box(b["xmin"], b["ymin"], b["xmax"], b["ymax"])


def st_area(geom):
    return _area(_column(geom))


def st_length(geom):
    return _length(_column(geom))


def st_centroid(geom):
    return _centroid(_column(geom))


def st_astext(geom):
    return _text(_column(geom))


def st_asgeojson(geom):
    return _geojson(_column(geom))


def st_geomfromgeojson(text):
    return _from_geojson(_column(text))


def st_intersects(a, b):
    return _intersects(_column(a), _column(b))


def st_within(a, b):
    return _within(_column(a), _column(b))


def st_distance(a, b):
    return _distance(_column(a), _column(b))


def st_difference(a, b):
    return _difference(_column(a), _column(b))


def st_union(a, b):
    return _union(_column(a), _column(b))


def st_buffer(geom, distance):
    return _buffer(_column(geom), _double(distance))


def st_transform(geom, source, target):
    def name(v):
        return v if isinstance(v, Column) else F.lit(str(v))
    return _transform(_column(geom), name(source), name(target))


def parts(geom):
    return _parts(_column(geom))


def nested_parts(geom):
    return _nested_parts(_column(geom))


def _uint32(geom, at) -> Column:
    """Unsigned integer at a byte position, in the byte order of the value."""
    g = _column(geom)
    little = F.concat(*[F.substring(F.hex(g), 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0)])
    big = F.substring(F.hex(g), 2 * at + 1, 8)
    is_little = F.substring(F.hex(F.substring(g, 1, 1)), 1, 2) == "01"
    return F.conv(F.when(is_little, little).otherwise(big), 16, 10).cast("bigint")


def type_code(geom) -> Column:
    """1 .. 7, NULL when the header is short or names no known type."""
    head = F.substring(_column(geom), 1, 5)
    code = (_uint32(head, 1).bitwiseAND(F.lit(0xFFFF)) % 1000).cast("int")
    return F.when((F.length(_column(geom)) >= 5) & code.between(1, 7), code)


def st_geometrytype(geom) -> Column:
    names = F.array(*[F.lit(codec.TYPE_NAMES[k]) for k in range(1, 8)])
    code = type_code(geom)
    return F.when(_column(geom).isNotNull(), F.coalesce(F.try_element_at(names, code), F.lit("UNKNOWN")))


def st_srid(geom) -> Column:
    """SRID of EWKB values, 0 without one."""
    head = F.substring(_column(geom), 1, 9)
    flagged = _uint32(head, 1).bitwiseAND(F.lit(0x20000000)) != 0
    srid = F.when((F.length(head) >= 9) & flagged, _uint32(head, 5)).otherwise(F.lit(0))
    return F.when(_column(geom).isNotNull(), srid.cast("int"))


def st_aswkb(geom) -> Column:
    return _column(geom)


# --- SQL ------------------------------------------------------------------

def register(spark: SparkSession) -> None:
    """Install the spatial functions for ``spark.sql`` in this session."""
    udfs = {
        "ST_Point": _point, "ST_MakeEnvelope": _box, "ST_Area": _area, "ST_Length": _length,
        "ST_Centroid": _centroid, "ST_AsText": _text, "ST_AsGeoJSON": _geojson,
        "ST_GeomFromGeoJSON": _from_geojson, "ST_Intersects": _intersects, "ST_Within": _within,
        "ST_Distance": _distance, "ST_Difference": _difference, "ST_Union": _union,
        "ST_Buffer": _buffer, "ST_Transform": _transform, "ST_SRID": _srid, "mf_bounds": _bounds, "mf_parts": _parts,
    }
    for name, fn in udfs.items():
        spark.udf.register(name, fn)
    hexed = "hex(substring(g, 1, 9))"
    little = f"substring({hexed}, 1, 2) = '01'"

    def number(at):
        swapped = " || ".join(f"substring({hexed}, {2 * (at + k) + 1}, 2)" for k in (3, 2, 1, 0))
        return f"CAST(conv(CASE WHEN {little} THEN {swapped} ELSE substring({hexed}, {2 * at + 1}, 8) END, 16, 10) AS BIGINT)"

    names = ", ".join(f"'{codec.TYPE_NAMES[k]}'" for k in range(1, 8))
    bodies = {
        "ST_XMin(g BINARY) RETURNS DOUBLE": "mf_bounds(g).xmin",
        "ST_YMin(g BINARY) RETURNS DOUBLE": "mf_bounds(g).ymin",
        "ST_XMax(g BINARY) RETURNS DOUBLE": "mf_bounds(g).xmax",
        "ST_YMax(g BINARY) RETURNS DOUBLE": "mf_bounds(g).ymax",
        "ST_Envelope(g BINARY) RETURNS BINARY":
            "ST_MakeEnvelope(mf_bounds(g).xmin, mf_bounds(g).ymin, mf_bounds(g).xmax, mf_bounds(g).ymax)",
        "ST_AsWKB(g BINARY) RETURNS BINARY": "g",
        "ST_GeometryType(g BINARY) RETURNS STRING":
            f"CASE WHEN g IS NULL THEN NULL WHEN length(g) < 5 THEN 'UNKNOWN' ELSE "
            f"coalesce(try_element_at(array({names}), CAST(nullif({number(1)} & 65535, 0) % 1000 AS INT)), 'UNKNOWN') END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
