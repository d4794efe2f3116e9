import struct

import numpy as np
import pyarrow as pa
import pytest

from mapframe.functions import codec, measures, overlay
from mapframe.functions.predicates import Shape, distance, intersects, intersects_batch, within

A = (codec.POLYGON, [np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)])
B = (codec.POLYGON, [np.array([(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)], float)])
HOLED = (codec.POLYGON, [A[1][0], np.array([(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], float)])


def area(geom):
    return measures.area(codec.decode(pa.array([codec.encode(geom)])))[0]


def test_text():
    one = codec.parse(bytes.fromhex("0101000000000000000000F03F0000000000000040"))
    assert codec.to_wkt(one) == "POINT (1 2)"
    assert codec.to_geojson((codec.POINT, (1.5, 2.0))) == '{"type":"Point","coordinates":[1.5,2.0]}'
    line = (codec.LINE, np.array([(0, 0), (1, 1)], float))
    assert codec.encode(line).hex().upper() == (
        "01020000000200000000000000000000000000000000000000000000000000F03F000000000000F03F")
    assert codec.to_wkt((codec.LINE, np.array([(0, 0), (1e20, 1e-7)]))) == "LINESTRING (0 0, 1e+20 1e-07)"
    assert codec.to_wkt((codec.MULTIPOINT, [(codec.POINT, (1.0, 2.0)), (codec.POINT, (3.0, 4.5))])) == (
        "MULTIPOINT (1 2, 3 4.5)")


@pytest.mark.parametrize("wkb", [
    struct.pack(">BIdd", 0, 1, 1, 2),
    struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 1, 2),
    struct.pack("<BIddd", 1, 1 | 0x80000000, 1, 2, 9),
    struct.pack("<BIddd", 1, 1001, 1, 2, 9),
    struct.pack("<BIddd", 1, 1 | 0x40000000, 1, 2, 9),
    struct.pack("<BIddd", 1, 2001, 1, 2, 9),
    struct.pack("<BIdddd", 1, 3001, 1, 2, 9, 9),
])
def test_variants(wkb):
    assert codec.parse(wkb) == (codec.POINT, (1.0, 2.0))


@pytest.mark.parametrize("wkb", [b"", b"abcd", struct.pack("<BI", 1, 0), struct.pack("<BI", 1, 9),
                                 struct.pack("<BId", 1, 1, 1.0), struct.pack("<BII", 1, 2, 5)])
def test_undecodable(wkb):
    assert codec.parse(wkb) is None
    assert codec.decode(pa.array([wkb])).kind[0] == 0


def test_batch_equals_single():
    line = (codec.LINE, np.array([(0, 0), (3, 4)], float))
    multi = (codec.MULTIPOLYGON, [A, HOLED])
    mixed = [A, line, None, (codec.POINT, (1.0, 2.0)), multi, (codec.COLLECTION, [(codec.POINT, (9.0, 9.0)), line])] * 9
    many = codec.decode(pa.array([codec.encode(g) for g in mixed]))
    single = [codec.decode(pa.array([codec.encode(g)], pa.binary())) for g in mixed]
    for fn in (measures.area, measures.length):
        assert fn(many).tolist() == [fn(s)[0] for s in single]
    assert np.array_equal(measures.bounds(many), np.hstack([measures.bounds(s) for s in single]), equal_nan=True)
    sliced = codec.decode(pa.array([codec.encode(g) for g in mixed]).slice(3, 20))
    assert np.array_equal(measures.bounds(sliced), measures.bounds(many)[:, 3:23], equal_nan=True)


def test_measures():
    assert area(HOLED) == 15
    assert area(overlay.union([A, B])) == 28
    assert codec.to_wkt(overlay.difference(A, B)) == "POLYGON ((0 0, 4 0, 4 2, 2 2, 2 4, 0 4, 0 0))"
    ring = overlay.buffer((codec.POINT, (0.0, 0.0)), 1.0)
    assert len(ring[1][0]) == 33 and area(ring) == pytest.approx(3.121445152258052, abs=1e-12)
    hole = overlay.difference(A, (codec.POLYGON, [np.array([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], float)]))
    assert len(hole[1]) == 2 and area(hole) == 12


def test_relations():
    a, corner = Shape(A), Shape((codec.POINT, (4.0, 4.0)))
    assert intersects(a, corner) and not within(corner, a)
    assert within(Shape((codec.POINT, (3.0, 1.0))), Shape(HOLED))
    assert not intersects(Shape((codec.POINT, (1.5, 1.5))), Shape(HOLED))
    assert within(a, a) and not within(a, Shape(HOLED)) and within(Shape(HOLED), a)
    edge = Shape((codec.LINE, np.array([(0, 0), (4, 0)], float)))
    assert intersects(edge, a) and not within(edge, a)
    assert distance(Shape((codec.POINT, (7.0, 8.0))), a) == 5


def jts_geometry(spark, geom):
    return spark._jvm.org.locationtech.jts.io.WKTReader().read(codec.to_wkt(geom))


def random_polygon(rng):
    n = int(rng.integers(3, 9))
    turn = np.sort(rng.uniform(0, 2 * np.pi, n)) + np.arange(n) * 1e-3
    if np.max(np.diff(np.append(turn, turn[0] + 2 * np.pi))) > 3:
        return random_polygon(rng)
    size = rng.uniform(1, 4, n)
    center = rng.uniform(0, 6, 2)
    ring = center + np.column_stack([size * np.cos(turn), size * np.sin(turn)])
    if rng.random() < 0.5:  # whole coordinates give shared vertices and edges
        ring = np.round(ring)
    return codec.POLYGON, [np.vstack([ring, ring[:1]])]


def test_against_jts(spark):
    rng = np.random.default_rng(7)
    checked, pairs = 0, []
    while checked < 150:
        g, h = random_polygon(rng), random_polygon(rng)
        jg, jh = jts_geometry(spark, g), jts_geometry(spark, h)
        if not (jg.isValid() and jh.isValid()) or jg.getArea() == 0 or jh.getArea() == 0:
            continue
        checked += 1
        sg, sh = Shape(g), Shape(h)
        pairs.append((g, h, jg.intersects(jh)))
        assert intersects(sg, sh) == jg.intersects(jh), (codec.to_wkt(g), codec.to_wkt(h))
        assert within(sg, sh) == jg.within(jh), (codec.to_wkt(g), codec.to_wkt(h))
        assert distance(sg, sh) == pytest.approx(jg.distance(jh), abs=1e-9)
        assert area(overlay.difference(g, h)) == pytest.approx(jg.difference(jh).getArea(), abs=1e-7)
        assert area(overlay.union([g, h])) == pytest.approx(jg.union(jh).getArea(), abs=1e-7)
        line = (codec.LINE, h[1][0][:3])
        jl = jts_geometry(spark, line)
        assert intersects(Shape(line), sg) == jl.intersects(jg)
        assert within(Shape(line), sg) == jl.within(jg), (codec.to_wkt(line), codec.to_wkt(g))
        p = (codec.POINT, tuple(h[1][0][0].tolist()))
        assert within(Shape(p), sg) == jts_geometry(spark, p).within(jg)
        pairs += [(line, g, jl.intersects(jg)), (g, p, jg.intersects(jts_geometry(spark, p)))]
    pairs += [(A, (codec.POLYGON, [0.1 * A[1][0] + 1]), True), (HOLED, (codec.POLYGON, [0.1 * A[1][0] + 1.2]), False),
              ((codec.MULTIPOLYGON, [A, (codec.POLYGON, [A[1][0] + 10])]), (codec.POINT, (11.0, 12.0)), True)]
    left, right = (codec.decode(pa.array([codec.encode(pair[k]) for pair in pairs])) for k in (0, 1))
    got = intersects_batch(left, right, np.arange(len(pairs)))
    assert got.tolist() == [bool(pair[2]) for pair in pairs]
