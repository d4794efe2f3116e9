"""Closed forms of map projections against published points, and reprojection of whole batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapframe.functions import codec, crs, spatial

CLARKE_FEET = (20925832.16, 294.978698214)
CLARKE = (6378206.4, 294.978698214)


def test_published_points():
    """Worked examples of the guidance note on projections (7-2) and of Snyder's working manual."""
    texas = crs._Lambert(27 + 50 / 60, -99.0, 28 + 23 / 60, 30 + 17 / 60, 2000000.0, 0.0, CLARKE_FEET)
    assert texas.forward(-96.0, 28.5, crs.NUMPY) == pytest.approx((2963503.91, 254759.80), abs=0.01)
    albers = crs._Albers(23.0, -96.0, 29.5, 45.5, 0.0, 0.0, CLARKE)
    assert albers.forward(-75.0, 35.0, crs.NUMPY) == pytest.approx((1885472.7, 1535925.0), abs=0.06)
    assert crs.convert(44.0, 73.0, 4326, 32661) == pytest.approx((3320416.75, 632668.43), abs=0.01)
    antarctic = crs._Polar(-1, 70.0, -71.0, 6000000.0, 6000000.0, crs.WGS84)
    assert antarctic.forward(120.0, -75.0, crs.NUMPY) == pytest.approx((7255380.79, 7053389.56), abs=0.01)


@pytest.mark.parametrize("srid", [*crs.LAMBERT, *crs.ALBERS, *crs.POLAR])
def test_there_and_back(spark, srid):
    """To a tenth of a millimetre, and the same from Spark columns as from arrays."""
    rng = np.random.default_rng(srid)
    south = crs._map(srid).pole < 0 if srid in crs.POLAR else crs._map(srid).cone < 0
    lon, lat = rng.uniform(-179, 179, 200), rng.uniform(25, 85, 200) * (-1 if south else 1)
    if srid not in crs.POLAR:
        lon = crs._map(srid).lon0 + lon / 4
        lon -= 360 * np.floor((lon + 180) / 360)
    x, y = crs.convert(lon, lat, 4326, srid)
    back = crs.convert(x, y, srid, 4326)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    row = spark.createDataFrame([(float(lon[0]), float(lat[0]))], "lon double, lat double").select(
        *crs.transform_xy(F.col("lon"), F.col("lat"), 4326, srid)).head()
    assert tuple(row) == pytest.approx((x[0], y[0]), abs=1e-6)


def shapes(rng):
    ring = lambda n: (lambda r: np.vstack([r, r[:1]]))(rng.uniform(100, 150, (n, 2)) * [1, -0.2])
    line = lambda: (codec.LINE, ring(rng.integers(2, 6)))
    polygon = lambda: (codec.POLYGON, [ring(4) for _ in range(rng.integers(1, 4))])
    point = lambda: (codec.POINT, tuple(ring(1)[0].tolist()))
    return [point(), line(), polygon(), (codec.MULTIPOINT, [point() for _ in range(3)]), (codec.MULTILINE, [line(), line()]),
            (codec.MULTIPOLYGON, [polygon(), polygon()]), (codec.COLLECTION, [point(), polygon()]), (codec.POINT, None),
            (codec.LINE, np.zeros((0, 2))), (codec.MULTIPOLYGON, [])]


def test_batches(spark):
    """Every kind of geometry, big-endian, SRID and 3-D values, NULLs and rubbish, from and to several systems."""
    rng, writer = np.random.default_rng(1), spark._jvm.org.locationtech.jts.io.WKBWriter
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    geoms = [g for _ in range(12) for g in shapes(rng)]
    values = [codec.encode(g) for g in geoms] + [None, b"rubbish", b""]
    for text in ("POINT(140 -20)", "POLYGON((140 -20,141 -20,141 -21,140 -20))", "POINT Z(140 -20 7)"):
        values += [bytes(writer(2, order, flag).write(reader.read(text))) for order in (1, 2) for flag in (False, True)]
        values += [bytes(writer(3, 1).write(reader.read(text)))]
    targets = [["3857", "EPSG:3577", "3112", None][i % 4] for i in range(len(values))]
    moved = spatial._transform.func(pa.array(values, pa.binary()), pa.array(["4326"] * len(values)), pa.array(targets)).to_pylist()

    def one(v, t):
        parsed = codec.parse(v)
        if parsed is None or t is None:
            return None
        for_all = lambda a: np.column_stack(crs.convert(a[:, 0], a[:, 1], 4326, t))

        def move(g):
            code, body = g
            if body is None:
                return g
            if code == codec.POINT:
                return code, tuple(for_all(np.array([body]))[0].tolist())
            if code == codec.LINE:
                return code, for_all(body)
            if code == codec.POLYGON:
                return code, [for_all(r) for r in body]
            return code, [move(m) for m in body]
        return codec.to_wkt(move(parsed))
    assert [codec.to_wkt(codec.parse(v)) if v is not None else None for v in moved] == [one(v, t) for v, t in zip(values, targets)]
