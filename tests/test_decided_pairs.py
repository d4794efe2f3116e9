"""Pairs that boxes decide, and rows that are measured by the batch, against the tests of single pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapframe.functions import codec, measures, overlay, predicates, spatial
from mapframe.operators import joins, profile

SHAPES = [
    (codec.POINT, (1.0, 1.0)), (codec.POINT, (0.0, 1.0)), (codec.POINT, (5.0, 5.0)),
    (codec.LINE, np.array([[0, 0], [2, 2.0]])), (codec.LINE, np.array([[0, 0], [0, 2.0]])), (codec.LINE, np.array([[1, 1], [1, 1.0]])),
    (codec.POLYGON, [np.array([[0, 0], [0, 2], [2, 2], [2, 0], [0, 0.0]])]),
    (codec.POLYGON, [np.array([[2, 2], [0, 2], [0, 0], [2, 0], [2, 2.0]])]),
    (codec.POLYGON, [np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0.0]])]),  # a bow tie, no rectangle
    (codec.POLYGON, [np.array([[0, 0], [2, 0], [0, 0], [2, 2], [0, 0.0]])]),
    (codec.POLYGON, [np.array([[1, 0], [2, 1], [1, 2], [0, 1], [1, 0.0]])]),
    (codec.POLYGON, [np.array([[0, 0], [0, 4], [4, 4], [4, 0], [0, 0.0]]), np.array([[0.5, 0.5], [0.5, 3], [3, 3], [3, 0.5], [0.5, 0.5]])]),
    (codec.MULTIPOLYGON, [(codec.POLYGON, [np.array([[4, 4], [6, 4], [6, 6], [4, 6], [4, 4.0]])])]),
]


def test_kinds():
    kinds = measures.plain_kind(codec.decode(pa.array([codec.encode(g) for g in SHAPES] + [None], pa.binary())))
    assert kinds.tolist() == [1, 1, 1, 0, 0, 0, 2, 2, 3, 3, 3, 3, 0, 0]


@pytest.mark.parametrize("predicate", ["intersects", "within"])
@pytest.mark.parametrize("limit", [0, joins.BROADCAST_BYTES])
def test_mixed_kinds_like_single_pairs(spark, predicate, limit):
    rows = [(i, bytearray(codec.encode(g))) for i, g in enumerate(SHAPES)]
    df = profile.with_bounds(spark.createDataFrame(rows, "_fid long, geometry binary"))
    shapes = [predicates.Shape(g) for g in SHAPES]
    simple = [i for i in range(len(SHAPES)) if i not in (8, 9)]  # valid ones
    want = sorted((i, j) for i in simple for j in simple if getattr(predicates, predicate)(shapes[i], shapes[j]))
    df = df.where(F.col("_fid").isin(simple))
    got = joins.spatial_join(df, df, predicate, broadcast_bytes=limit).select("_fid", "_fid_right").collect()
    assert sorted(map(tuple, got)) == want


def test_boxes_decide_rectangles_without_a_geometry_test(spark):
    pts = profile.points(spark.createDataFrame([(1, 1.0, 1.0)], "_fid long, x double, y double"), "x", "y")
    box = profile.with_bounds(spark.createDataFrame([(1, bytearray(codec.encode(SHAPES[6])))], "_fid long, geometry binary"))
    plan = joins.spatial_join(pts, box, "within", broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_within" not in plan


def test_meetings_set_the_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_MEETINGS", 500)
    rows = [(i, i % 40 / 10, i % 7 / 2) for i in range(200)]
    pts = profile.points(spark.createDataFrame(rows, "_fid long, x double, y double"), "x", "y")
    found = joins.spatial_join(pts, pts, "distance", distance=0.5, broadcast_bytes=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert max(int(n) for n in re.findall(r"RepartitionByExpression.*?\], (\d+)", plan)) > 10


@pytest.mark.parametrize("place", [(1.0, 1.0), (0.0, 1.0), (5.0, 5.5), (1.7, 3.9), (-3.0, 0.2)])
def test_distance_of_a_point_by_the_batch(place):
    point = predicates.Shape((codec.POINT, place))
    batch = pa.array([codec.encode(g) for g in SHAPES], pa.binary())
    other = pa.array([codec.encode((codec.POINT, place))] * len(SHAPES), pa.binary())
    want = [predicates.distance(predicates.Shape(g), point) for g in SHAPES]
    for pair in ((batch, other), (other, batch)):
        assert spatial._relate("distance", *pair).to_pylist() == pytest.approx(want, abs=1e-12)


def test_buffers_of_a_batch(spark):
    rows = [(i, bytearray(codec.encode(g)), d) for i, (g, d) in enumerate(zip(SHAPES, [2.0, -1.0, 0.0, 1.0, None]))]
    rows.append((9, None, 1.0))
    df = spark.createDataFrame(rows, "id int, g binary, d double").select("id", spatial.st_buffer("g", F.col("d")).alias("b"))
    got = {r.id: r.b and bytes(r.b) for r in df.collect()}
    want = {i: codec.encode(overlay.buffer(codec.parse(bytes(g)), d)) if g and d is not None else None for i, g, d in rows}
    assert got == want


def test_chains_like_geojson(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, array(0D, 1D, 2D), array(5D, 6D, 7D)), (2, array(0.1D, 1D), array(3D, 4D)),
        (3, NULL, array(3D)), (4, array(1D, NULL), array(3D, 4D)), (5, array(1D), array(3D, 4D)) t(id, xs, ys)""").coalesce(1)
    got = {r.id: r.t for r in df.select("id", spatial.st_astext(spatial.st_makeline("xs", "ys")).alias("t")).collect()}
    assert got == {1: "LINESTRING (0 5, 1 6, 2 7)", 2: "LINESTRING (0.1 3, 1 4)", 3: None, 4: None, 5: None}
