import math

import pytest
from pyspark.sql import functions as F

from mapframe.functions import spatial
from mapframe.operators import asof, features, joins, profile
from mapframe.plans import derived


def point_table(spark, rows):
    return profile.points(spark.createDataFrame(rows, "_fid long, x double, y double"), "x", "y").drop("x", "y")


def box_table(spark, rows):
    df = spark.createDataFrame(rows, "_fid long, a double, b double, c double, d double")
    return profile.with_bounds(df.withColumn("geometry", spatial.st_makeenvelope("a", "b", "c", "d"))).drop("a", "b", "c", "d")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the points are copies of one place."""
    pts = [(i, 5.0, 5.0) if i % 3 == 0 else (i, (i * 37 % 200) / 10, (i * 91 % 200) / 10) for i in range(600)]
    boxes = [(i, x := (i * 53 % 180) / 10, y := (i * 29 % 180) / 10, x + 0.1 * 4 ** (i % 5), y + 0.3 + i % 3)
             for i in range(60)]
    return pts, boxes, point_table(spark, pts), box_table(spark, boxes)


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_BYTES])
def test_points_in_boxes(skewed, limit):
    pts, boxes, p, b = skewed
    want = sorted((i, j) for i, x, y in pts for j, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    got = joins.spatial_join(p, b, "intersects", broadcast_bytes=limit).select("_fid", "_fid_right").collect()
    assert sorted(map(tuple, got)) == want
    inside = sorted((i, j) for i, x, y in pts for j, x0, y0, x1, y1 in boxes if x0 < x < x1 and y0 < y < y1)
    got = joins.spatial_join(p, b, "within", broadcast_bytes=limit).select("_fid", "_fid_right").collect()
    assert sorted(map(tuple, got)) == inside


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_BYTES])
def test_boxes_with_boxes(skewed, limit):
    _, boxes, _, b = skewed
    want = sorted((i, j) for i, a0, b0, a1, b1 in boxes for j, c0, d0, c1, d1 in boxes
                  if a0 <= c1 and c0 <= a1 and b0 <= d1 and d0 <= b1)
    got = joins.spatial_join(b, b, "intersects", broadcast_bytes=limit).select("_fid", "_fid_right").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_BYTES])
def test_distance_and_kinds(spark, skewed, limit):
    pts, _, p, _ = skewed
    few = [(i, x, y) for i, x, y in pts if i % 50 == 1]
    want = sorted((i, j) for i, x, y in pts for j, u, v in few if math.hypot(x - u, y - v) <= 1.05)
    q = point_table(spark, few)
    got = joins.spatial_join(p, q, "distance", distance=1.05, broadcast_bytes=limit).select("_fid", "_fid_right").collect()
    assert sorted(map(tuple, got)) == want
    hit = {i for i, _ in want}
    for how, ids in (("left_semi", hit), ("left_anti", {i for i, _, _ in pts} - hit)):
        rows = joins.spatial_join(p, q, "distance", how, 1.05, broadcast_bytes=limit).select("_fid").collect()
        assert sorted(r[0] for r in rows) == sorted(ids)
    left = joins.spatial_join(p, q, "distance", "left", 1.05, broadcast_bytes=limit)
    assert left.count() == len(want) + len(pts) - len(hit)
    assert left.where(F.col("_fid_right").isNull()).count() == len(pts) - len(hit)


def test_null_geometry(spark):
    p = point_table(spark, [(1, None, 1.0), (2, 1.0, 1.0)])
    b = box_table(spark, [(1, 0.0, 0.0, 2.0, 2.0)])
    assert joins.spatial_join(p, b).count() == 1
    assert joins.spatial_join(p, b, how="left").count() == 2


def test_no_cross_join(skewed):
    _, _, p, b = skewed
    for limit in (0, joins.BROADCAST_BYTES):
        plan = joins.spatial_join(p, b, broadcast_bytes=limit)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("swap", [False, True])
def test_crowded_cells_on_either_side(spark, monkeypatch, swap):
    """All boxes and most points lie in one cell; blocks of five rows on both sides still find every pair once."""
    monkeypatch.setattr(joins, "CROWD", 5)
    pts = [(i, 0.5 + (i % 7) / 100, 0.5) for i in range(120)]
    boxes = [(i, 0.0, 0.0, 0.52 + (i % 5) / 100, 0.9) for i in range(70)]
    p, b = point_table(spark, pts), box_table(spark, boxes)
    want = sorted((i, j) for i, x, y in pts for j, x0, y0, x1, y1 in boxes if x0 <= x <= x1)
    found = joins.spatial_join(b, p, broadcast_bytes=0) if swap else joins.spatial_join(p, b, broadcast_bytes=0)
    got = sorted((r["_fid_right"], r["_fid"]) if swap else (r["_fid"], r["_fid_right"]) for r in found.collect())
    assert got == want


def test_only_ids_and_boxes_meet_on_cells(spark, skewed):
    """Attributes and geometries are fetched by id; no exchange by cell carries them."""
    _, _, p, b = skewed
    found = joins.spatial_join(p.withColumn("note", F.lit("x")), b.withColumn("label", F.lit("y")), broadcast_bytes=0)
    plan = found._jdf.queryExecution().optimizedPlan()
    by_cell = []

    def look(node):
        if node.getClass().getSimpleName() == "Join" and "cx" in node.condition().toString():
            by_cell.extend(c for side in (node.left(), node.right()) for c in side.output().mkString(" ").split())
        for i in range(node.children().length()):
            look(node.children().apply(i))

    look(plan)
    assert by_cell and not [c for c in by_cell if "geometry" in c or "note" in c or "label" in c]


def test_positions_and_pages(spark):
    ids = [i * i * 10 ** 12 - 5 for i in range(60)]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "_fid long").repartition(5)
    got = sorted(map(tuple, features.with_position(df).select("_fid", "_pos").collect()))
    assert got == [(v, k) for k, v in enumerate(ids)]
    for offset in (0, 13, 55, 70):
        page = [r[0] for r in features.page(df, 10, offset, near=0, accuracy=100).collect()]
        assert page == ids[offset: offset + 10]
    assert features.with_position(df.where("false")).count() == 0


def test_pages_close_in_on_skewed_keys(spark):
    df = spark.range(20_000).select((F.col("id") + F.pow(F.col("id") / 2000, F.lit(12)).cast("long")).alias("k"), "id")
    want = [r.id for r in df.orderBy("k").offset(15_000).limit(30).collect()]
    assert [r.id for r in features.page(df, 30, 15_000, key="k", near=10, accuracy=50).collect()] == want


def test_positions_sort_no_more_than_a_partition(spark):
    """No window runs over rows; the only one is over the counts of partitions."""
    df = features.with_position(spark.range(1000).select((F.col("id") * 10 ** 15).alias("_fid")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "sum(_rows" in plan


def test_asof_one_moment(spark):
    """One key, and most rows at one moment: range partitions share them out, and results carry over."""
    rows = [(i, 1, 5 if 100 < i < 400 else i // 100, "r" if i % 7 == 0 else "l") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, t int, side string").repartition(4)
    left, right = df.where("side = 'l'"), df.where("side = 'r'")
    got = {r.id: r.latest and tuple(r.latest) for r in asof.asof_join(left, right, "k", "t", "id").collect()}
    marks = [(t, i) for i, _, t, side in rows if side == "r"]
    assert got == {i: max((m for m in marks if m[0] <= t), default=None) for i, _, t, side in rows if side == "l"}
    ordered = features.in_order(df.select("k", "t", F.xxhash64("id").alias("h")), "k", "t", "h")
    sizes = [r["count"] for r in ordered.groupBy("_part").count().collect()]
    assert max(sizes) < 200


@pytest.mark.parametrize("largest", [0, 15, 1 << 20])
def test_large_sides_are_not_collected(spark, monkeypatch, largest):
    """Geometries and attributes of a side that was measured to be large come by a shuffle, whatever Spark guesses."""
    sides = derived.diamonds(spark, "/root/testdata/sf0.001"), derived.boxes(spark, "/root/testdata/sf0.001")
    want = sorted((r.p_partkey, r.s_suppkey) for r in joins.spatial_join(*sides).collect())
    monkeypatch.setattr(joins, "FETCH_ROWS", largest)
    found = joins.spatial_join(*sides, broadcast_bytes=0)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [line for line in plan if "BroadcastHashJoin" in line and "_key" in line]
    assert len(sent) == {0: 0, 15: 2, 1 << 20: 4}[largest]  # ten boxes, two hundred diamonds, fetched twice each
    assert want and sorted((r.p_partkey, r.s_suppkey) for r in found.collect()) == want
