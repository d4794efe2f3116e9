import pytest
from pyspark.sql import functions as F

from mapframe.functions import color, spatial
from mapframe.operators import cluster, dissolve, features, parts, profile, style
from mapframe.plans import layers


def fills(df, key="_fid"):
    return {r[0]: tuple(r[1]) for r in df.select(key, "fill").collect()}


def test_colors(spark):
    assert color.parse_hex("#3388FF", 9) == (51, 136, 255, 9) and color.parse_hex("nope") == (100, 100, 100, 255)
    row = spark.sql("SELECT explode(array('#0a0B0c', 'ffffff', 'xx', NULL)) c")
    assert [tuple(r[0]) for r in row.select(color.hex_to_rgba(F.col("c"), 7)).collect()] == [
        (10, 11, 12, 7), (255, 255, 255, 7), (100, 100, 100, 7), (100, 100, 100, 7)]
    t = spark.sql("SELECT explode(array(-1D, 0D, 0.25D, 0.5D, 1D, 2D)) t")
    got = [tuple(r[0])[:3] for r in t.select(color.ramp_color(F.col("t"), ["#000000", "#0000ff", "#ffffff"])).collect()]
    assert got == [(0, 0, 0), (0, 0, 0), (0, 0, 128), (0, 0, 255), (255, 255, 255), (255, 255, 255)]


def test_graduated(spark):
    df = spark.createDataFrame([(0, 10.0), (1, None), (2, 20.0)], "_fid long, v double")
    look = {"type": "graduated", "property": "v", "colors": ["#000000", "#ffffff"]}
    assert fills(style.classify(df, look, 1.0)) == {0: (0, 0, 0, 255), 1: (100, 100, 100, 255), 2: (255, 255, 255, 255)}
    same = df.where("v = 10")
    assert fills(style.classify(same, look, 1.0)) == {0: (0, 0, 0, 255)}
    text = df.withColumn("v", F.col("v").cast("string"))
    assert fills(style.classify(text, look, 1.0)) == fills(style.classify(df, look, 1.0))
    nothing = df.where("v IS NULL")
    assert fills(style.classify(nothing, look, 0.5)) == {1: (51, 136, 255, 128)}
    assert fills(style.classify(df, {"type": "simple", "fillColor": "#010203"}, 1.0))[0] == (1, 2, 3, 255)


def test_categorized(spark):
    rows = [(0, "b"), (1, "a"), (2, None), (3, "b"), (4, "c")]
    df = spark.createDataFrame(rows, "_fid long, v string").repartition(3)
    two = {"type": "graduated", "property": "v", "colors": ["#000000", "#ffffff"]}
    palette = [color.parse_hex(c) for c in color.CATEGORY_COLORS]
    assert fills(style.classify(df, two, 1.0)) == {0: palette[0], 1: palette[1], 2: (100, 100, 100, 255), 3: palette[0], 4: palette[2]}
    three = {**two, "type": "categorized", "colors": ["#000000", "#ffffff", "#0000ff"]}
    assert fills(style.classify(df, three, 1.0))[4] == (0, 0, 255, 255)


def test_parts(spark):
    texts = ['{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}',
             '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"LineString","coordinates":[[0,0],[1,1]]}]}',
             None, '{"type":"Point","coordinates":[7,8]}']
    df = spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "_fid long, name string, t string")
    df = df.withColumn("geometry", spatial.st_geomfromgeojson("t")).drop("t")
    got = [(r._fid, r.name, r.part, r.part_type) for r in parts.explode_parts(df).orderBy("_fid", "part").collect()]
    assert got == [(0, "n0", 0, "Polygon"), (0, "n0", 1, "Polygon"), (1, "n1", 0, "Point"), (3, "n3", 0, "Point")]
    look = layers.layer_of(df, "mixed", "polygon")
    assert layers.render_map([look]).count() == 4
    assert layers.reorder([{"name": "a"}, {"name": "b"}], "a", "up") == [{"name": "b"}, {"name": "a"}]


def test_clusters(spark):
    df = profile.points(spark.createDataFrame([(i, 10.0, 10.0) for i in range(1500)] + [(9999, -120.0, 50.0), (10000, None, 1.0)],
                                              "_fid long, x double, y double"), "x", "y")
    got = {r.point_count: r for r in cluster.symbolize(cluster.cluster_points(df, [3])).collect()}
    assert got[1500].label == "1.5k" and got[1500].circle_radius == pytest.approx(31.763807)
    assert tuple(got[1500].fill) == (240, 59, 32, 204) and got[1].label is None and got[1].circle_radius == 5
    assert got[1].lon == pytest.approx(-120) and got[1].lat == pytest.approx(50)
    view = cluster.clusters_in_view(df, "0,0,20,20", 17.2)
    assert view.count() == 1500  # above the last clustered zoom points stay single
    assert cluster.clusters_in_view(df, "0,0,20,20", 16.9).count() == 1
    labels = spark.sql("SELECT explode(array(999, 1000, 1250, 9999, 10000, 12499)) n").select(cluster.abbreviated(F.col("n")))
    assert [r[0] for r in labels.collect()] == ["999", "1k", "1.3k", "10k", "10k", "12k"]


def test_dissolve(spark, monkeypatch):
    monkeypatch.setattr(dissolve, "FAN_IN", 3)
    rows = [("a", float(i % 5) - 2, 0.0) for i in range(40)] + [("b", 0.0, 0.0), ("b", 10.0, -10.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").withColumn(
        "geometry", spatial.st_makeenvelope("x", "y", F.col("x") + 1, F.col("y") + 1)).drop("x", "y")
    merged = dissolve.dissolve_polygons(df, ["k"])
    got = {r[0]: (r[1], r[2]) for r in merged.select("k", spatial.st_area("geometry"), spatial.st_geometrytype("geometry")).collect()}
    assert got == {"a": (5.0, "POLYGON"), "b": (2.0, "MULTIPOLYGON"), None: (1.0, "POLYGON")}


def test_identify(spark):
    df = profile.points(spark.createDataFrame(
        [(1, 0.0, 0.0, 3.0, "x" * 130, None), (2, 1.0, 0.0, 2.5, "s", 4), (3, 9.0, 9.0, 1.0, "far", 1)],
        "_fid long, px double, py double, v double, t string, n int"), "px", "py").drop("px", "py")
    for points in (True, False):
        rows = [tuple(r) for r in features.identify(df, 0, 0, 1.5, points=points).collect()]
        assert rows == [("3", "x" * 120 + "…", "NULL"), ("2.5000", "s", "4")]


def test_streaming_filter(spark, tmp_path):
    """The box filter is stateless and runs unchanged on a stream."""
    df = profile.points(spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 5.0)], "_fid long, x double, y double"), "x", "y")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = features.bbox_filter(stream, "-1,-1,1,1", points=True)
    job = (found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    job.awaitTermination(120)
    assert [r._fid for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
