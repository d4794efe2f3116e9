import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapframe import BadRequest, Catalog, NotFound
from mapframe.functions import spatial
from mapframe.operators import features, sqltext

THREE = [("Sydney", 151.2, -33.8, 5000000), ("Melbourne", 144.9, -37.8, 4900000), ("Brisbane", 153.0, -27.5, 2500000)]
FIVE = [("Sydney", 151.2093, -33.8688, 5312000), ("Melbourne", 144.9631, -37.8136, 4936000),
        ("Brisbane", 153.0251, -27.4698, 2514000), ("Perth", 115.8605, -31.9505, 2085000),
        ("Adelaide", 138.6007, -34.9285, 1345000)]


def collection(rows, field):
    return {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {"name": n, field: v}}
        for n, x, y, v in rows]}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("catalog")
    (root / "test.geojson").write_text(json.dumps(collection(THREE, "pop")))
    (root / "cities.geojson").write_text(json.dumps(collection(FIVE, "population")))
    made = Catalog(spark, str(root / "data"))
    made.three = made.load_file(str(root / "test.geojson"), confine_to=str(root))
    made.five = made.load_file(str(root / "cities.geojson"))
    return made


def names(text):
    return [f["properties"]["name"] for f in json.loads(text)["features"]]


def test_load(catalog):
    three, five = catalog.three, catalog.five
    assert (three.feature_count, three.geometry_type, three.geometry_column, three.srid) == (3, "point", "geometry", 4326)
    b = three.bounds
    assert (b.min_x, b.min_y, b.max_x, b.max_y) == (144.9, -37.8, 153.0, -27.5)
    assert [c["name"] for c in three.columns] == ["name", "pop", "geometry"]
    b = catalog.bounds(five.id)
    assert (b.min_x, b.min_y, b.max_x, b.max_y) == (115.8605, -37.8136, 153.0251, -27.4698)
    assert three.name == "test"


def test_geojson(catalog):
    text = catalog.features_geojson(catalog.three.id)
    first = json.loads(text)["features"][0]
    assert first == {"type": "Feature", "id": 0, "geometry": {"type": "Point", "coordinates": [151.2, -33.8]},
                     "properties": {"name": "Sydney", "pop": 5000000}}
    assert names(catalog.features_geojson(catalog.three.id, bbox="150,-34.5,152,-33")) == ["Sydney"]
    assert names(catalog.features_geojson(catalog.three.id, bbox=(0, -0.5, 1, 1))) == []
    assert len(names(catalog.features_geojson(catalog.five.id, limit=3))) == 3
    assert names(catalog.features_geojson(catalog.five.id, limit=2, offset=3)) == ["Perth", "Adelaide"]


def test_arrow(catalog):
    table = pa.ipc.open_stream(catalog.features_arrow(catalog.five.id, limit=2)).read_all()
    assert table.column("name").to_pylist() == ["Sydney", "Melbourne"]
    assert table.schema.names[-1] == "geometry"
    assert table.schema.field("geometry").metadata == {b"ARROW:extension:name": b"geoarrow.wkb"}
    inside = pa.ipc.open_stream(catalog.features_arrow(catalog.five.id, bbox="150,-34.5,152.5,-33")).read_all()
    assert inside.column("name").to_pylist() == ["Sydney"]
    assert pa.ipc.open_stream(catalog.features_arrow(catalog.five.id, bbox="0,0,1,1")).read_all().num_rows == 0


@pytest.mark.parametrize("bbox", ["1,2,3", "a,b,c,d", "NaN,0,1,1", "1,0,1,2", "2,0,1,2", "0,inf,1,2"])
def test_bad_bbox(catalog, bbox):
    with pytest.raises(BadRequest):
        catalog.features(catalog.three.id, bbox=bbox)


def test_crud(catalog, spark):
    made = catalog.create(catalog.table(catalog.five).drop("_fid"), "copy")
    assert made.id in {d.id for d in catalog.list()}
    assert catalog.get(made.id).feature_count == 5
    catalog.delete(made.id)
    with pytest.raises(NotFound):
        catalog.get(made.id)
    assert not spark.catalog.tableExists(made.table_name)
    again = Catalog(spark, catalog.root)
    assert {d.id for d in again.restore()} == {d.id for d in catalog.list()}


def test_hidden_columns_and_filter(catalog):
    page = catalog.features(catalog.three.id).features
    assert not [c for c in page.columns if c.startswith("_bbox")]
    assert catalog.query(catalog.five.id, '"population" > 2500000').count() == 3
    assert catalog.query(catalog.five.id, "  ").count() == 5


def test_sql(catalog, spark):
    table = catalog.five.table_name
    shown = sqltext.preview_sql(spark, f"SELECT name, geometry FROM {table} WHERE name = 'Perth';")
    assert shown.rows == [["Perth", "POINT (115.8605 -31.9505)"]] and shown.row_count == 1
    near = sqltext.preview_sql(
        spark, f"SELECT name FROM {table} WHERE ST_Intersects(geometry, ST_Buffer(ST_Point(151.2, -33.8), 0.2))")
    assert near.rows == [["Sydney"]]
    for bad in ("", "  ", f"DROP TABLE {table}", "SELECT nothing_here", "SELECT 1; SELECT 2"):
        with pytest.raises(BadRequest):
            sqltext.preview_sql(spark, bad)
    made = catalog.create_from_sql(f"SELECT name, ST_Buffer(geometry, 1.0D) AS geometry FROM {table}", " wide ")
    assert (made.name, made.geometry_type, made.feature_count) == ("wide", "polygon", 5)
    assert made.bounds.min_x == pytest.approx(114.8605)
    plain = catalog.create_from_sql(f"SELECT name FROM {table}", "plain")
    assert plain.geometry_column is None and plain.bounds is None and plain.geometry_type == "unknown"
    with pytest.raises(BadRequest):
        catalog.create_from_sql("SELECT 1", " ")


def test_empty_and_projected(catalog, spark):
    empty = catalog.create(catalog.table(catalog.five).where("1 = 0").drop("_fid"), "empty")
    assert empty.bounds is None and empty.feature_count == 0
    far = spark.sql("SELECT ST_Point(500000, 6000000) AS geometry")
    with pytest.warns(UserWarning):
        assert catalog.create(far, "far").srid == 0
    moved = catalog.create(far, "moved", srid=32755)
    assert moved.srid == 4326 and moved.bounds.min_x == pytest.approx(147.0)


def test_limits():
    assert features.cap_limit(None, 600000) == (500000, True)
    assert features.cap_limit(10, 600000) == (10, False)
    assert features.cap_limit(600000, 5) == (500000, True)
    assert sqltext.clamp(0) == 1 and sqltext.clamp(9999) == 500


def test_pushdown(catalog, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = catalog.features(catalog.five.id, bbox="0,0,1,1").features._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(_bbox_xmax,0.0)" in plan


def test_the_source_runs_once(spark, tmp_path):
    """Ranges of the layout come from staged rows, not from a second run of the source."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        calls.add(1)
        return float(v % 50)

    rows = spark.range(400).select("id", spatial.st_point(counted("id"), 1.0).alias("geometry"))
    catalog = Catalog(spark, str(tmp_path / "store"))
    made = catalog.create(rows, "once", 4326)  # without it, some rows are looked at for their SRID
    assert catalog.table(made).count() == 400
    assert calls.value == 400
