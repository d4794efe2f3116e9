"""Layouts of GeoJSON files, and what must not be lost in silence."""

import json

import pytest
from pyspark.errors import PySparkException

from mapframe.sources import documents, geojson


def feature(n):
    return {"type": "Feature", "properties": {"n": n}, "geometry": {"type": "Point", "coordinates": [n, 0]}}


def collection(*ns, **more):
    return {"type": "FeatureCollection", "features": [feature(n) for n in ns], **more}


def found(spark, path):
    return sorted(r.n for r in geojson.read_geojson(spark, str(path)).collect())


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(collection(1, 2), indent=2))
    (tmp_path / "b.geojson").write_text("\n".join(json.dumps(feature(n)) for n in (3, 4, 5)))
    lines = ",\n".join(json.dumps(feature(n)) for n in (6, 7))
    head = '{"type":"FeatureCollection","name":"x",\n"crs":{"type":"name","properties":{"name":"EPSG:3857"}},\n"features":[\n'
    (tmp_path / "c.geojson").write_text(head + lines + "\n]}")
    (tmp_path / "d.geojson").write_text(json.dumps(collection(8)))
    (tmp_path / "e.geojson").write_text(json.dumps(feature(9)))
    assert found(spark, tmp_path) == [1, 2, 3, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("bad", ['{"type":"Feature","properties":{"n":2},"geom', '{"type":"Thing"}', "hello", '{"n":1}'])
def test_malformed_lines_raise(spark, tmp_path, bad):
    (tmp_path / "a.geojson").write_text(json.dumps(feature(1)) + "\n" + bad + "\n" + json.dumps(feature(3)))
    with pytest.raises(PySparkException):
        found(spark, tmp_path)


def test_bare_geometries(spark, tmp_path):
    point = json.dumps({"type": "Point", "coordinates": [1, 2]})
    (tmp_path / "a.geojson").write_text(point + "\n" + json.dumps(feature(1)))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, indent=1))
    assert geojson.read_geojson(spark, str(tmp_path)).where("geometry IS NOT NULL").count() == 3


def test_late_crs(spark, tmp_path):
    crs = {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}}
    for name, text in (("a", json.dumps(collection(*range(200), **crs))), ("b", json.dumps(collection(1, **crs), indent=2)),
                       ("c", json.dumps(collection(1)))):
        (tmp_path / f"{name}.geojson").write_text(text)
        assert geojson.declared_srid(spark, str(tmp_path / f"{name}.geojson")) == (None if name == "c" else 3857)


PRETTY = """{
  "type": "FeatureCollection",
  "features": [
    {
      "type": "Feature",
      "properties": {"n": 1},
      "geometry":
        {"type": "Point", "coordinates": [1, 0]}
    },
    {
      "type": "Feature", "properties": {"n": 2},
      "geometry":
{"type": "Point", "coordinates": [2, 0]}
    }
  ]
}
"""


@pytest.mark.parametrize("layout", ["auto", "document"])
def test_geometry_on_a_line_of_its_own(spark, tmp_path, layout):
    (tmp_path / "a.geojson").write_text(PRETTY)
    rows = geojson.read_geojson(spark, str(tmp_path / "a.geojson"), layout).collect()
    assert sorted(r.n for r in rows) == [1, 2] and all(r.geometry for r in rows)


def tricky(n):
    """Braces, brackets, quotes and escapes inside of strings, nested values, and members in any order."""
    text = ["plain", "}{", '"}', "\\", "\\\\}", '\\"', "][}", "a,\n{b", "é}", ""][n % 10]
    members = {"geometry": {"coordinates": [n, [1.5][0]], "type": "Point"}, "type": "Feature",
               "properties": {"n": n, "s": text, "deep": {"x": [{"y": "}"}, {"z": []}]}}}
    return dict(sorted(members.items(), key=lambda m: (n * 7 + len(m[0])) % 3))


@pytest.mark.parametrize("layout", ["auto", "document"])
@pytest.mark.parametrize("indent", [None, 1])
def test_documents_are_read_by_many_tasks(spark, tmp_path, indent, layout):
    docs = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:3857"}}, "name": 'f "features": [{',
            "features": [tricky(n) for n in range(400)], "after": {"a": [1, {"b": "}"}]}}
    (tmp_path / "one.geojson").write_text(json.dumps(docs, indent=indent, ensure_ascii=False) + ("\n\n" if indent else ""))
    (tmp_path / "empty.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "single.geojson").write_text(json.dumps(tricky(1000), indent=indent))
    (tmp_path / "two.geojson").write_text(json.dumps(tricky(1001)) + "\n" + json.dumps(tricky(1002)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = documents._fragments(spark, [str(tmp_path / "one.geojson")])
        assert parts.select("block").distinct().count() > 50
        rows = geojson.read_geojson(spark, str(tmp_path), layout).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((r.n, r.s) for r in rows) == sorted((n, tricky(n)["properties"]["s"]) for n in [*range(400), 1000, 1001, 1002])
    assert all(json.loads(r.deep) == tricky(0)["properties"]["deep"] and r.geometry for r in rows)
    firsts = [r.n for r in sorted(rows, key=lambda r: r["_fid"]) if r.n < 400]
    assert firsts == sorted(firsts)
    assert geojson.declared_srid(spark, str(tmp_path)) == 3857


@pytest.mark.parametrize("bad", ['{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":1},"geometry":null}',
                                 '{"type":"FeatureCollection","features":[null,{"type":"Feature"}]}', '{"type":"Feature"}}', "[1,2",
                                 '{"type":"Feature","properties":{"n":1},"geometry":null} trailing'])
def test_broken_documents_raise(spark, tmp_path, bad):
    (tmp_path / "a.geojson").write_text(bad)
    with pytest.raises(PySparkException):
        geojson.read_geojson(spark, str(tmp_path), "document", "n bigint").collect()
