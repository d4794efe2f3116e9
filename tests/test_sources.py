import json
import sqlite3
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from mapframe import BadRequest, read_spatial, sources
from mapframe.functions import codec, spatial
from mapframe.sources import geojson, geopackage, shapefile
from mapframe.streaming import arrow_stream


def wkt(df):
    return sorted(r[0] for r in df.select(spatial.st_astext("geometry")).collect() if r[0])


def test_names(tmp_path):
    assert sources.dataset_name("Roads.GeoJSON") == "Roads" and sources.dataset_name("a.txt") == "a.txt"
    assert sources.format_name("x.GPKG") == "GeoPackage" and sources.format_name("x.csv") == "Unknown"
    with pytest.raises(BadRequest):
        sources.confine(str(tmp_path / ".." / "x.shp"), str(tmp_path))


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"z": "007", "n": 1, "ok": True, "deep": {"a": [1]}},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"n": 2.5, "late": "x\n\"y\""}, "geometry": None},
        {"type": "Feature", "properties": None, "geometry": {"type": "MultiPoint", "coordinates": [[1, 2, 3], [4, 5, 6]]}},
    ]
    document = {"type": "FeatureCollection", "features": features}
    (tmp_path / "whole.geojson").write_text(json.dumps(document, indent=1))
    (tmp_path / "lines.geojson").write_text(
        '{"type": "FeatureCollection",\n"features": [\n' + ",\n".join(map(json.dumps, features)) + "\n]}\n")
    for name in ("whole.geojson", "lines.geojson"):
        df = read_spatial(spark, str(tmp_path / name))
        assert df.columns == ["_fid", "z", "n", "ok", "deep", "late", "geometry"]
        assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "string", "string", "binary"]
        rows = df.orderBy("_fid").collect()
        assert [r.z for r in rows] == ["007", None, None] and rows[1].late == 'x\n"y"' and rows[1].geometry is None
        assert wkt(df) == ["MULTIPOINT (1 2, 4 5)", "POLYGON ((0 0, 1 0, 1 1, 0 0))"]
        texts = [r.value for r in geojson.feature_text(df, "_fid").collect()]
        assert sorted(json.loads(t)["properties"]["n"] or 0 for t in texts) == [0, 1.0]
        assert '"z":"007"' in "".join(texts) and '"ok":true' in "".join(texts)
    (tmp_path / "broken.geojson").write_text(json.dumps(features[0]) + '\n{"type": "Feature",\n"geometry": null}\n')
    assert geojson.read_geojson(spark, str(tmp_path / "broken.geojson")).count() == 2  # one after the other, over lines
    with pytest.raises(Exception, match="not one feature per line"):
        geojson.read_geojson(spark, str(tmp_path / "broken.geojson"), "lines", "n double").collect()


def test_geojson_crs(spark, tmp_path):
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::28355"}},
           "features": []}
    (tmp_path / "p.geojson").write_text(json.dumps(doc))
    assert geojson.declared_srid(spark, str(tmp_path / "p.geojson")) == 28355


def test_kml(spark, tmp_path):
    ring = "<LinearRing><coordinates>{}</coordinates></LinearRing>"
    (tmp_path / "a.kml").write_text(
        '<?xml version="1.0"?><kml><Document>'
        "<Placemark><name>p</name><Point><coordinates>1,2,3</coordinates></Point></Placemark>"
        "<Placemark><name>l</name><LineString><coordinates>\n 0,0 1,1,5\n 2,0 </coordinates></LineString></Placemark>"
        "<Placemark><name>h</name><Polygon><outerBoundaryIs>" + ring.format("0,0 4,0 4,4 0,0") + "</outerBoundaryIs>"
        "<innerBoundaryIs>" + ring.format("2,1 3,1 3,2 2,1") + "</innerBoundaryIs></Polygon></Placemark>"
        "<Placemark><name>m</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point>"
        "<Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark></Document></kml>")
    df = read_spatial(spark, str(tmp_path / "a.kml"))
    assert wkt(df) == ["LINESTRING (0 0, 1 1, 2 0)", "MULTIPOINT (1 2, 3 4)", "POINT (1 2)",
                       "POLYGON ((0 0, 4 0, 4 4, 0 0), (2 1, 3 1, 3 2, 2 1))"]


def test_geoparquet(spark, tmp_path):
    meta = {"primary_column": "geometry", "columns": {"geometry": {"crs": {"id": {"authority": "EPSG", "code": 3857}}}}}
    table = pa.table({"n": [1], "geometry": pa.array([codec.encode((1, (1.0, 2.0)))], pa.binary())})
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(meta)}), tmp_path / "a.parquet")
    df, srid = sources.read_with_srid(spark, str(tmp_path / "a.parquet"))
    assert srid == 3857 and wkt(df) == ["POINT (1 2)"]


def test_geopackage(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.gpkg"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, geometry_type_name, srs_id, z, m)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom', 'POINT', 28355, 0, 0)")
    db.execute("CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom POINT, name TEXT, open BOOLEAN, width REAL)")
    for i in range(10):
        blob = b"GP\0" + bytes([1 | (1 << 1)]) + struct.pack("<i4d", 28355, i, i, i, i) + codec.encode((1, (float(i), 1.0)))
        db.execute("INSERT INTO roads VALUES (?, ?, ?, ?, ?)", (i + 1, blob if i else None, f"r{i}", i % 2, i / 2))
    db.commit()
    db.close()
    monkeypatch.setattr(geopackage, "ROWS_PER_TASK", 3)
    df, srid = sources.read_with_srid(spark, str(path))
    assert srid == 28355 and df.columns == ["fid", "name", "open", "width", "geom"]
    assert df.count() == 10 and df.rdd.getNumPartitions() == 4
    rows = df.orderBy("fid").collect()
    assert rows[0].geom is None and rows[3].open is True and rows[3].width == 1.5
    assert codec.parse(bytes(rows[3].geom)) == (1, (3.0, 1.0))


def shape_files(folder):
    """Two polygon records: one with a hole, one NULL shape."""
    outer = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    inner = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    xy = b"".join(struct.pack("<dd", *p) for p in outer + inner)
    first = struct.pack("<i4dii", 5, 0, 0, 4, 4, 2, 10) + struct.pack("<ii", 0, 5) + xy
    records, index, at = b"", b"", 100
    for n, content in enumerate((first, struct.pack("<i", 0)), 1):
        records += struct.pack(">ii", n, len(content) // 2) + content
        index += struct.pack(">ii", at // 2, len(content) // 2)
        at += 8 + len(content)

    def header(size):
        return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)

    (folder / "a.shp").write_bytes(header(100 + len(records)) + records)
    (folder / "a.shx").write_bytes(header(100 + len(index)) + index)
    fields = [(b"NAME", b"C", 6, 0), (b"POP", b"N", 8, 0), (b"RATE", b"N", 8, 2), (b"DAY", b"D", 8, 0), (b"OK", b"L", 1, 0)]
    descriptors = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([s, dec]) + b"\0" * 14 for n, k, s, dec in fields)
    rows = [b" " + b"alpha " + b"      12" + b"    1.50" + b"20240131" + b"T", b" " + b"      " + b" " * 8 + b" " * 8 + b" " * 8 + b"?"]
    head = struct.pack("<B3BIHH", 3, 24, 1, 1, 2, 33 + len(descriptors), len(rows[0])) + b"\0" * 20
    (folder / "a.dbf").write_bytes(head + descriptors + b"\r" + b"".join(rows) + b"\x1a")
    (folder / "a.prj").write_text('PROJCS["GDA_1994_MGA_Zone_55",GEOGCS["GCS_GDA_1994"]]')


def test_shapefile(spark, tmp_path, monkeypatch):
    shape_files(tmp_path)
    monkeypatch.setattr(shapefile, "RECORDS_PER_TASK", 1)
    df, srid = sources.read_with_srid(spark, str(tmp_path / "a.shp"))
    assert srid == 28355 and df.rdd.getNumPartitions() == 2
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "date", "boolean", "binary"]
    rows = sorted(df.collect(), key=lambda row: row.NAME is None)
    assert (rows[0].NAME, rows[0].POP, rows[0].RATE, str(rows[0].DAY), rows[0].OK) == ("alpha", 12, 1.5, "2024-01-31", True)
    assert tuple(rows[1])[:5] == (None,) * 5 and rows[1].geometry is None
    assert df.where("geometry is not null").select(spatial.st_area("geometry")).head()[0] == 15
    alone = tmp_path / "alone"
    alone.mkdir()
    (alone / "b.shp").write_bytes((tmp_path / "a.shp").read_bytes())
    assert read_spatial(spark, str(alone / "b.shp")).columns == ["geometry"]
    assert read_spatial(spark, str(alone / "b.shp")).count() == 2


def test_arrow_replace(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.sql("SELECT id, ST_Point(id, 1) AS geometry FROM range(100)").repartition(3)
    arrow_stream.write_arrow(df, path)
    arrow_stream.write_arrow(df.where("id < 10"), path, "overwrite")
    back = arrow_stream.read_arrow(spark, path)
    assert back.count() == 10 and wkt(back)[0] == "POINT (0 1)"
    name = next((tmp_path / "out").glob("*.arrows"))
    assert pa.ipc.open_stream(name.read_bytes()).schema.field("geometry").metadata
