"""Attributes and shapes that the plain source tests do not have."""

import struct

import pytest

from mapframe import BadRequest, read_spatial
from mapframe.functions import spatial
from mapframe.sources import shapefile

TRIANGLE = ("<Polygon><outerBoundaryIs><LinearRing><coordinates>{0},0 {1},0 {0},1 {0},0</coordinates></LinearRing>"
            "</outerBoundaryIs></Polygon>")


def test_kml_multi_and_extended_data(spark, tmp_path):
    marks = [
        "<Placemark><name>a</name><ExtendedData><Data name='size'><value>3</value></Data><Data name='Name'>"
        "<value>other</value></Data></ExtendedData><MultiGeometry>" + TRIANGLE.format(0, 1) + TRIANGLE.format(5, 6)
        + "</MultiGeometry></Placemark>",
        "<Placemark><name>b</name><ExtendedData><SchemaData><SimpleData name='kind'>x y</SimpleData></SchemaData>"
        "</ExtendedData><MultiGeometry><LineString><coordinates>0,0 1,1</coordinates></LineString><Point><coordinates>3,4"
        "</coordinates></Point></MultiGeometry></Placemark>",
        "<Placemark><name>c</name><MultiGeometry><Point><coordinates>1,2,9</coordinates></Point></MultiGeometry></Placemark>"]
    (tmp_path / "a.kml").write_text("<kml><Document>" + "".join(marks) + "</Document></kml>")
    df = read_spatial(spark, str(tmp_path / "a.kml"))
    got = {r.name: r.asDict() for r in df.select("*", spatial.st_astext("geometry").alias("wkt")).collect()}
    assert got["a"]["wkt"].startswith("MULTIPOLYGON") and got["a"]["size"] == "3" and got["a"]["Name_1"] == "other"
    assert got["b"]["wkt"].startswith("GEOMETRYCOLLECTION") and got["b"]["kind"] == "x y" and got["b"]["size"] is None
    assert got["c"]["wkt"].startswith("MULTIPOINT")


def test_unknown_shapes_raise():
    assert shapefile.record_geometry(struct.pack("<i", 0)) is None
    for code in (31, 4, 99):
        with pytest.raises(BadRequest):
            shapefile.record_geometry(struct.pack("<i", code) + bytes(80))


def test_encoding_and_deleted_rows(spark, tmp_path):
    def field(name, size):
        return name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size, 0]) + bytes(14)

    rows = [(" ", "Zürich"), ("*", "gone"), (" ", "Köln")]
    body = b"".join(flag.encode() + name.encode("cp1252").ljust(10) for flag, name in rows)
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 24, 1, 1, 3, 65, 11) + bytes(20) + field("NAME", 10) + b"\r" + body)
    (tmp_path / "a.cpg").write_text("1252")
    points = [struct.pack("<idd", 1, float(i), 0.0) for i in range(3)]
    main, index, at = b"", b"", 50
    for i, p in enumerate(points):
        main += struct.pack(">ii", i + 1, len(p) // 2) + p
        index += struct.pack(">ii", at, len(p) // 2)
        at += 4 + len(p) // 2
    head = lambda n: struct.pack(">iiiiiii", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<ii", 1000, 1) + bytes(64)
    (tmp_path / "a.shp").write_bytes(head(at) + main)
    (tmp_path / "a.shx").write_bytes(head(50 + 4 * 3) + index)
    got = read_spatial(spark, str(tmp_path / "a.shp")).select("NAME", spatial.bounds("geometry")["xmin"].alias("x")).collect()
    assert sorted(map(tuple, got)) == [("Köln", 2.0), ("Zürich", 0.0)]
