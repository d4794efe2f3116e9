"""KML placemarks through Spark's XML reader; geometry text is built from column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial

_RING = "struct<LinearRing:struct<coordinates:string>>"
_LINE = "struct<coordinates:string>"
_POLYGON = f"struct<outerBoundaryIs:{_RING},innerBoundaryIs:array<{_RING}>>"
SCHEMA = (f"name string, description string, Point {_LINE}, LineString {_LINE}, Polygon {_POLYGON}, "
          f"MultiGeometry struct<Point:array<{_LINE}>,LineString:array<{_LINE}>,Polygon:array<{_POLYGON}>>, "
          "ExtendedData struct<Data:array<struct<_name:string,value:string>>,"
          "SchemaData:array<struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>>")


def _vertices(text: Column) -> Column:
    """``[[lon,lat],...]`` from ``lon,lat[,z] lon,lat[,z] ...``."""
    tuples = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    return F.concat(F.lit("["), F.array_join(F.transform(
        tuples, lambda t: F.concat(F.lit("["), F.substring_index(t, ",", 2), F.lit("]"))), ","), F.lit("]"))


def _geometry(kind: str, coordinates: Column) -> Column:
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coordinates, F.lit("}"))


def _point(p: Column) -> Column:
    return _geometry("Point", F.regexp_extract(_vertices(p["coordinates"]), r"^\[(\[[^\]]*\])", 1))


def _line(p: Column) -> Column:
    return _geometry("LineString", _vertices(p["coordinates"]))


def _polygon(p: Column) -> Column:
    shell = _vertices(p["outerBoundaryIs"]["LinearRing"]["coordinates"])
    holes = F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{_RING}>")),
                        lambda r: _vertices(r["LinearRing"]["coordinates"]))
    return _geometry("Polygon", F.concat(F.lit("["), F.array_join(F.concat(F.array(shell), holes), ","), F.lit("]")))


def _coordinates(text: Column) -> Column:
    return F.regexp_extract(text, r'"coordinates":(.*)\}$', 1)


def _attributes() -> Column:
    """Extended data by name; of equal names the last one counts."""
    empty = F.array().cast("array<struct<key:string,value:string>>")
    data = F.transform(F.col("ExtendedData.Data"), lambda d: F.struct(d["_name"].alias("key"), d["value"].alias("value")))
    simple = F.flatten(F.transform(F.col("ExtendedData.SchemaData"), lambda s: F.transform(
        s["SimpleData"], lambda d: F.struct(d["_name"].alias("key"), d["_VALUE"].alias("value")))))
    pairs = F.filter(F.concat(F.coalesce(data, empty), F.coalesce(simple, empty)), lambda p: p["key"].isNotNull())
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda found, p: F.map_concat(
        F.map_filter(found, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``description``, a text column for each name in the extended data, and ``geometry``.

    A MultiGeometry whose members are of one kind becomes a multipoint, multilinestring or multipolygon, any other a
    collection. Names of extended data are gathered in one aggregation; one that is taken already gets a ``_1``.
    """
    placemarks = spark.read.format("xml").option("rowTag", "Placemark").schema(SCHEMA).load(path)
    multi = F.col("MultiGeometry")

    def members(field, build):
        return F.coalesce(F.transform(multi[field], build), F.array().cast("array<string>"))

    kinds = {"Point": members("Point", _point), "LineString": members("LineString", _line),
             "Polygon": members("Polygon", _polygon)}
    every = F.concat(*kinds.values())
    gathered = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(every, ","), F.lit("]}"))
    for kind, found in kinds.items():
        alike = (F.size(found) == F.size(every)) & (F.size(found) > 0)
        joined = F.concat(F.lit("["), F.array_join(F.transform(found, _coordinates), ","), F.lit("]"))
        gathered = F.when(alike, _geometry(f"Multi{kind}", joined)).otherwise(gathered)
    text = (F.when(F.col("Point").isNotNull(), _point(F.col("Point")))
            .when(F.col("LineString").isNotNull(), _line(F.col("LineString")))
            .when(F.col("Polygon").isNotNull(), _polygon(F.col("Polygon")))
            .when(multi.isNotNull(), gathered))
    rows = placemarks.select("name", "description", _attributes().alias("_more"), text.alias("_text"))
    names = sorted(r.key for r in rows.select(F.explode("_more")).select("key").distinct().collect())
    taken = {"name", "description", "geometry", "_more", "_text"}
    more = [F.col("_more")[n].alias(n if n.lower() not in taken else f"{n}_1") for n in names]
    return rows.select("name", "description", *more, spatial.st_geomfromgeojson("_text").alias("geometry"))
