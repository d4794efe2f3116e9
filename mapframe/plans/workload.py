"""Registered queries over derived features, each with its SQL twin.

``QUERIES`` maps names to functions of (session, data folder); ``ORACLES`` maps
the same names to SQL over the plain tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import color, crs, spatial
from ..functions.spatial import BBOX
from ..operators import asof, cluster, dissolve, features, joins, parts, profile, sqltext, style
from ..session import prepare, scratch_path
from ..sources import geojson, kml
from ..streaming import arrow_stream
from . import derived as d
from . import layers
from .catalog import Catalog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AUSTRALIA = (110.0, -45.0, 155.0, -10.0)
CUSTOMERS = d.sql_points("customer", "c_custkey")
EVENTS = d.sql_points("events", "event_id")
SUPPLIERS = d.sql_points("supplier", "s_suppkey")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def customers(spark, sf_dir):
    return d.key_points(spark, sf_dir, "customer", "c_custkey")


def suppliers(spark, sf_dir):
    return d.key_points(spark, sf_dir, "supplier", "s_suppkey")


def events(spark, sf_dir):
    return d.key_points(spark, sf_dir, "events", "event_id")


def r(column, digits=6):
    return F.round(column, digits)


# --- box filters, projection, attribute filters -----------------------------

@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, x AS lon, y AS lat
FROM p WHERE x BETWEEN 110 AND 155 AND y BETWEEN -45 AND -10""")
def bbox_filter_points(spark, sf_dir):
    found = features.bbox_filter(customers(spark, sf_dir), AUSTRALIA, points=True)
    return found.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                        F.col(BBOX[0]).alias("lon"), F.col(BBOX[1]).alias("lat"))


@query(f"""WITH p AS ({EVENTS}) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(x) AS west, max(y) AS north
FROM p WHERE x BETWEEN 110 AND 155 AND y BETWEEN -45 AND -10 GROUP BY event_type""")
def bbox_filter_events(spark, sf_dir):
    found = features.bbox_filter(events(spark, sf_dir), AUSTRALIA, points=True)
    return found.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"),
        F.min(BBOX[0]).alias("west"), F.max(BBOX[1]).alias("north"))


@query(f"""WITH s AS ({d.SQL_SEGMENTS}), c AS (
  SELECT l_orderkey, ax, ay, ex, ey, (ex - ax) * (-45 - ay) - (ey - ay) * (110 - ax) AS c1,
    (ex - ax) * (-45 - ay) - (ey - ay) * (155 - ax) AS c2, (ex - ax) * (-10 - ay) - (ey - ay) * (110 - ax) AS c3,
    (ex - ax) * (-10 - ay) - (ey - ay) * (155 - ax) AS c4 FROM s WHERE ex IS NOT NULL)
SELECT DISTINCT l_orderkey FROM c WHERE greatest(ax, ex) >= 110 AND least(ax, ex) <= 155 AND greatest(ay, ey) >= -45
  AND least(ay, ey) <= -10 AND NOT (c1 > 0 AND c2 > 0 AND c3 > 0 AND c4 > 0)
  AND NOT (c1 < 0 AND c2 < 0 AND c3 < 0 AND c4 < 0)""")
def bbox_filter_lines(spark, sf_dir):
    return features.bbox_filter(d.lines(spark, sf_dir), AUSTRALIA).select("l_orderkey")


@query(f"""WITH p AS ({d.SQL_DIAMONDS}) SELECT p_partkey FROM p
WHERE greatest(110 - px, 0, px - 155) / 1.5 + greatest(-45 - py, 0, py + 10) / 1.0 <= 1""")
def bbox_filter_polygons(spark, sf_dir):
    return features.bbox_filter(d.diamonds(spark, sf_dir), AUSTRALIA).select("p_partkey")


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE x END AS lon FROM p
WHERE c_custkey % 10 <> 0 AND x BETWEEN 110 AND 155 AND y BETWEEN -45 AND -10""")
def bbox_filter_null_geometry(spark, sf_dir):
    k = F.col("c_custkey")
    given = d.table(spark, sf_dir, "customer").withColumn("_fid", k)
    some = profile.points(given, F.when(k % 10 != 0, d.key_x(k)), d.key_y(k))
    return features.bbox_filter(some, AUSTRALIA, points=True).select("c_custkey", F.col(BBOX[0]).alias("lon"))


@query("""SELECT c_custkey, c_acctbal, c_mktsegment FROM customer
WHERE "c_acctbal" > 5000 AND (c_mktsegment LIKE 'B%' OR NOT c_nationkey BETWEEN 3 AND 20)
  AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name IS NOT NULL""")
def where_filter(spark, sf_dir):
    text = """"c_acctbal" > 5000 AND (c_mktsegment LIKE 'B%' OR NOT c_nationkey BETWEEN 3 AND 20)
        AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name IS NOT NULL"""
    return features.where_text(customers(spark, sf_dir), text).select("c_custkey", "c_acctbal", "c_mktsegment")


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
hex(ST_AsWKB(('POINT(' || x || ' ' || y || ')')::GEOMETRY)) AS geometry FROM p""")
def feature_projection(spark, sf_dir):
    shown = features.project(customers(spark, sf_dir))
    return shown.withColumn("geometry", F.hex("geometry"))


# --- order and paging ------------------------------------------------------

@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 25")
def features_page(spark, sf_dir):
    return features.page(customers(spark, sf_dir), 50, 25).select("c_custkey", "c_name")


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 40 OFFSET 7000")
def features_page_deep(spark, sf_dir):
    return features.page(events(spark, sf_dir), 40, 7000, near=0).select("event_id", "event_type", "value")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def row_positions(spark, sf_dir):
    numbered = features.with_position(d.table(spark, sf_dir, "orders").withColumn("_fid", F.col("o_orderkey")))
    return numbered.select("o_orderkey", F.col("_pos").alias("position"))


# 2^60 / 2^31 apart on average, and in an order of their own
SPARSE = "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) * 2654435761 % 1099511627689 * 1048573"


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {SPARSE}) - 1 AS position FROM lineitem")
def row_positions_sparse(spark, sf_dir):
    """Positions of keys that are spread over 2^60."""
    keyed = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(SPARSE).alias("_fid"))
    return features.with_position(keyed).select("l_orderkey", "l_linenumber", F.col("_pos").alias("position"))


@query(f"SELECT l_orderkey, l_linenumber, {SPARSE} AS key FROM lineitem ORDER BY key LIMIT 700 OFFSET 4321")
def features_page_sparse(spark, sf_dir):
    keyed = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(SPARSE).alias("key"))
    return features.page(keyed, 700, 4321, key="key", near=100, accuracy=100)


@query("""SELECT event_id, (SELECT count(*) FROM events) > 5000 AS truncated FROM events ORDER BY event_id LIMIT 5000""")
def features_cap(spark, sf_dir):
    """A request without a limit under a cap."""
    e = d.table(spark, sf_dir, "events")
    rows, truncated = features.cap_limit(None, e.count(), cap=5_000)
    return features.page(e.select("event_id"), rows, key="event_id").select("event_id", F.lit(truncated).alias("truncated"))


@query(f"""WITH s AS ({d.SQL_SEGMENTS}) SELECT l_orderkey, round(sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))), 6) AS length
FROM s WHERE ex IS NOT NULL GROUP BY l_orderkey ORDER BY length DESC, l_orderkey LIMIT 10""")
def topk_by_length(spark, sf_dir):
    measured = d.lines(spark, sf_dir).select("l_orderkey", r(spatial.st_length("geometry")).alias("length"))
    return measured.orderBy(F.desc("length"), "l_orderkey").limit(10)


# --- profile ---------------------------------------------------------------

@query(f"""WITH p AS ({EVENTS}) SELECT count(*) AS feature_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x,
max(y) AS max_y, 'point' AS geometry_type, 'POINT' AS all_types FROM p""")
def bounds_profile(spark, sf_dir):
    found = profile.profile(events(spark, sf_dir))
    return found.withColumn("all_types", F.array_join("all_types", ","))


@query(f"""WITH v AS ({d.SQL_VERTICES}) SELECT count(DISTINCT l_orderkey) AS feature_count, min(x) AS min_x, min(y) AS min_y,
max(x) AS max_x, max(y) AS max_y, 'linestring' AS geometry_type, 'LINESTRING' AS all_types FROM v WHERE vertices >= 2""")
def bounds_profile_lines(spark, sf_dir):
    found = profile.profile(d.lines(spark, sf_dir))
    return found.withColumn("all_types", F.array_join("all_types", ","))


@query(f"""WITH p AS (SELECT * FROM ({CUSTOMERS}) WHERE c_custkey % 10 <> 0)
SELECT (SELECT count(*) FROM customer) AS feature_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p""")
def bounds_null_geometry(spark, sf_dir):
    k = F.col("c_custkey")
    given = d.table(spark, sf_dir, "customer").withColumn("_fid", k)
    some = profile.points(given, F.when(k % 10 != 0, d.key_x(k)), d.key_y(k))
    return profile.profile(some).select("feature_count", "min_x", "min_y", "max_x", "max_y")


@query(f"""WITH v AS ({d.SQL_VERTICES}) SELECT l_orderkey, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
FROM v WHERE vertices >= 2 GROUP BY l_orderkey""")
def bbox_columns(spark, sf_dir):
    return d.lines(spark, sf_dir).select(
        "l_orderkey", *[F.col(b).alias(b.replace("_bbox_", "")) for b in BBOX])


@query(f"""WITH p AS ({CUSTOMERS}) SELECT 'customers' AS name, 'geometry' AS geometry_column, 'point' AS geometry_type, 4326 AS srid,
count(*) AS feature_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment,geometry' AS columns FROM p""")
def dataset_create(spark, sf_dir):
    catalog = Catalog(prepare(spark), scratch_path(spark))
    catalog.create(customers(spark, sf_dir), "customers")
    return _metadata(catalog)


@query("""SELECT 'tabular' AS name, CAST(NULL AS VARCHAR) AS geometry_column, 'unknown' AS geometry_type, 4326 AS srid, count(*) AS feature_count,
CAST(NULL AS DOUBLE) AS min_x, CAST(NULL AS DOUBLE) AS min_y, CAST(NULL AS DOUBLE) AS max_x, CAST(NULL AS DOUBLE) AS max_y,
'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders""")
def dataset_create_tabular(spark, sf_dir):
    catalog = Catalog(prepare(spark), scratch_path(spark))
    catalog.create(d.table(spark, sf_dir, "orders"), "tabular")
    return _metadata(catalog)


@query(f"""WITH p AS ({CUSTOMERS} WHERE c_acctbal > 0) SELECT 'rich' AS name, 'g' AS geometry_column, 'point' AS geometry_type,
4326 AS srid, count(*) AS feature_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
'c_custkey,g' AS columns FROM p""")
def dataset_from_sql(spark, sf_dir):
    catalog = Catalog(prepare(spark), scratch_path(spark))
    view = catalog.create(customers(spark, sf_dir), "customers").table_name
    made = catalog.create_from_sql(f"SELECT c_custkey, geometry AS g FROM {view} WHERE c_acctbal > 0;", "rich")
    return _metadata(catalog).where(F.col("name") == made.name)


def _metadata(catalog: Catalog) -> DataFrame:
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ",")
    return catalog.datasets().select(
        "name", "geometry_column", "geometry_type", "srid", "feature_count", "bounds.*", names.alias("columns"))


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, c_acctbal, x AS lon, y AS lat FROM p
WHERE x BETWEEN 110 AND 155 AND y BETWEEN -45 AND -10 ORDER BY c_custkey LIMIT 20 OFFSET 5""")
def dataset_features(spark, sf_dir):
    """Stored with neighbours together, then asked for one page of a box."""
    catalog = Catalog(prepare(spark), scratch_path(spark))
    made = catalog.create(customers(spark, sf_dir), "customers")
    page = catalog.features(made.id, 20, 5, AUSTRALIA).features
    box = spatial.bounds("geometry")
    return page.select("c_custkey", "c_acctbal", box["xmin"].alias("lon"), box["ymin"].alias("lat"))


@query("SELECT 1 AS datasets, count(*) AS rows_kept FROM customer")
def dataset_delete(spark, sf_dir):
    catalog = Catalog(prepare(spark), scratch_path(spark))
    kept = catalog.create(customers(spark, sf_dir), "kept")
    gone = catalog.create(suppliers(spark, sf_dir), "gone")
    catalog.delete(gone.id)
    restored = catalog.restore()
    return catalog.table(kept).agg(F.lit(len(restored)).alias("datasets"), F.count(F.lit(1)).alias("rows_kept"))


# --- files ------------------------------------------------------------------

@query(f"WITH p AS ({CUSTOMERS}) SELECT c_custkey, c_name, c_acctbal, x AS lon, y AS lat FROM p")
def geojson_round_trip(spark, sf_dir):
    path = scratch_path(prepare(spark)) + ".geojson"
    geojson.write_geojson(customers(spark, sf_dir).select("_fid", "c_custkey", "c_name", "c_acctbal", "geometry"), path)
    back = sources.read_spatial(spark, path)
    box = spatial.bounds("geometry")
    return back.select("c_custkey", "c_name", "c_acctbal", box["xmin"].alias("lon"), box["ymin"].alias("lat"))


@query(f"WITH p AS ({CUSTOMERS}) SELECT c_custkey, c_mktsegment, x AS lon, y AS lat FROM p")
def geoparquet_round_trip(spark, sf_dir):
    path = scratch_path(prepare(spark)) + ".parquet"
    features.project(customers(spark, sf_dir)).write.parquet(path)
    back = sources.read_spatial(spark, path)
    box = spatial.bounds("geometry")
    return back.select("c_custkey", "c_mktsegment", box["xmin"].alias("lon"), box["ymin"].alias("lat"))


@query(f"""WITH v AS ({d.SQL_VERTICES}) SELECT l_orderkey, count(*) AS vertices, round(sum(x), 6) AS sum_x
FROM v WHERE vertices >= 2 GROUP BY l_orderkey""")
def arrow_round_trip(spark, sf_dir):
    path = scratch_path(prepare(spark)) + ".arrows"
    arrow_stream.write_arrow(d.lines(spark, sf_dir).select("l_orderkey", "geometry"), path, "overwrite")
    back = arrow_stream.read_arrow(spark, path)
    rings = parts.explode_rings(back)
    return rings.select("l_orderkey", F.size("xs").cast("bigint").alias("vertices"),
                        r(F.aggregate("xs", F.lit(0.0), lambda a, v: a + v)).alias("sum_x"))


@query(f"WITH p AS ({SUPPLIERS}) SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS description, x AS lon, y AS lat FROM p")
def kml_round_trip(spark, sf_dir):
    path = scratch_path(prepare(spark)) + ".kml"
    placemark = F.format_string(
        "<Placemark><name>%s</name><description>%d</description><Point><coordinates>%s,%s,0</coordinates></Point></Placemark>",
        "s_name", "s_nationkey", F.col(BBOX[0]).cast("string"), F.col(BBOX[1]).cast("string"))
    def document(batches):
        yield pd.DataFrame({"value": ["<kml><Document>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</Document></kml>"]})

    lines = suppliers(spark, sf_dir).select(placemark.alias("value"))
    lines.mapInPandas(document, "value string").write.text(path)
    back = kml.read_kml(spark, path)
    box = spatial.bounds("geometry")
    return back.select("name", "description", box["xmin"].alias("lon"), box["ymin"].alias("lat"))


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, '{{"type":"Feature","id":' || c_custkey || ',"geometry":{{"type":"Point","coordinates":[' || x || ',' || y
|| ']}},"properties":{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","rich":' || (c_acctbal > 0)::VARCHAR || '}}}}' AS feature
FROM p WHERE c_custkey % 10 <> 0""")
def geojson_features(spark, sf_dir):
    """Positions count every row; rows without geometry are left out."""
    k = F.col("c_custkey")
    given = d.table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("rich"))
    some = profile.points(given.withColumn("_fid", k), F.when(k % 10 != 0, d.key_x(k)), d.key_y(k))
    text = geojson.feature_text(features.with_position(some), "_pos")
    return text.select(F.col("_pos").alias("c_custkey"), F.col("value").alias("feature"))


# --- spatial functions -------------------------------------------------------

@query(f"""WITH p AS ({CUSTOMERS}), g AS (SELECT c_custkey, ('POINT(' || x || ' ' || y || ')')::GEOMETRY AS g FROM p)
SELECT c_custkey, ST_AsText(g) AS wkt, CAST(ST_AsGeoJSON(g) AS VARCHAR) AS geojson, hex(ST_AsWKB(g)) AS wkb FROM g""")
def point_text(spark, sf_dir):
    return customers(spark, sf_dir).select(
        "c_custkey", spatial.st_astext("geometry").alias("wkt"), spatial.st_asgeojson("geometry").alias("geojson"),
        F.hex(spatial.st_aswkb("geometry")).alias("wkb"))


@query(f"""WITH v AS ({d.SQL_VERTICES}), g AS (
SELECT l_orderkey, ('LINESTRING(' || string_agg(x || ' ' || y, ', ' ORDER BY seq) || ')')::GEOMETRY AS g
FROM v WHERE vertices >= 2 GROUP BY l_orderkey)
SELECT l_orderkey, ST_AsText(g) AS wkt, CAST(ST_AsGeoJSON(g) AS VARCHAR) AS geojson, md5(hex(ST_AsWKB(g))) AS wkb FROM g""")
def line_text(spark, sf_dir):
    return d.lines(spark, sf_dir).select(
        "l_orderkey", spatial.st_astext("geometry").alias("wkt"), spatial.st_asgeojson("geometry").alias("geojson"),
        F.md5(F.hex("geometry")).alias("wkb"))


@query("""SELECT 'POINT' AS geometry_type, 0 AS srid, (SELECT count(*) FROM customer) AS n
UNION ALL SELECT 'POLYGON', 0, (SELECT count(*) FROM part)
UNION ALL SELECT 'LINESTRING', 0, count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)""")
def geometry_types(spark, sf_dir):
    every = (customers(spark, sf_dir).select("geometry").union(d.diamonds(spark, sf_dir).select("geometry"))
             .union(d.lines(spark, sf_dir).select("geometry")))
    return every.groupBy(spatial.st_geometrytype("geometry").alias("geometry_type"),
                         spatial.st_srid("geometry").alias("srid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS ({d.SQL_SEGMENTS}) SELECT l_orderkey, round(sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))), 6) AS length,
0.0::DOUBLE AS area FROM s WHERE ex IS NOT NULL GROUP BY l_orderkey""")
def line_length(spark, sf_dir):
    return d.lines(spark, sf_dir).select("l_orderkey", r(spatial.st_length("geometry")).alias("length"),
                                         spatial.st_area("geometry").alias("area"))


@query(f"""WITH p AS ({d.SQL_DIAMONDS}) SELECT p_partkey, 3.0::DOUBLE AS area, round(px, 6) AS cx, round(py, 6) AS cy,
round(px - 1.5, 6) AS west, round(py + 1, 6) AS north, 0.0::DOUBLE AS length FROM p""")
def polygon_measures(spark, sf_dir):
    center = spatial.bounds(spatial.st_centroid("geometry"))
    box = spatial.bounds(spatial.st_envelope("geometry"))
    return d.diamonds(spark, sf_dir).select(
        "p_partkey", r(spatial.st_area("geometry")).alias("area"), r(center["xmin"]).alias("cx"),
        r(center["ymin"]).alias("cy"), r(box["xmin"]).alias("west"), r(box["ymax"]).alias("north"),
        spatial.st_length("geometry").alias("length"))


@query(f"""WITH s AS (SELECT *, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS w FROM ({d.SQL_SEGMENTS}) WHERE ex IS NOT NULL)
SELECT l_orderkey, round(CASE WHEN sum(w) > 0 THEN sum(w * (ax + ex) / 2) / sum(w) ELSE max(ax) END, 6) AS cx,
round(CASE WHEN sum(w) > 0 THEN sum(w * (ay + ey) / 2) / sum(w) ELSE max(ay) END, 6) AS cy FROM s GROUP BY l_orderkey""")
def line_centroid(spark, sf_dir):
    center = spatial.bounds(spatial.st_centroid("geometry"))
    return d.lines(spark, sf_dir).select("l_orderkey", r(center["xmin"]).alias("cx"), r(center["ymin"]).alias("cy"))


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, round(sqrt(greatest(110 - x, 0, x - 155) ** 2 + greatest(-45 - y, 0, y + 10) ** 2), 6) AS distance,
x BETWEEN 110 AND 155 AND y BETWEEN -45 AND -10 AS touches, x > 110 AND x < 155 AND y > -45 AND y < -10 AS inside FROM p""")
def point_box_relations(spark, sf_dir):
    box = spatial.st_makeenvelope(*AUSTRALIA)
    return customers(spark, sf_dir).select(
        "c_custkey", r(spatial.st_distance("geometry", box)).alias("distance"),
        spatial.st_intersects("geometry", box).alias("touches"), spatial.st_within("geometry", box).alias("inside"))


@query(f"""WITH s AS ({d.SQL_SEGMENTS} QUALIFY lead(x) OVER w IS NOT NULL), t AS (
SELECT *, CASE WHEN ex = ax AND ey = ay THEN 0 ELSE least(1, greatest(0, ((20 - ax) * (ex - ax) + (30 - ay) * (ey - ay))
  / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) END AS t FROM s)
SELECT l_orderkey, round(min(sqrt((20 - ax - t * (ex - ax)) ** 2 + (30 - ay - t * (ey - ay)) ** 2)), 6) AS distance FROM t GROUP BY l_orderkey""")
def line_point_distance(spark, sf_dir):
    place = spatial.st_point(20.0, 30.0)
    return d.lines(spark, sf_dir).select("l_orderkey", r(spatial.st_distance("geometry", place)).alias("distance"))


@query(f"""WITH b AS ({d.SQL_BOXES}), o AS (SELECT s_suppkey, greatest(0, least(x1, ex + 2 + 4) - greatest(x0, ex + 2 - 4)) AS w,
greatest(0, least(y1, ey + 1 + 3) - greatest(y0, ey + 1 - 3)) AS h FROM b)
SELECT s_suppkey, round(48 - w * h, 6) AS only_first, round(96 - w * h, 6) AS either FROM o""")
def polygon_overlay(spark, sf_dir):
    """Difference and union of each box with the same box moved by (2, 1)."""
    x, y = d.key_x(F.col("s_suppkey")) + 2, d.key_y(F.col("s_suppkey")) + 1
    moved = d.boxes(spark, sf_dir).withColumn(
        "other", spatial.st_makeenvelope(x - d.BOX_W, y - d.BOX_H, x + d.BOX_W, y + d.BOX_H))
    return moved.select(
        "s_suppkey", r(spatial.st_area(spatial.st_difference("geometry", "other"))).alias("only_first"),
        r(spatial.st_area(spatial.st_union("geometry", "other"))).alias("either"))


@query(f"""SELECT c_custkey, round(32 * 0.5 * 4 * sin(2 * pi() / 32), 6) AS area, round({d.sql_x('c_custkey')} + 2, 6) AS east FROM customer""")
def point_buffer(spark, sf_dir):
    ring = customers(spark, sf_dir).withColumn("ring", spatial.st_buffer("geometry", 2.0))
    return ring.select("c_custkey", r(spatial.st_area("ring")).alias("area"),
                       r(spatial.bounds("ring")["xmax"]).alias("east"))


@query(f"""WITH s AS (SELECT l_orderkey, ax, ay, ex, ey, sqrt((ex - ax) ** 2 + (ey - ay) ** 2) AS w FROM ({d.SQL_SEGMENTS})
WHERE ex IS NOT NULL), one AS (SELECT l_orderkey, max(w) AS w FROM s GROUP BY l_orderkey HAVING count(*) = 1 AND max(w) > 0)
SELECT l_orderkey, round(2 * w + 32 * 0.5 * sin(2 * pi() / 32), 6) AS area FROM one""")
def line_buffer(spark, sf_dir):
    """Two-vertex lines: a rectangle with two half circles of 16 segments."""
    two = parts.explode_rings(d.lines(spark, sf_dir).withColumn("line", F.col("geometry"))).where(F.size("xs") == 2)
    drawn = two.where((F.col("xs")[0] != F.col("xs")[1]) | (F.col("ys")[0] != F.col("ys")[1]))
    return drawn.select("l_orderkey", r(spatial.st_area(spatial.st_buffer("line", 1.0))).alias("area"))


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, round(x * pi() / 180 * 6378137, 3) AS mx,
round(ln(tan(pi() / 4 + y * pi() / 360)) * 6378137, 3) AS my, round(x, 6) AS back_x, round(y, 6) AS back_y FROM p""")
def transform_mercator(spark, sf_dir):
    there = spatial.st_transform("geometry", "EPSG:4326", "EPSG:3857")
    moved = customers(spark, sf_dir).withColumn("there", there)
    a, b = spatial.bounds("there"), spatial.bounds(spatial.st_transform("there", "EPSG:3857", "EPSG:4326"))
    return moved.select("c_custkey", r(a["xmin"], 3).alias("mx"), r(a["ymin"], 3).alias("my"),
                        r(b["xmin"]).alias("back_x"), r(b["ymin"]).alias("back_y"))


def _zone_sql() -> str:
    """Conformal series of a southern zone with central meridian 147, in SQL."""
    f = 1 / crs.WGS84[1]
    n = f / (2 - f)
    e = (f * (2 - f)) ** 0.5
    scale = 0.9996 * crs.WGS84[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [sum(c * n**p for p, c in row.items()) for row in crs.ALPHA]
    xi = " + ".join(["xi"] + [f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1)])
    eta = " + ".join(["eta"] + [f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1)])
    return f"""WITH p AS (SELECT c_custkey, 147 + {d.sql_x('c_custkey')} / 60 AS lon, {d.sql_y('c_custkey')} / 2 - 43 AS lat FROM customer),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 147) AS l FROM p),
z AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM t)
SELECT c_custkey, round(500000 + {scale!r}::DOUBLE * ({eta}), 3) AS easting, round(10000000 + {scale!r}::DOUBLE * ({xi}), 3) AS northing,
round(lon, 6) AS lon, round(lat, 6) AS lat FROM z"""


@query(_zone_sql())
def transform_zone(spark, sf_dir):
    k = F.col("c_custkey")
    lon, lat = d.key_x(k) / 60 + 147, d.key_y(k) / 2 - 43
    east, north = crs.transform_xy(lon, lat, 4326, 32755)
    moved = d.table(spark, sf_dir, "customer").select("c_custkey", east.alias("e"), north.alias("n"))
    back = crs.transform_xy(F.col("e"), F.col("n"), 32755, 4326)
    return moved.select("c_custkey", r(F.col("e"), 3).alias("easting"), r(F.col("n"), 3).alias("northing"),
                        r(back[0]).alias("lon"), r(back[1]).alias("lat"))


def _albers_sql() -> str:
    """The equal-area formulas for 132 E, parallels 18 and 36 S, and the polar ones for true scale at 71 S, in SQL."""
    e, w = "0.0818191910428158::DOUBLE", "0.0818191908426215::DOUBLE"

    def q(phi):
        return f"((1 - {e} ** 2) * (sin({phi}) / (1 - ({e} * sin({phi})) ** 2) + atanh({e} * sin({phi})) / {e}))"

    def m2(phi):
        return f"(cos({phi}) ** 2 / (1 - ({e} * sin({phi})) ** 2))"

    def t(phi):
        return f"exp(-(atanh(sin({phi})) - {w} * atanh({w} * sin({phi}))))"

    one, two, true = "radians(-18::DOUBLE)", "radians(-36::DOUBLE)", "radians(71::DOUBLE)"
    return f"""WITH p AS (SELECT c_custkey, 132 + {d.sql_x('c_custkey')} / 9 AS lon, {d.sql_y('c_custkey')} / 4 - 40 AS lat FROM customer),
k AS (SELECT ({m2(one)} - {m2(two)}) / ({q(two)} - {q(one)}) AS n), c AS (SELECT n, {m2(one)} + n * {q(one)} AS c FROM k),
z AS (SELECT *, 6378137 * sqrt(c - n * {q('radians(lat)')}) / n AS rho, 6378137 * sqrt(c) / n AS top, n * radians(lon - 132) AS theta,
  6378137 * cos({true}) / sqrt(1 - ({w} * sin({true})) ** 2) * {t('radians(-lat)')} / {t(true)} AS polar FROM p, c)
SELECT c_custkey, round(rho * sin(theta), 3) AS east, round(top - rho * cos(theta), 3) AS north, round(polar * sin(radians(lon)), 3) AS px,
round(polar * cos(radians(lon)), 3) AS py, round(lon, 6) AS lon, round(lat, 6) AS lat FROM z"""


@query(_albers_sql())
def transform_conic_polar(spark, sf_dir):
    """Equal-area and polar coordinates of points, and the way back, all as geometries."""
    k = F.col("c_custkey")
    place = spatial.st_point(d.key_x(k) / 9 + 132, d.key_y(k) / 4 - 40)
    rows = d.table(spark, sf_dir, "customer").select("c_custkey", place.alias("g"))
    rows = rows.select("c_custkey", spatial.st_transform("g", 4326, 3577).alias("a"), spatial.st_transform("g", 4326, 3031).alias("b"))
    a, b, back = (spatial.bounds(c) for c in ("a", "b", spatial.st_transform(spatial.st_transform("a", 3577, 3031), 3031, 4326)))
    return rows.select("c_custkey", r(a["xmin"], 3).alias("east"), r(a["ymin"], 3).alias("north"), r(b["xmin"], 3).alias("px"),
                       r(b["ymin"], 3).alias("py"), r(back["xmin"]).alias("lon"), r(back["ymin"]).alias("lat"))


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, round(x, 6) AS lon, round(y, 6) AS lat, 4326 AS srid FROM p""")
def dataset_reproject(spark, sf_dir):
    """A projected source ends up in lon/lat."""
    there = spatial.st_transform("geometry", "EPSG:4326", "EPSG:3857")
    source = customers(spark, sf_dir).select("c_custkey", there.alias("geometry"))
    ready, srid = profile.prepare_features(source, "geometry", 3857)
    return ready.select("c_custkey", r(F.col(BBOX[0])).alias("lon"), r(F.col(BBOX[1])).alias("lat"),
                        F.lit(srid).alias("srid"))


# --- joins -------------------------------------------------------------------

PIP = f"""WITH p AS ({CUSTOMERS}), t AS ({d.SQL_TRIANGLES}), j AS (SELECT * FROM t JOIN p ON {d.SQL_IN_TRIANGLE})"""


@query(f"""{PIP} SELECT n_name, count(*) AS n, min(x) AS west, max(y) AS north, round(sum(c_acctbal), 4) AS balance FROM j GROUP BY n_name""")
def join_points_in_polygons(spark, sf_dir):
    joined = joins.spatial_join(customers(spark, sf_dir), d.triangles(spark, sf_dir), "intersects")
    return joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.min(BBOX[0]).alias("west"), F.max(BBOX[1]).alias("north"),
        r(F.sum("c_acctbal"), 4).alias("balance"))


@query(f"""WITH p AS ({CUSTOMERS}), b AS ({d.SQL_BOXES}) SELECT c_custkey, s_suppkey FROM p JOIN b
ON x > x0 AND x < x1 AND y > y0 AND y < y1""")
def join_within_boxes(spark, sf_dir):
    return joins.spatial_join(customers(spark, sf_dir), d.boxes(spark, sf_dir), "within").select("c_custkey", "s_suppkey")


@query(f"""WITH p AS ({d.SQL_DIAMONDS}), b AS ({d.SQL_BOXES}) SELECT p_partkey, s_suppkey FROM p JOIN b
ON greatest(x0 - px, 0, px - x1) / 1.5 + greatest(y0 - py, 0, py - y1) / 1.0 <= 1""")
def join_polygons(spark, sf_dir):
    return joins.spatial_join(d.diamonds(spark, sf_dir), d.boxes(spark, sf_dir), "intersects").select("p_partkey", "s_suppkey")


@query(f"""WITH p AS ({d.SQL_DIAMONDS}), b AS ({d.SQL_BOXES}) SELECT p_partkey, s_suppkey FROM p JOIN b
ON greatest(x0 - px, 0, px - x1) / 1.5 + greatest(y0 - py, 0, py - y1) / 1.0 <= 1""")
def join_polygons_shuffled(spark, sf_dir):
    """The plan for two large sides: shuffled on cells, crowded cells split."""
    joined = joins.spatial_join(d.diamonds(spark, sf_dir), d.boxes(spark, sf_dir), "intersects", broadcast_bytes=0)
    return joined.select("p_partkey", "s_suppkey")


@query(f"""WITH p AS ({d.SQL_DIAMONDS}), b AS ({d.SQL_BOXES}) SELECT p_partkey, s_suppkey FROM p JOIN b
ON px - 1.5 >= x0 AND px + 1.5 <= x1 AND py - 1 >= y0 AND py + 1 <= y1""")
def join_polygons_within(spark, sf_dir):
    return joins.spatial_join(d.diamonds(spark, sf_dir), d.boxes(spark, sf_dir), "within").select("p_partkey", "s_suppkey")


@query(f"""WITH p AS ({CUSTOMERS}), t AS ({d.SQL_TRIANGLES}), b AS ({d.SQL_BOXES})
SELECT n_name, s_suppkey, count(*) AS n, round(sum(c_acctbal), 4) AS balance FROM p JOIN t ON {d.SQL_IN_TRIANGLE.replace("x0", "t.x0").replace("y0", "t.y0")}
JOIN b ON x > b.x0 AND x < b.x1 AND y > b.y0 AND y < b.y1 AND c_custkey % 3 > 0 GROUP BY n_name, s_suppkey""")
def sql_spatial_join(spark, sf_dir):
    """Joins on spatial predicates in SQL text, as grid joins."""
    for name, df in (("mf_points", customers(spark, sf_dir)), ("mf_triangles", d.triangles(spark, sf_dir)),
                     ("mf_boxes", d.boxes(spark, sf_dir))):
        df.select(*[c for c in df.columns if not c.startswith("_")]).createOrReplaceTempView(name)
    return sqltext.query(spark, """SELECT n_name, s_suppkey, count(*) AS n, round(sum(c_acctbal), 4) AS balance
        FROM mf_points p JOIN mf_triangles t ON ST_Intersects(p.geometry, t.geometry), mf_boxes b
        WHERE ST_Within(p.geometry, b.geometry) AND c_custkey % 3 > 0 GROUP BY n_name, s_suppkey""")


@query(f"""WITH p AS ({CUSTOMERS}), b AS ({SUPPLIERS}) SELECT p.c_custkey, count(b.s_suppkey) AS near
FROM p LEFT JOIN b ON (p.x - b.x) ** 2 + (p.y - b.y) ** 2 <= 6.003 * 6.003 GROUP BY p.c_custkey""")
def sql_spatial_left_join(spark, sf_dir):
    for name, df in (("mf_points", customers(spark, sf_dir)), ("mf_places", suppliers(spark, sf_dir))):
        df.select(*[c for c in df.columns if not c.startswith("_")]).createOrReplaceTempView(name)
    return sqltext.query(spark, """SELECT c_custkey, count(s_suppkey) AS near FROM mf_points p
        LEFT JOIN mf_places b ON ST_Distance(p.geometry, b.geometry) <= 6.003 GROUP BY c_custkey""")


@query(f"""WITH a AS ({CUSTOMERS}), b AS ({SUPPLIERS}) SELECT c_custkey, s_suppkey, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance
FROM a JOIN b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 5.003 * 5.003""")
def join_distance(spark, sf_dir):
    joined = joins.spatial_join(customers(spark, sf_dir), suppliers(spark, sf_dir), "distance", distance=5.003)
    gap = F.hypot(F.col(BBOX[0]) - F.col(BBOX[0] + "_right"), F.col(BBOX[1]) - F.col(BBOX[1] + "_right"))
    return joined.select("c_custkey", "s_suppkey", r(gap).alias("distance"))


@query(f"""WITH p AS ({CUSTOMERS}), b AS ({d.SQL_BOXES}) SELECT c_custkey, s_suppkey FROM p LEFT JOIN b
ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1""")
def join_left(spark, sf_dir):
    joined = joins.spatial_join(customers(spark, sf_dir), d.boxes(spark, sf_dir), "intersects", "left")
    return joined.select("c_custkey", "s_suppkey")


@query(f"""WITH p AS ({CUSTOMERS}), t AS ({d.SQL_TRIANGLES}) SELECT c_custkey FROM p WHERE EXISTS (SELECT 1 FROM t WHERE {d.SQL_IN_TRIANGLE})""")
def join_semi(spark, sf_dir):
    return joins.spatial_join(customers(spark, sf_dir), d.triangles(spark, sf_dir), "intersects", "left_semi").select("c_custkey")


@query(f"""WITH p AS ({CUSTOMERS}), t AS ({d.SQL_TRIANGLES}) SELECT c_custkey FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE {d.SQL_IN_TRIANGLE})""")
def join_anti(spark, sf_dir):
    return joins.spatial_join(customers(spark, sf_dir), d.triangles(spark, sf_dir), "intersects", "left_anti").select("c_custkey")


@query("""SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT c_custkey) AS buyers
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def equi_join(spark, sf_dir):
    joined = customers(spark, sf_dir).join(d.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), r(F.sum("o_totalprice"), 2).alias("total"),
        F.countDistinct("c_custkey").alias("buyers"))


@query("""SELECT 'left' AS kind, count(*) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49
UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM lineitem WHERE l_quantity > 49) RIGHT JOIN supplier ON s_suppkey = l_suppkey
UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey
UNION ALL SELECT 'semi', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def join_kinds(spark, sf_dir):
    s, c = d.table(spark, sf_dir, "supplier"), d.table(spark, sf_dir, "customer")
    big = d.table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    dear = d.table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    by_supplier, by_customer = s["s_suppkey"] == big["l_suppkey"], c["c_custkey"] == dear["o_custkey"]
    found = {"left": s.join(big, by_supplier, "left"), "right": big.join(s, by_supplier, "right"),
             "full": c.join(dear, by_customer, "full"), "semi": c.join(dear, by_customer, "left_semi"),
             "anti": c.join(dear, by_customer, "left_anti")}
    rows = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, df in found.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.union(row)
    return out


@query("""WITH buys AS (SELECT * FROM events WHERE event_type = 'purchase'), clicks AS (SELECT * FROM events WHERE event_type = 'click')
SELECT b.event_id, b.user_id, c.event_id AS click_id FROM buys b ASOF LEFT JOIN clicks c ON b.user_id = c.user_id AND b.ts >= c.ts""")
def asof_join(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    found = asof.asof_join(buys, clicks, "user_id", "ts", "event_id")
    return found.select("event_id", "user_id", F.col("latest.value").alias("click_id"))


@query("""WITH e AS (SELECT event_id, event_type, TIMESTAMP '2024-01-01' + to_microseconds((event_id * 7919) % 3600000000) AS at FROM events)
SELECT b.event_id, c.event_id AS click_id FROM (SELECT * FROM e WHERE event_type <> 'click') b
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON b.at >= c.at""")
def asof_join_hot(spark, sf_dir):
    """All events under one key, within one hour."""
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01T00:00:00Z").cast("timestamp")) + (F.col("event_id") * 7919) % 3_600_000_000)
    e = d.table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(1).alias("one"), at.alias("at"))
    found = asof.asof_join(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), "one", "at", "event_id")
    return found.select("event_id", F.col("latest.value").alias("click_id"))


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id,
CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events),
clicks AS (SELECT user_id, ts, max(event_id) AS event_id FROM e WHERE event_type = 'click' GROUP BY ALL)
SELECT b.event_id, b.user_id, c.event_id AS click_id
FROM (SELECT * FROM e WHERE event_type <> 'click') b ASOF LEFT JOIN clicks c ON b.user_id = c.user_id AND b.ts >= c.ts""")
def asof_join_null_keys(spark, sf_dir):
    """NULL keys and NULL times match nothing."""
    e = d.table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    found = asof.asof_join(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), "user_id", "ts", "event_id")
    return found.select("event_id", "user_id", F.col("latest.value").alias("click_id"))


@query("""SELECT n_name, count(*) AS n FROM events JOIN nation ON value >= n_nationkey * 4 AND value < n_nationkey * 4 + 4 GROUP BY n_name""")
def range_join(spark, sf_dir):
    """A range join as an equi-join on the band number."""
    e = d.table(spark, sf_dir, "events").withColumn("band", F.floor(F.col("value") / 4))
    n = d.table(spark, sf_dir, "nation")
    return e.join(n, F.col("band") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates, windows, sets -------------------------------------------------

@query('SELECT CAST(min(c_acctbal) AS DOUBLE) AS "min", CAST(max(c_acctbal) AS DOUBLE) AS "max" FROM customer')
def column_range(spark, sf_dir):
    return features.column_range(customers(spark, sf_dir), "c_acctbal")


@query("SELECT DISTINCT p_brand AS val FROM part WHERE p_brand IS NOT NULL ORDER BY val LIMIT 10")
def unique_values(spark, sf_dir):
    return features.unique_values(d.table(spark, sf_dir, "part"), "p_brand", 10)


@query("""SELECT min(value) AS "min", max(value) AS "max", count(value) AS non_null, count(DISTINCT value) AS distinct_values FROM events""")
def style_statistics(spark, sf_dir):
    return style.style_statistics(events(spark, sf_dir), "value")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY ALL""")
def group_aggregates(spark, sf_dir):
    li = d.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-01-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), r(F.avg("l_discount")).alias("discount"),
        r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(grouping(c_nationkey) AS INT) AS g FROM customer
GROUP BY ROLLUP (c_nationkey, c_mktsegment)""")
def rollup(spark, sf_dir):
    return d.table(spark, sf_dir, "customer").rollup("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("c_nationkey").cast("int").alias("g"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube(spark, sf_dir):
    return d.table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def grouping_sets(spark, sf_dir):
    d.table(spark, sf_dir, "lineitem").createOrReplaceTempView("mf_lineitem")
    return spark.sql("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM mf_lineitem
        GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")


@query("""SELECT count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem""")
def approximate_distinct(spark, sf_dir):
    li = d.table(spark, sf_dir, "lineitem")
    both = li.agg(F.countDistinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    return both.select("exact", (F.abs(F.col("about") / F.col("exact") - 1) < 0.1).alias("close"))


@query("""SELECT c_nationkey, c_custkey, c_acctbal, CAST(rk AS BIGINT) AS place FROM (SELECT *, row_number() OVER
(PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) WHERE rk <= 3""")
def window_topk(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = d.table(spark, sf_dir, "customer").withColumn("place", F.row_number().over(w)).where("place <= 3")
    return ranked.select("c_nationkey", "c_custkey", "c_acctbal", F.col("place").cast("bigint").alias("place"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_quantity) OVER w, 2) AS so_far, CAST(count(*) OVER w AS BIGINT) AS lines
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def window_running(spark, sf_dir):
    w = (Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.sum("l_quantity").over(w), 2).alias("so_far"),
        F.count(F.lit(1)).over(w).alias("lines"))


@query("""SELECT 'union' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""")
def set_operations(spark, sf_dir):
    c = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    found = {"union": c.union(o).distinct(), "union_all": c.union(o), "intersect": c.intersect(o),
             "except": c.subtract(o), "except_all": o.exceptAll(c)}
    rows = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, df in found.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.union(row)
    return out


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_nationkey, ST_AsText(('MULTIPOINT(' || string_agg(x || ' ' || y, ', ' ORDER BY x, y) || ')')::GEOMETRY) AS wkt
FROM (SELECT DISTINCT c_nationkey, x, y FROM p) GROUP BY c_nationkey""")
def dissolve_points(spark, sf_dir):
    merged = dissolve.dissolve_points(customers(spark, sf_dir), ["c_nationkey"])
    return merged.select("c_nationkey", spatial.st_astext("geometry").alias("wkt"))


@query(f"""WITH b AS ({d.SQL_BOXES}), xs AS (SELECT DISTINCT s_nationkey, unnest([x0, x1]) AS x FROM b),
ys AS (SELECT DISTINCT s_nationkey, unnest([y0, y1]) AS y FROM b),
sx AS (SELECT s_nationkey, x, lead(x) OVER (PARTITION BY s_nationkey ORDER BY x) AS xn FROM xs),
sy AS (SELECT s_nationkey, y, lead(y) OVER (PARTITION BY s_nationkey ORDER BY y) AS yn FROM ys)
SELECT s_nationkey, round(sum((xn - x) * (yn - y)), 4) AS area FROM sx JOIN sy USING (s_nationkey)
WHERE xn IS NOT NULL AND yn IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE b.s_nationkey = sx.s_nationkey
  AND x0 <= x AND x1 >= xn AND y0 <= y AND y1 >= yn) GROUP BY s_nationkey""")
def dissolve_polygons(spark, sf_dir):
    merged = dissolve.dissolve_polygons(d.boxes(spark, sf_dir), ["s_nationkey"])
    return merged.select("s_nationkey", r(spatial.st_area("geometry"), 4).alias("area"))


# Every segment counts without what earlier ones on its line cover. Coordinates times 2^52 are whole numbers, so the test for
# one line is exact; the first one only spares work.
@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY k, x, y, u, v) AS id, (x * 2 ** 52)::HUGEINT AS ix, (y * 2 ** 52)::HUGEINT AS iy,
    (u * 2 ** 52)::HUGEINT AS iu, (v * 2 ** 52)::HUGEINT AS iv, u - x AS dx, v - y AS dy
  FROM (SELECT DISTINCT k, a[1] AS x, a[2] AS y, b[1] AS u, b[2] AS v FROM (
    SELECT l_orderkey % 25 AS k, least((ax, ay), (ex, ey)) AS a, greatest((ax, ay), (ex, ey)) AS b
    FROM ({d.SQL_SEGMENTS}) WHERE ex IS NOT NULL AND (ax, ay) <> (ex, ey)))),
o AS (SELECT s.id, greatest(0, ((t.x - s.x) * s.dx + (t.y - s.y) * s.dy) / (s.dx * s.dx + s.dy * s.dy)) AS lo,
    least(1, ((t.u - s.x) * s.dx + (t.v - s.y) * s.dy) / (s.dx * s.dx + s.dy * s.dy)) AS hi
  FROM s JOIN s t ON s.k = t.k AND t.id < s.id AND abs(s.dx * t.dy - s.dy * t.dx) < 0.001
    AND (s.iu - s.ix) * (t.iy - s.iy) = (s.iv - s.iy) * (t.ix - s.ix) AND (s.iu - s.ix) * (t.iv - s.iy) = (s.iv - s.iy) * (t.iu - s.ix)),
r AS (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM o WHERE hi > lo),
c AS (SELECT id, sum(greatest(0, hi - greatest(lo, coalesce(reach, lo)))) AS covered FROM r GROUP BY id)
SELECT k, round(sum(sqrt(dx * dx + dy * dy) * (1 - coalesce(covered, 0))), 3) AS length FROM s LEFT JOIN c ON s.id = c.id GROUP BY k""")
def dissolve_lines(spark, sf_dir):
    """Stretches that several lines share count once, in whichever direction they run."""
    keyed = d.lines(spark, sf_dir).withColumn("k", F.col("l_orderkey") % 25)
    merged = dissolve.dissolve_polygons(keyed, ["k"])
    return merged.select("k", r(spatial.st_length("geometry"), 3).alias("length"))


@query(f"""WITH p AS ({CUSTOMERS}), l AS (SELECT c_nationkey, c_custkey % 2 AS kind,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 ELSE floor(x) END AS fixed,
  CASE WHEN c_custkey % 2 = 0 THEN floor(x) ELSE c_custkey % 50 END AS low, low + 1 + c_custkey % 9 AS high FROM p),
m AS (SELECT *, max(high) OVER (PARTITION BY c_nationkey, kind, fixed ORDER BY low, high
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l)
SELECT c_nationkey, CAST(sum(greatest(0, high - greatest(low, coalesce(reach, low)))) AS DOUBLE) AS length FROM m GROUP BY c_nationkey""")
def dissolve_overlapping_lines(spark, sf_dir):
    """Lines along a grid that overlap in part: covered length."""
    key = F.col("c_custkey")
    across, up = F.floor(d.key_x(key)), key % 50
    flat = key % 2 == 0
    end = 1 + key % 9
    to_x, to_y = F.when(flat, across + end).otherwise(across), F.when(flat, up).otherwise(up + end)
    text = F.concat(F.lit('{"type":"LineString","coordinates":'),
                    F.to_json(F.array(F.array(across, up), F.array(to_x, to_y))), F.lit("}"))
    drawn = d.table(spark, sf_dir, "customer").select("c_nationkey", spatial.st_geomfromgeojson(text).alias("geometry"))
    merged = dissolve.dissolve_polygons(drawn, ["c_nationkey"])
    return merged.select("c_nationkey", spatial.st_length("geometry").alias("length"))


@query("""SELECT 'box' AS kind, s_suppkey AS id, round((8 - 2 * d) * (6 - 2 * d), 6) AS area
FROM (SELECT s_suppkey, 0.25::DOUBLE * (1 + s_suppkey % 4) AS d FROM supplier)
UNION ALL SELECT 'diamond', p_partkey, round(3 * (1 - 0.3::DOUBLE * sqrt(3.25::DOUBLE) / 1.5) ** 2, 6) FROM part""")
def polygon_inset(spark, sf_dir):
    """Negative buffers of all boxes and diamonds: what is farther from the boundary than the distance."""
    boxes = d.boxes(spark, sf_dir).select(F.lit("box").alias("kind"), F.col("s_suppkey").alias("id"), spatial.st_area(
        spatial.st_buffer("geometry", F.lit(-0.25) * (1 + F.col("s_suppkey") % 4))).alias("area"))
    diamonds = d.diamonds(spark, sf_dir).select(F.lit("diamond").alias("kind"), F.col("p_partkey").alias("id"), spatial.st_area(
        spatial.st_buffer("geometry", F.lit(-0.3))).alias("area"))
    return boxes.unionByName(diamonds).withColumn("area", r("area"))


@query(f"""WITH p AS ({CUSTOMERS}), t AS ({d.SQL_TRIANGLES})
SELECT c_custkey, NOT ({d.SQL_IN_TRIANGLE}) AS outside FROM p JOIN t ON c_nationkey % 5 = n_nationkey % 5 AND n_nationkey >= 20""")
def overlay_points(spark, sf_dir):
    """Points without a triangle: nothing is left of those inside."""
    t = d.triangles(spark, sf_dir).where("n_nationkey >= 20").select("n_nationkey", F.col("geometry").alias("triangle"))
    pairs = customers(spark, sf_dir).join(t, F.col("c_nationkey") % 5 == F.col("n_nationkey") % 5)
    left = spatial.bounds(spatial.st_difference("geometry", "triangle"))
    return pairs.select("c_custkey", left["xmin"].isNotNull().alias("outside"))


@query(f"""WITH s AS (SELECT l_orderkey, ax, ay, ex - ax AS dx, ey - ay AS dy FROM ({d.SQL_SEGMENTS}) WHERE ex IS NOT NULL),
t AS (SELECT *, CASE WHEN dx <> 0 THEN least((-60 - ax) / dx, (60 - ax) / dx) WHEN abs(ax) <= 60 THEN 0 ELSE 2 END AS x0,
  CASE WHEN dx <> 0 THEN greatest((-60 - ax) / dx, (60 - ax) / dx) ELSE 1 END AS x1,
  CASE WHEN dy <> 0 THEN least((-30 - ay) / dy, (30 - ay) / dy) WHEN abs(ay) <= 30 THEN 0 ELSE 2 END AS y0,
  CASE WHEN dy <> 0 THEN greatest((-30 - ay) / dy, (30 - ay) / dy) ELSE 1 END AS y1 FROM s)
SELECT l_orderkey, round(sum(sqrt(dx * dx + dy * dy) * (1 - greatest(0, least(1, x1, y1) - greatest(0, x0, y0)))), 3) AS length
FROM t GROUP BY l_orderkey""")
def overlay_lines_boxes(spark, sf_dir):
    """Length of every line outside a box."""
    box = spatial.st_makeenvelope(F.lit(-60.0), F.lit(-30.0), F.lit(60.0), F.lit(30.0))
    left = d.lines(spark, sf_dir).select("l_orderkey", spatial.st_difference("geometry", box).alias("left"))
    return left.select("l_orderkey", r(F.coalesce(spatial.st_length("left"), F.lit(0.0)), 3).alias("length"))


@query(f"""SELECT c_custkey AS id, c_name AS name, '{{"' || c_mktsegment || '"}}' AS odd, round(x, 6) AS x, round(y, 6) AS y FROM ({CUSTOMERS})""")
def geojson_document(spark, sf_dir):
    """Collections on one line each, of up to 10,000 features, with braces and quotes inside of strings."""
    path = scratch_path(spark)
    odd = F.concat(F.lit('{"'), "c_mktsegment", F.lit('"}'))
    rows = customers(spark, sf_dir).select("_fid", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), odd.alias("odd"), "geometry")
    text = geojson.feature_text(rows, "_fid")
    documents = text.groupBy(F.floor(F.col("_fid") / 10_000)).agg(F.array_join(F.collect_list("value"), ",").alias("f"))
    documents.select(F.concat(F.lit('{"type":"FeatureCollection","name":"}[","features":['), "f", F.lit("]}")).alias("value")).write.text(path)
    found = geojson.read_geojson(spark, path, "document")
    at = spatial.bounds("geometry")
    return found.select("id", "name", "odd", r(at["xmin"]).alias("x"), r(at["ymin"]).alias("y"))


@query(f"""SELECT c_custkey AS id, round(x, 6) AS x, round(y, 6) AS y FROM ({CUSTOMERS})
UNION ALL SELECT -1 - n_nationkey, x0, y0 FROM ({d.SQL_TRIANGLES})""")
def geojson_mixed_directory(spark, sf_dir):
    """Features on lines of their own, and one document that spreads over several lines, in one folder."""
    path = scratch_path(spark)
    rows = customers(spark, sf_dir).select("_fid", F.col("c_custkey").alias("id"), "geometry")
    geojson.write_geojson(rows, path)
    t = d.triangles(spark, sf_dir)
    low = spatial.bounds("geometry")
    points = t.select("_fid", (-1 - F.col("n_nationkey")).cast("bigint").alias("id"),
                      spatial.st_point(low["xmin"], low["ymin"]).alias("geometry"))
    document = geojson.feature_text(points, "_fid").agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("f"))
    document.select(F.concat(F.lit('{"type":\n"FeatureCollection",\n"features": [ '), "f", F.lit("\n]\n}")).alias("value")) \
        .write.mode("append").text(path)
    found = geojson.read_geojson(spark, path)
    at = spatial.bounds("geometry")
    return found.select("id", r(at["xmin"]).alias("x"), r(at["ymin"]).alias("y"))


# --- SQL text ------------------------------------------------------------------

@query(f"""WITH p AS ({CUSTOMERS}) SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
CASE WHEN c_custkey % 10 = 0 THEN 'NULL' ELSE 'POINT' END AS geometry FROM p ORDER BY p.c_custkey LIMIT 200""")
def sql_preview(spark, sf_dir):
    k = F.col("c_custkey")
    given = d.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").withColumn("_fid", k)
    profile.points(given, F.when(k % 10 != 0, d.key_x(k)), d.key_y(k)).createOrReplaceTempView("mf_preview")
    found = sqltext.query(spark, "SELECT c_custkey, c_name, c_acctbal, geometry FROM mf_preview ORDER BY c_custkey;")
    shown = sqltext.preview_frame(found)
    return shown.withColumn("geometry", F.split("geometry", " ")[0])


@query(f"""WITH p AS ({CUSTOMERS}) SELECT c_custkey, x AS west, y AS north, ST_AsText(('POINT(' || x || ' ' || y || ')')::GEOMETRY) AS wkt,
'POINT' AS kind, 0 AS srid, round(sqrt((x - 151.2) ** 2 + (y + 33.8) ** 2), 6) AS distance
FROM p WHERE sqrt((x - 151.2) ** 2 + (y + 33.8) ** 2) <= 30""")
def sql_spatial_functions(spark, sf_dir):
    features.project(customers(spark, sf_dir)).createOrReplaceTempView("mf_customers")
    found = sqltext.query(spark, """SELECT c_custkey, ST_XMin(geometry) AS west, ST_YMax(ST_Envelope(geometry)) AS north,
        ST_AsText(geometry) AS wkt, ST_GeometryType(geometry) AS kind, ST_SRID(geometry) AS srid,
        round(ST_Distance(geometry, ST_Point(151.2, -33.8)), 6) AS distance
        FROM mf_customers WHERE ST_Distance(geometry, ST_Point(151.2, -33.8)) <= 30""")
    return found


@query(f"""WITH b AS ({d.SQL_BOXES}) SELECT s_suppkey, 48.0::DOUBLE AS area, round(ex, 6) AS cx FROM b
ORDER BY area DESC, s_suppkey LIMIT 10""")
def sql_topk_area(spark, sf_dir):
    features.project(d.boxes(spark, sf_dir)).createOrReplaceTempView("mf_boxes")
    return sqltext.query(spark, """SELECT s_suppkey, round(ST_Area(geometry), 6) AS area,
        round(ST_XMin(ST_Centroid(geometry)), 6) AS cx FROM mf_boxes ORDER BY area DESC, s_suppkey LIMIT 10""")


@query("""SELECT o_orderkey, substr(o_orderpriority, 3, 4) AS word, regexp_replace(o_orderpriority, '[0-9]-', '') AS label,
date_trunc('month', o_orderdate)::TIMESTAMP AS month, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INT) AS days,
round(o_totalprice, 1) AS price, round(power(o_totalprice / 1000, 2), 3) AS squared FROM orders""")
def sql_scalar_functions(spark, sf_dir):
    d.table(spark, sf_dir, "orders").createOrReplaceTempView("mf_orders")
    return sqltext.query(spark, """SELECT o_orderkey, substring(o_orderpriority, 3, 4) AS word,
        regexp_replace(o_orderpriority, '[0-9]-', '') AS label, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month,
        datediff(o_orderdate, DATE '1995-01-01') AS days, round(o_totalprice, 1) AS price,
        round(pow(o_totalprice / 1000, 2), 3) AS squared FROM mf_orders""")


@query("""SELECT event_id, CAST(props->>'k' AS INT) AS k, CAST(len(list_distinct([user_id % 3, event_id % 3, user_id % 3])) AS INT) AS kinds,
CAST(list_sum([user_id, event_id]) AS BIGINT) AS total FROM events""")
def sql_nested_functions(spark, sf_dir):
    d.table(spark, sf_dir, "events").createOrReplaceTempView("mf_events")
    return sqltext.query(spark, """SELECT event_id, from_json(props, 'k INT').k AS k,
        size(array_distinct(array(user_id % 3, event_id % 3, user_id % 3))) AS kinds,
        aggregate(transform(array(user_id, event_id), v -> v), CAST(0 AS BIGINT), (a, v) -> a + v) AS total FROM mf_events""")


# --- parts, style, clusters, layers ------------------------------------------------

@query(f"""WITH v AS ({d.SQL_VERTICES}) SELECT l_orderkey, CAST(seq - 1 AS INT) AS vertex, x, y FROM v WHERE vertices >= 2""")
def decode_vertices(spark, sf_dir):
    rings = parts.explode_rings(d.lines(spark, sf_dir))
    return (rings.select("l_orderkey", F.posexplode(F.arrays_zip("xs", "ys")).alias("vertex", "v"))
            .select("l_orderkey", "vertex", F.col("v.xs").alias("x"), F.col("v.ys").alias("y")))


@query(f"""WITH p AS (SELECT DISTINCT c_nationkey, x, y FROM ({CUSTOMERS})) SELECT c_nationkey,
CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY x, y) - 1 AS INT) AS part, 'Point' AS part_type, x, y FROM p""")
def explode_multipoints(spark, sf_dir):
    merged = dissolve.dissolve_points(customers(spark, sf_dir), ["c_nationkey"])
    rows = parts.explode_rings(merged)
    return rows.select("c_nationkey", "part", "part_type", F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y"))


RAMP = ["#440154", "#21908c", "#fde725"]
RAMP_SQL = """CAST(CASE WHEN t < 0.5 THEN floor({a} + ({b} - {a}) * (t * 2) + 0.5) ELSE floor({b} + ({c} - {b}) * (t * 2 - 1) + 0.5) END AS INT)"""


def _ramp_sql():
    stops = [color.parse_hex(c) for c in RAMP]
    return ", ".join(RAMP_SQL.format(a=stops[0][k], b=stops[1][k], c=stops[2][k]) + f" AS {n}"
                     for k, n in enumerate("rgb"))


def _channels(df, *keep):
    return df.select(*keep, *[F.col("fill")[k].alias(n) for k, n in enumerate("rgba")])


@query(f"""WITH s AS (SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS t FROM customer)
SELECT c_custkey, {_ramp_sql()}, 204 AS a FROM s""")
def classify_graduated(spark, sf_dir):
    look = {"type": "graduated", "property": "c_acctbal", "colors": RAMP}
    return _channels(style.classify(customers(spark, sf_dir), look, 0.8), "c_custkey")


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (l_extendedprice - min(l_extendedprice) OVER ())
  / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS t FROM lineitem), c AS (SELECT {_ramp_sql()} FROM s)
SELECT r, g, b, count(*) AS n FROM c GROUP BY r, g, b""")
def classify_graduated_histogram(spark, sf_dir):
    painted = style.classify_graduated(d.table(spark, sf_dir, "lineitem"), "l_extendedprice", RAMP)
    return _channels(painted).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


def _palette_sql(colors, value="i"):
    rows = [color.parse_hex(c) for c in colors]
    cases = [f"CASE {value} " + " ".join(f"WHEN {i} THEN {row[k]}" for i, row in enumerate(rows)) + f" END AS {n}"
             for k, n in enumerate("rgb")]
    return ", ".join(cases)


@query(f"""WITH f AS (SELECT c_mktsegment AS v, min(c_custkey) AS k FROM customer GROUP BY 1),
i AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS i FROM f)
SELECT c_custkey, {_palette_sql(color.COLOR_RAMPS['Blues'])}, 255 AS a FROM customer JOIN i ON c_mktsegment = v""")
def classify_categorized(spark, sf_dir):
    look = {"type": "categorized", "property": "c_mktsegment", "colors": color.COLOR_RAMPS["Blues"]}
    return _channels(style.classify(customers(spark, sf_dir), look, 1.0), "c_custkey")


@query(f"""WITH f AS (SELECT p_brand AS v, min(p_partkey) AS k FROM part GROUP BY 1),
i AS (SELECT v, (row_number() OVER (ORDER BY k) - 1) % 15 AS i FROM f)
SELECT p_partkey, {_palette_sql(color.CATEGORY_COLORS)}, 255 AS a FROM part JOIN i ON p_brand = v""")
def classify_palette(spark, sf_dir):
    """A text column under a graduated style, with more values than the ramp has colours."""
    look = {"type": "graduated", "property": "p_brand", "colors": RAMP}
    parts_table = d.table(spark, sf_dir, "part").withColumn("_fid", F.col("p_partkey"))
    return _channels(style.classify(parts_table, look, 1.0), "p_partkey")


def _mercator_sql(source):
    return f"""SELECT x / 360 + 0.5 AS mx, 0.5 - 0.25 * ln((1 + sin(y * (pi() / 180))) / (1 - sin(y * (pi() / 180)))) / pi() AS my FROM ({source})"""


def _clusters_sql(source, zoom, digits=8):
    return f"""SELECT {zoom} AS zoom, CAST(floor(mx * (512 * 2.0 ** {zoom} / 60)) AS BIGINT) AS cx, CAST(floor(my * (512 * 2.0 ** {zoom} / 60)) AS BIGINT) AS cy,
count(*) AS point_count, round(avg(mx) + 1.3e-9::DOUBLE, {digits}) AS mx, round(avg(my) + 1.3e-9::DOUBLE, {digits}) AS my FROM ({_mercator_sql(source)}) GROUP BY ALL"""


def _centres():
    """Rounded off the middle between two digits, where the order of a sum would show."""
    return [r(F.col(c) + 1.3e-9, 8).alias(c) for c in ("mx", "my")]


@query(_clusters_sql(CUSTOMERS, 4))
def cluster_points(spark, sf_dir):
    found = cluster.cluster_points(customers(spark, sf_dir), [4])
    return found.select("zoom", "cx", "cy", "point_count", *_centres())


@query(" UNION ALL ".join(_clusters_sql(EVENTS, z) for z in (0, 1, 2, 3, 4, 5)))
def cluster_points_zooms(spark, sf_dir):
    found = cluster.cluster_points(events(spark, sf_dir), range(6))
    return found.select("zoom", "cx", "cy", "point_count", *_centres())


@query(f"""WITH c AS ({_clusters_sql(EVENTS, 3, 15).replace(' + 1.3e-9::DOUBLE', '')}), l AS (SELECT *, (mx - 0.5) * 360 AS lon, atan(exp((1 - my * 2) * pi())) * (360 / pi()) - 90 AS lat FROM c)
SELECT point_count, round(lon, 7) AS lon, round(lat, 7) AS lat,
round(CASE WHEN point_count > 1 THEN least(40, greatest(10, log10(point_count + 1) * 10)) ELSE 5 END, 6) AS circle_radius,
CASE WHEN point_count > 1 THEN CASE WHEN point_count < 10 THEN 255 WHEN point_count < 100 THEN 254 ELSE 240 END ELSE 51 END AS red,
CASE WHEN point_count > 1 THEN CASE WHEN point_count >= 1000 THEN NULL ELSE CAST(point_count AS VARCHAR) END END AS label
FROM l WHERE lon BETWEEN 110 AND 155 AND lat BETWEEN -45 AND -10""")
def cluster_view(spark, sf_dir):
    found = cluster.symbolize(cluster.clusters_in_view(events(spark, sf_dir), AUSTRALIA, 3.7))
    return found.select("point_count", r(F.col("lon"), 7).alias("lon"), r(F.col("lat"), 7).alias("lat"),
                        r(F.col("circle_radius")).alias("circle_radius"), F.col("fill")[0].alias("red"), "label")


@query(f"""WITH p AS ({CUSTOMERS}), s AS (SELECT * FROM p WHERE c_acctbal > 0),
t AS (SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS t FROM s)
SELECT 'customers' AS layer, 1 AS z_index, c_custkey AS fid, 0 AS part, 'Point' AS part_type, 1 AS rings, {_ramp_sql()}, 5.0::DOUBLE AS radius FROM t
UNION ALL SELECT 'parts', 0, p_partkey, 0, 'Polygon', 1, 46, 204, 113, 5.0::DOUBLE FROM part""")
def render_map(spark, sf_dir):
    below = layers.layer_of(d.diamonds(spark, sf_dir), "parts", "polygon")
    above = layers.layer_of(customers(spark, sf_dir), "customers", "point", sql_filter="c_acctbal > 0",
                            style={"type": "graduated", "property": "c_acctbal", "colors": RAMP})
    drawn = layers.drawing_order(layers.render_map([below, above]))
    return drawn.select("layer", "z_index", F.col("_fid").alias("fid"), "part", "part_type",
                        F.size("rings").alias("rings"), *[F.col("fill")[k].alias(n) for k, n in enumerate("rgb")], "radius")


@query(f"""WITH p AS ({CUSTOMERS}) SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE printf('%.4f', c_acctbal) END AS c_acctbal, c_mktsegment
FROM p WHERE sqrt((x - 20) ** 2 + (y - 10) ** 2) <= 15.003""")
def identify(spark, sf_dir):
    return features.identify(customers(spark, sf_dir), 20.0, 10.0, 15.003, points=True)


@query(" UNION ALL ".join(f"SELECT '{name}' AS field, '{kind}' AS kind, count({name}) AS n FROM customer" for name, kind in (
    ("c_custkey", "number"), ("c_name", "string"), ("c_nationkey", "number"), ("c_acctbal", "number"),
    ("c_mktsegment", "string"))))
def field_kinds(spark, sf_dir):
    """Kind of every field, with its values that are not NULL."""
    c = d.table(spark, sf_dir, "customer")
    kinds = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(profile.field_kind(f)).alias("kind"),
                               F.col(f"n_{f.name}").alias("n")) for f in c.schema])
    return c.agg(*[F.count(f.name).alias(f"n_{f.name}") for f in c.schema]).select(F.inline(kinds))


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part) SELECT p_partkey,
CASE WHEN p_partkey % 10 = 0 THEN 100 ELSE CAST(v // 65536 AS INT) END AS r, CASE WHEN p_partkey % 10 = 0 THEN 100 ELSE CAST(v // 256 % 256 AS INT) END AS g,
CASE WHEN p_partkey % 10 = 0 THEN 100 ELSE CAST(v % 256 AS INT) END AS b, 128 AS a FROM c""")
def hex_colors(spark, sf_dir):
    """Six hex digits after an optional #; other texts are grey."""
    k = F.col("p_partkey")
    digits = F.lower(F.lpad(F.hex((k * 7919) % 16777216), 6, "0"))
    text = F.when(k % 10 == 0, F.lit("#12")).when(k % 2 == 0, F.concat(F.lit("#"), digits)).otherwise(digits)
    return _channels(d.table(spark, sf_dir, "part").withColumn("fill", color.hex_to_rgba(text, 128)), "p_partkey")
