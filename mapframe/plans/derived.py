"""Feature tables derived from the relational test tables.

Coordinates come from integer keys by modular arithmetic, so the same text gives
the same doubles in every engine.  Each Spark builder has its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial
from ..operators.profile import points, with_bounds
from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- coordinates of a key --------------------------------------------------

def key_x(k: Column) -> Column:
    return ((k.cast("bigint") * 7919) % 36000).cast("double") / F.lit(100.0) - F.lit(180.0)


def key_y(k: Column) -> Column:
    return ((k.cast("bigint") * 104729) % 17000).cast("double") / F.lit(100.0) - F.lit(85.0)


def sql_x(k: str) -> str:
    return f"(CAST((CAST({k} AS BIGINT) * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE))"


def sql_y(k: str) -> str:
    return f"(CAST((CAST({k} AS BIGINT) * 104729) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE))"


# --- points ---------------------------------------------------------------

def key_points(spark, sf_dir, name, key) -> DataFrame:
    k = F.col(key).cast("bigint")
    return points(table(spark, sf_dir, name).withColumn("_fid", k), key_x(k), key_y(k))


def sql_points(name: str, key: str) -> str:
    return f"SELECT *, {sql_x(key)} AS x, {sql_y(key)} AS y FROM {name}"


# --- triangles: the lower left halves of a 5 x 5 grid ------------------------

def triangles(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey").cast("bigint")
    x0 = (F.lit(-180) + 72 * (n % 5)).cast("double")
    y0 = (F.lit(-85) + 34 * F.floor(n / 5)).cast("double")
    ring = _ring([(x0, y0), (x0 + 72, y0), (x0, y0 + 34), (x0, y0)])
    return _polygons(table(spark, sf_dir, "nation").withColumn("_fid", n), ring)


SQL_TRIANGLES = """SELECT n_nationkey, n_name, n_regionkey,
    CAST(-180 + 72 * (n_nationkey % 5) AS DOUBLE) AS x0,
    CAST(-85 + 34 * (n_nationkey // 5) AS DOUBLE) AS y0 FROM nation"""
SQL_IN_TRIANGLE = "x >= x0 AND y >= y0 AND (x - x0) / 72 + (y - y0) / 34 <= 1"


# --- diamonds around keys of part, boxes around keys of supplier -----------------

DIAMOND_KEY = "p_partkey * 31 + 7"
DIAMOND_A, DIAMOND_B = 1.5, 1.0
BOX_W, BOX_H = 4.0, 3.0


def diamonds(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") * 31 + 7
    x, y = key_x(k), key_y(k)
    ring = _ring([(x + DIAMOND_A, y), (x, y + DIAMOND_B), (x - DIAMOND_A, y), (x, y - DIAMOND_B), (x + DIAMOND_A, y)])
    return _polygons(table(spark, sf_dir, "part").withColumn("_fid", F.col("p_partkey")), ring)


SQL_DIAMONDS = f"SELECT *, {sql_x(DIAMOND_KEY)} AS px, {sql_y(DIAMOND_KEY)} AS py FROM part"


def boxes(spark, sf_dir) -> DataFrame:
    x, y = key_x(F.col("s_suppkey")), key_y(F.col("s_suppkey"))
    box = (x - BOX_W, y - BOX_H, x + BOX_W, y + BOX_H)
    named = table(spark, sf_dir, "supplier").withColumn("_fid", F.col("s_suppkey"))
    return named.withColumns(dict(zip(spatial.BBOX, box))).withColumn(
        "geometry", spatial.st_makeenvelope(*spatial.BBOX))


SQL_BOXES = (f"SELECT *, {sql_x('s_suppkey')} AS ex, {sql_y('s_suppkey')} AS ey, ex - 4 AS x0, ey - 3 AS y0, "
             "ex + 4 AS x1, ey + 3 AS y1 FROM supplier")


# --- lines: supplier points along each order -------------------------------------

def line_vertices(spark, sf_dir) -> DataFrame:
    s = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", key_x(s).alias("x"), key_y(s).alias("y"))


def lines(spark, sf_dir) -> DataFrame:
    vertices = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "x", "y")))
    grouped = (line_vertices(spark, sf_dir).groupBy("l_orderkey").agg(vertices.alias("v"))
               .where(F.size("v") >= 2).withColumn("_fid", F.col("l_orderkey")))
    return with_bounds(grouped.select("l_orderkey", "_fid", spatial.st_makeline(F.col("v.x"), F.col("v.y")).alias("geometry")))


SQL_VERTICES = f"""SELECT l_orderkey, {sql_x('l_suppkey')} AS x, {sql_y('l_suppkey')} AS y,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS seq,
    count(*) OVER (PARTITION BY l_orderkey) AS vertices FROM lineitem"""
SQL_SEGMENTS = f"""SELECT l_orderkey, seq, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey
    FROM ({SQL_VERTICES}) WHERE vertices >= 2 WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq)"""


# --- helpers ---------------------------------------------------------------

def _ring(vertices) -> Column:
    return spatial.st_makepolygon(*[F.array(*[v.cast("double") for v in axis]) for axis in zip(*vertices)])


def _polygons(df: DataFrame, ring: Column) -> DataFrame:
    return with_bounds(df.withColumn("geometry", ring))
