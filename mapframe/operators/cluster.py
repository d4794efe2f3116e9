"""Point clusters per zoom level on a Web Mercator grid.

Cells are nested: the cell of a zoom is half the index of the next finer one.
Points are therefore aggregated once, at the finest zoom asked for, and the far
smaller cell table is rolled up to the others.  Partial aggregation before the
shuffle keeps a crowded cell from loading one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions.color import DEFAULT_FILL, js_round, parse_hex, rgba
from ..functions.spatial import BBOX
from .features import parse_bbox
from .profile import FID

# Defaults of the clustering, tile extent, symbol classes.
RADIUS, MAX_ZOOM, EXTENT = 60, 16, 512
FEW, SOME, MANY = (255, 237, 160), (254, 178, 76), (240, 59, 32)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator in units of the world width, y down, clamped to [0, 1]."""
    sine = F.sin(lat * (math.pi / 180))
    y = 0.5 - 0.25 * F.log((1 + sine) / (1 - sine)) / math.pi
    clamped = F.when(lat >= 90, 0.0).when(lat <= -90, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))
    return lon / 360 + 0.5, clamped


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lat = F.atan(F.exp((1 - y * 2) * math.pi)) * (360 / math.pi) - 90
    return (x - 0.5) * 360, lat


def cluster_points(df: DataFrame, zooms, radius: float = RADIUS, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """Clusters of a prepared point table: ``zoom, cx, cy, point_count, mx, my, lon, lat``.

    A cell with one point is that point.  Zooms are cut to whole numbers of at
    least 0; above ``max_zoom`` nothing is clustered and every point is a row of
    its own, which ``raw_points`` returns.
    """
    zooms = sorted({max(0, math.floor(z)) for z in zooms})
    if not zooms or radius <= 0:
        raise BadRequest("clustering needs zoom levels and a positive radius")
    if zooms[-1] > max_zoom:
        raise BadRequest(f"zoom {zooms[-1]} is above max_zoom {max_zoom}: use raw_points")
    finest = zooms[-1]
    mx, my = mercator(F.col(BBOX[0]), F.col(BBOX[1]))
    scale = EXTENT * 2.0 ** finest / radius
    placed = df.where(F.col(BBOX[0]).isNotNull()).select(mx.alias("mx"), my.alias("my"))
    cells = (placed.groupBy(F.floor(F.col("mx") * scale).alias("cx"), F.floor(F.col("my") * scale).alias("cy"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("mx").alias("sx"), F.sum("my").alias("sy")))
    if len(zooms) > 1:
        listed = cells.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
        step = F.pow(F.lit(2.0), (F.lit(finest) - F.col("zoom")).cast("double"))
        cells = (listed.groupBy("zoom", F.floor(F.col("cx") / step).alias("cx"), F.floor(F.col("cy") / step).alias("cy"))
                 .agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")))
    else:
        cells = cells.withColumn("zoom", F.lit(finest))
    lon, lat = inverse_mercator(F.col("mx"), F.col("my"))
    return (cells.select("zoom", "cx", "cy", F.col("n").alias("point_count"),
                         (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"))
            .withColumns({"lon": lon, "lat": lat}))


def raw_points(df: DataFrame, zoom: int) -> DataFrame:
    """Rows for zooms above the clustering range: every point is itself."""
    mx, my = mercator(F.col(BBOX[0]), F.col(BBOX[1]))
    return df.where(F.col(BBOX[0]).isNotNull()).select(
        F.lit(zoom).alias("zoom"), *([FID] if FID in df.columns else []), F.lit(1).cast("bigint").alias("point_count"),
        mx.alias("mx"), my.alias("my"), F.col(BBOX[0]).alias("lon"), F.col(BBOX[1]).alias("lat"))


def clusters_in_view(df: DataFrame, bbox, zoom: float, radius: float = RADIUS, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """Clusters whose centre is in the box at the whole part of the zoom.

    Clusters are formed from all points, so that the same cluster has the same
    count in every view.
    """
    x0, y0, x1, y1 = parse_bbox(bbox)
    level = max(0, math.floor(zoom))
    clusters = raw_points(df, level) if level > max_zoom else cluster_points(df, [level], radius, max_zoom)
    return clusters.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))


def symbolize(clusters: DataFrame, base_radius: float = 5, opacity: float = 0.8,
              fill: str = DEFAULT_FILL) -> DataFrame:
    """Circle radius, fill colour and label of clusters; single points keep the plain style."""
    alpha = js_round(opacity * 255)
    n = F.col("point_count")
    clustered = n > 1
    size = F.least(F.lit(40.0), F.greatest(F.lit(2.0 * base_radius), F.log10(n + 1) * 10))
    color = (F.when(n < 10, rgba((*FEW, alpha))).when(n < 100, rgba((*SOME, alpha))).otherwise(rgba((*MANY, alpha))))
    return clusters.withColumns({
        "circle_radius": F.when(clustered, size).otherwise(F.lit(float(base_radius))),
        "fill": F.when(clustered, color).otherwise(rgba(parse_hex(fill, alpha))),
        "label": F.when(clustered, abbreviated(n))})


def abbreviated(n: Column) -> Column:
    """``999``, ``1.2k``, ``12k``."""
    tenths = F.floor(n / 100 + 0.5)
    short = F.concat((tenths / 10).cast("decimal(20,1)").cast("string"), F.lit("k"))
    return (F.when(n >= 10000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k")))
            .when(n >= 1000, F.regexp_replace(short, r"\.0k$", "k")).otherwise(n.cast("string")))
