"""Map layers as plans: filter, colour, drawable parts, drawing order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions.color import DEFAULT_STROKE, default_style, parse_hex, rgba
from ..operators import cluster, style
from ..operators.features import where_text
from ..operators.parts import explode_parts
from ..operators.profile import FID, INTERNAL


def layer_of(table: DataFrame, name: str, geometry_type: str, geometry_column: str = "geometry", **changes) -> dict:
    """Layer with the default style of its geometry type; ``style`` entries override single defaults."""
    wanted = {**default_style(geometry_type), **changes.pop("style", {})}
    return {"table": table, "name": name, "geometry_type": geometry_type, "geometry_column": geometry_column,
            "style": wanted, "opacity": 1.0, "visible": True, "sql_filter": None, **changes}


def render_layer(layer: dict, z_index: int = 0) -> DataFrame:
    """Parts of one layer with colours and sizes.

    Columns: ``layer, z_index, _fid, part, part_type, rings, properties, fill,
    stroke, stroke_width, radius``.  Rows without geometry are left out before
    the style statistics are taken.
    """
    table, geom, look = layer["table"], layer["geometry_column"], layer["style"]
    if FID not in table.columns:
        raise BadRequest(f"a layer table needs {FID}")
    shown = where_text(table, layer.get("sql_filter")).where(F.col(f"`{geom}`").isNotNull())
    opacity = layer.get("opacity", 1.0)
    painted = style.classify(shown, look, opacity, "_fill")
    attributes = [c for c in table.columns if c not in INTERNAL and c != geom]
    packed = (F.to_json(F.struct(*[F.col(f"`{c}`") for c in attributes]), {"ignoreNullFields": "false"})
              if attributes else F.lit("{}"))
    parts = explode_parts(painted.select(FID, packed.alias("properties"), "_fill", F.col(f"`{geom}`").alias("geometry")))
    line = "line" in layer["geometry_type"].lower()
    stroke = rgba(parse_hex(look.get("strokeColor") or DEFAULT_STROKE, 255))
    data_driven = bool(look.get("property") and look.get("colors") and look.get("type", "simple") != "simple")
    return parts.select(
        F.lit(layer["name"]).alias("layer"), F.lit(z_index).alias("z_index"), FID, "part", "part_type", "rings",
        "properties", F.col("_fill").alias("fill"),
        (F.col("_fill") if line and data_driven else stroke).alias("stroke"),
        F.lit(float(look.get("strokeWidth", 1 if "point" in layer["geometry_type"].lower() else 2))).alias("stroke_width"),
        F.lit(float(look.get("radius", 5))).alias("radius"))


def render_clusters(layer: dict, bbox, zoom: float) -> DataFrame:
    """Cluster symbols of a point layer with ``cluster`` set, for one view."""
    look = layer["style"]
    shown = where_text(layer["table"], layer.get("sql_filter"))
    found = cluster.clusters_in_view(shown, bbox, zoom, look.get("clusterRadius", cluster.RADIUS),
                                     look.get("clusterMaxZoom", cluster.MAX_ZOOM))
    return cluster.symbolize(found, look.get("radius", 5), layer.get("opacity", 1.0),
                             look.get("fillColor", "#3388ff"))


def reorder(layers: list[dict], name: str, direction: str) -> list[dict]:
    """Swap a layer with its neighbour; at the end of the list nothing changes."""
    at = next((i for i, layer in enumerate(layers) if layer["name"] == name), -1)
    to = at + (1 if direction == "up" else -1)
    out = list(layers)
    if at >= 0 and 0 <= to < len(layers):
        out[at], out[to] = out[to], out[at]
    return out


def render_map(layers: list[dict]) -> DataFrame:
    """All visible layers; the position in the list is the drawing order."""
    drawn = [render_layer(layer, z) for z, layer in enumerate(layers) if layer.get("visible", True)]
    if not drawn:
        raise BadRequest("no visible layer")
    return reduce(lambda a, b: a.unionByName(b), drawn)


def drawing_order(parts: DataFrame) -> DataFrame:
    return parts.orderBy("z_index", FID, "part")
