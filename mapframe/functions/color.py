"""Colours: parsing, ramps and the category palette."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Palettes and default styles.
GREY = (100, 100, 100)
DEFAULT_FILL = "#3388ff"
DEFAULT_STROKE = "#2171b5"
CATEGORY_COLORS = [
    "#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00",
    "#ffff33", "#a65628", "#f781bf", "#999999", "#66c2a5",
    "#fc8d62", "#8da0cb", "#e78ac3", "#a6d854", "#ffd92f",
]
COLOR_RAMPS = {
    "Blues": ["#f7fbff", "#deebf7", "#c6dbef", "#9ecae1", "#6baed6", "#4292c6", "#2171b5", "#08519c", "#08306b"],
    "Greens": ["#f7fcf5", "#e5f5e0", "#c7e9c0", "#a1d99b", "#74c476", "#41ab5d", "#238b45", "#006d2c", "#00441b"],
    "Reds": ["#fff5f0", "#fee0d2", "#fcbba1", "#fc9272", "#fb6a4a", "#ef3b2c", "#cb181d", "#a50f15", "#67000d"],
    "Oranges": ["#fff5eb", "#fee6ce", "#fdd0a2", "#fdae6b", "#fd8d3c", "#f16913", "#d94801", "#a63603", "#7f2704"],
    "Purples": ["#fcfbfd", "#efedf5", "#dadaeb", "#bcbddc", "#9e9ac8", "#807dba", "#6a51a3", "#54278f", "#3f007d"],
    "Viridis": ["#440154", "#482878", "#3e4989", "#31688e", "#26828e", "#1f9e89", "#35b779", "#6ece58", "#b5de2b",
                "#fde725"],
    "Spectral": ["#d53e4f", "#f46d43", "#fdae61", "#fee08b", "#e6f598", "#abdda4", "#66c2a5", "#3288bd", "#5e4fa2"],
    "RdYlGn": ["#d7191c", "#fdae61", "#ffffbf", "#a6d96a", "#1a9641"],
}
DEFAULT_STYLES = {
    "Point": {"type": "simple", "fillColor": "#4a90e2", "strokeColor": "#2171b5", "strokeWidth": 1,
              "opacity": 0.8, "radius": 5},
    "LineString": {"type": "simple", "strokeColor": "#e74c3c", "strokeWidth": 2, "opacity": 0.9},
    "Polygon": {"type": "simple", "fillColor": "#2ecc71", "strokeColor": "#27ae60", "strokeWidth": 1,
                "opacity": 0.6},
}


def default_style(geometry_type: str) -> dict:
    """Default style of a stored geometry type; multi types share that of their parts."""
    kind = geometry_type.lower().removeprefix("multi")
    names = {"point": "Point", "linestring": "LineString"}
    return dict(DEFAULT_STYLES[names.get(kind, "Polygon")])


def js_round(v: float) -> int:
    return math.floor(v + 0.5)


def parse_hex(color: str | None, alpha: int = 255) -> tuple[int, int, int, int]:
    """``#rrggbb`` (the ``#`` is optional) or grey."""
    text = (color or "").removeprefix("#")
    if re.fullmatch(r"[0-9a-fA-F]{6}", text):
        return (*bytes.fromhex(text), alpha)
    return (*GREY, alpha)


def rgba(color, alpha: int = 255) -> Column:
    """Literal ``[r, g, b, a]`` column of a parsed colour."""
    r, g, b, a = color if len(color) == 4 else (*color, alpha)
    return F.array(*[F.lit(int(v)) for v in (r, g, b, a)])


def hex_to_rgba(column: Column, alpha: int = 255) -> Column:
    """The same as ``parse_hex`` for a column of colour texts."""
    text = F.regexp_replace(column, "^#", "")

    def channel(k):
        return F.conv(F.substring(text, 2 * k + 1, 2), 16, 10).cast("int")

    good = F.coalesce(text.rlike("^[0-9a-fA-F]{6}$"), F.lit(False))
    return F.when(good, F.array(channel(0), channel(1), channel(2), F.lit(alpha))).otherwise(rgba((*GREY, alpha)))


def ramp_color(t: Column, colors: list[str], alpha: int = 255) -> Column:
    """Linear interpolation along the ramp for t in [0, 1], clamped."""
    if not colors:
        return rgba((*GREY, alpha))
    stops = [parse_hex(c, alpha) for c in colors]
    if len(stops) == 1:
        return rgba(stops[0])
    segments = len(stops) - 1
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * segments
    low = F.least(F.floor(place), F.lit(segments - 1)).cast("int")

    def channel(k):
        values = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.get(values, low), F.get(values, low + 1)
        return F.floor(a + (b - a) * (place - low) + 0.5).cast("int")

    return F.array(channel(0), channel(1), channel(2), F.lit(alpha))
