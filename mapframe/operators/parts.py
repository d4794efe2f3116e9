"""Drawable parts of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.spatial import BBOX


def explode_rings(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row per ring: ``part, ring, part_type, xs, ys`` and the attributes.

    Features without a drawable geometry give no row; of a collection only the
    first member counts.
    """
    names = [c for c in df.columns if c != geom and c not in BBOX]
    rings = df.select(*names, F.explode(spatial.parts(f"`{geom}`")).alias("_p"))
    return rings.select(*names, F.col("_p.part").alias("part"), F.col("_p.ring").alias("ring"),
                        F.col("_p.type").alias("part_type"), F.col("_p.xs").alias("xs"), F.col("_p.ys").alias("ys"))


def explode_parts(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row per part, its rings in ``rings``; no shuffle.

    A multi geometry gives a row per member with the attributes of its feature.
    """
    names = [c for c in df.columns if c != geom and c not in BBOX]
    listed = df.select(*names, F.explode(spatial.nested_parts(f"`{geom}`")).alias("_p"))
    return listed.select(*names, F.col("_p.part").alias("part"), F.col("_p.type").alias("part_type"),
                         F.col("_p.rings").alias("rings"))
