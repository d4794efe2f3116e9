"""Readers by file name."""

from __future__ import annotations

import json
import os.path
import re

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..errors import BadRequest
from ..functions.crs import srid_of
from ..session import prepare
from . import geojson, geopackage, kml, shapefile
from .files import locate

# File name endings in the order they are tried, and their labels.
FORMATS = {
    ".parquet": "GeoParquet", ".geoparquet": "GeoParquet", ".gpkg": "GeoPackage", ".shp": "Shapefile",
    ".geojson": "GeoJSON", ".json": "GeoJSON", ".kml": "KML",
}


def extension(name: str) -> str | None:
    return next((e for e in FORMATS if name.lower().endswith(e)), None)


def dataset_name(file_name: str) -> str:
    """File name without a known ending, in any case."""
    known = extension(file_name)
    return file_name[: -len(known)] if known else file_name


def format_name(file_name: str) -> str:
    return FORMATS.get(extension(file_name), "Unknown")


def confine(path: str, root: str) -> str:
    """The path with links resolved, when it lies under the root directory."""
    if "://" in path:
        if not path.startswith(root.rstrip("/") + "/") or ".." in path.split("/"):
            raise BadRequest(f"Path outside of the data directory: {path}")
        return path
    full, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([full, base]) != base:
        raise BadRequest(f"Path outside of the data directory: {path}")
    if not os.path.exists(full):
        raise BadRequest(f"No such file: {path}")
    return full


def read_spatial(spark: SparkSession, path: str, root: str | None = None, **options) -> DataFrame:
    """Features of a file, directory or pattern, read by the ending of its name."""
    return read_with_srid(spark, path, root, **options)[0]


def read_with_srid(spark: SparkSession, path: str, root: str | None = None, **options):
    """(features, EPSG code declared by the file or None)."""
    prepare(spark)
    kind = format_name(path)
    if kind == "Unknown":
        raise BadRequest("Unsupported file format. Supported: " + ", ".join(FORMATS))
    if root is not None:
        path = confine(path, root)
    if kind == "GeoParquet":
        return read_geoparquet(spark, path)
    if kind == "GeoJSON":
        return geojson.read_geojson(spark, path, **options), geojson.declared_srid(spark, path)
    if kind == "KML":
        return kml.read_kml(spark, path), 4326
    if kind == "GeoPackage":
        return geopackage.read_geopackage(spark, path, **options), geopackage.declared_srid(path, **options)
    return shapefile.read_shapefile(spark, path), shapefile.declared_srid(path)


def read_geoparquet(spark: SparkSession, path: str):
    df = spark.read.parquet(path)
    first = df.select("_metadata.file_path").head()  # any one file; a listing would grow with the table
    meta = _geo_metadata(first[0]) if first else None
    if not meta:
        return df, None
    crs = meta.get("columns", {}).get(meta.get("primary_column"), {}).get("crs", "OGC:CRS84")
    return df, _crs_code(crs)


def _geo_metadata(uri: str) -> dict | None:
    system, inner = locate(re.sub(r"^file:/+", "/", uri))
    with system.open_input_file(inner) as f:
        stored = pq.read_metadata(f).metadata or {}
    return json.loads(stored[b"geo"]) if b"geo" in stored else None


def _crs_code(crs) -> int | None:
    """EPSG code of a PROJJSON object, an authority text or NULL (unknown)."""
    if crs is None:
        return 0
    if isinstance(crs, dict):
        ident = crs.get("id") or {}
        return 4326 if str(ident.get("code")).upper() == "CRS84" else int(ident["code"]) if "code" in ident else 0
    try:
        return srid_of(crs)
    except BadRequest:
        return 0
