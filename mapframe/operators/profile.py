"""Finding out what a table holds, and preparing it for spatial work."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest
from ..functions import codec, crs, spatial
from ..functions.spatial import BBOX
from ..session import staged

# Names tried first, in this order, and the hidden columns.
GEOMETRY_NAMES = ["geometry", "geom", "wkb_geometry", "the_geom", "shape"]
FID = "_fid"
INTERNAL = [*BBOX, FID]
GEOMETRY_TYPES = {code: name.lower() for code, name in codec.TYPE_NAMES.items()}


@dataclass(frozen=True)
class Bounds:
    min_x: float
    min_y: float
    max_x: float
    max_y: float


def column_info(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "data_type": f.dataType.simpleString(), "nullable": f.nullable}
            for f in df.schema if f.name not in INTERNAL]


def field_kind(field: T.StructField) -> str:
    """``number``, ``string`` or ``other``; numbers are recognised by type, not by name."""
    if isinstance(field.dataType, T.NumericType):
        return "number"
    return "string" if isinstance(field.dataType, T.StringType) else "other"


def check_identifier(name: str) -> str:
    if not name:
        raise BadRequest("Empty identifier")
    if len(name) > 128 or not re.fullmatch(r"[A-Za-z0-9_.]+", name):
        raise BadRequest(f"Invalid identifier: {name}")
    return name


def detect_geometry_column(df: DataFrame) -> str | None:
    """A column with a usual name, else the first binary column that holds WKB."""
    by_lower = {}
    for name in df.columns:
        by_lower.setdefault(name.lower(), name)
    for candidate in GEOMETRY_NAMES:
        if candidate in by_lower:
            return by_lower[candidate]
    for field in df.schema:
        if isinstance(field.dataType, T.BinaryType):
            quoted = F.col(f"`{field.name}`")
            sample = df.select(quoted.alias("g")).where("g IS NOT NULL").head()
            if sample and codec.parse(bytes(sample.g)) is not None:
                return field.name
    return None


def detect_srid(df: DataFrame, geom: str) -> int:
    """SRID carried by the first non-NULL value, 0 without one."""
    row = df.select(F.col(f"`{geom}`").alias("g")).where("g IS NOT NULL").select(spatial.st_srid("g")).head()
    return row[0] if row else 0


def out_of_lonlat(bounds: Bounds | None) -> bool:
    return bounds is not None and (max(abs(bounds.min_x), abs(bounds.max_x)) > 360
                                   or max(abs(bounds.min_y), abs(bounds.max_y)) > 90)


def with_bounds(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Add the four bounding box columns, decoding every geometry once."""
    box = spatial.bounds(f"`{geom}`")
    boxed = df.withColumn("_box", box)
    return boxed.withColumns(dict(zip(BBOX, (boxed["_box.xmin"], boxed["_box.ymin"],
                                             boxed["_box.xmax"], boxed["_box.ymax"])))).drop("_box")


def points(df: DataFrame, x, y, geom: str = "geometry", srid: int = 4326) -> DataFrame:
    """Point features from two coordinate columns; their boxes cost nothing."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = x.cast("double"), y.cast("double")
    if srid != 4326:
        x, y = crs.transform_xy(x, y, srid, 4326)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)  # half a pair is no point
    boxed = df.withColumns({BBOX[0]: x, BBOX[1]: y})
    return boxed.withColumns({BBOX[2]: F.col(BBOX[0]), BBOX[3]: F.col(BBOX[1]),
                              geom: spatial.st_point(BBOX[0], BBOX[1])})


def with_fid(df: DataFrame) -> DataFrame:
    """Row numbers in source order, unique but not dense; write them before relying on them."""
    return df if FID in df.columns else df.withColumn(FID, F.monotonically_increasing_id())


def profile_aggregates(geom: str | None) -> list[Column]:
    """Count, bounds and geometry type of a prepared table, all mergeable."""
    count = F.count(F.lit(1)).alias("feature_count")
    if geom is None:
        return [count]
    code = spatial.type_code(f"`{geom}`")
    order = F.when(F.col(f"`{geom}`").isNotNull(), F.col(FID))
    return [count,
            F.min(BBOX[0]).alias("min_x"), F.min(BBOX[1]).alias("min_y"),
            F.max(BBOX[2]).alias("max_x"), F.max(BBOX[3]).alias("max_y"),
            F.min_by(code, order).alias("type_code")]


def bounds_of(row: dict) -> Bounds | None:
    if row.get("min_x") is None:
        return None
    return Bounds(row["min_x"], row["min_y"], row["max_x"], row["max_y"])


def profile(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row: count, bounds, type of the first feature and all types present."""
    types = F.array_sort(F.collect_set(spatial.st_geometrytype(f"`{geom}`")))
    names = F.array(*[F.lit(GEOMETRY_TYPES[k]) for k in range(1, 8)])
    row = df.agg(*profile_aggregates(geom), types.alias("all_types"))
    first = F.coalesce(F.try_element_at(names, F.col("type_code")), F.lit("unknown"))
    return row.withColumn("geometry_type", first).drop("type_code")


def extent(df: DataFrame) -> DataFrame:
    """Bounds of a prepared table; NULL members when no feature has a geometry."""
    return df.agg(F.min(BBOX[0]).alias("min_x"), F.min(BBOX[1]).alias("min_y"),
                  F.max(BBOX[2]).alias("max_x"), F.max(BBOX[3]).alias("max_y"))


def morton_cell() -> Column:
    """Z-order code of the box centre on a 65536 x 65536 lon/lat grid."""
    def spread(v):
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    def grid(low, high, start, width):
        middle = (F.col(low) + F.col(high)) / 2
        step = F.floor((middle - start) / width * 65536)
        return F.greatest(F.lit(0), F.least(F.lit(65535), step)).cast("bigint")

    x = grid(BBOX[0], BBOX[2], -180.0, 360.0)
    y = grid(BBOX[1], BBOX[3], -90.0, 180.0)
    return F.coalesce(spread(x).bitwiseOR(F.shiftleft(spread(y), 1)), F.lit(-1).cast("bigint"))


def cell_layout(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Neighbours next to each other, so that Parquet statistics prune box filters.

    The row number is part of the range key, which lets one crowded cell spread
    over many partitions. Rows are staged with their cells, so the source runs
    once; ranges are sampled from two staged columns.
    """
    keyed = staged(df.withColumn("_cell", morton_cell()))
    args = ["_cell", FID]
    ranged = keyed.repartitionByRange(partitions, *args) if partitions else keyed.repartitionByRange(*args)
    return ranged.sortWithinPartitions(*args).drop("_cell")


def prepare_features(df: DataFrame, geom: str, srid: int | None = None) -> tuple[DataFrame, int]:
    """Row numbers, lon/lat geometry and box columns; also returns the SRID reached.

    Text geometry is read as GeoJSON.  A coordinate system without a closed form
    leaves the data as they are and is reported as SRID 0.
    """
    if isinstance(df.schema[geom].dataType, T.StringType):
        df = df.withColumn(geom, spatial.st_geomfromgeojson(f"`{geom}`"))
    source = srid if srid is not None else detect_srid(df, geom)
    reached = 4326
    if source not in (0, 4326):
        if crs.supported(source):
            df = df.withColumn(geom, spatial.st_transform(f"`{geom}`", source, 4326))
        else:
            reached = 0
    if not all(c in df.columns for c in BBOX):
        df = with_bounds(df, geom)
    return with_fid(df), reached
