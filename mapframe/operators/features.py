"""Feature queries: projection, box filter, attribute filter, paging, lookups."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions import spatial
from ..functions.spatial import BBOX
from ..session import quoted_identifiers, staged
from .profile import FID, INTERNAL

# Limits of one request.
MAX_FEATURES = 500_000
NEAR = 5_000  # pages up to here are one top-k
MAX_DISTINCT = 100


# --- box ------------------------------------------------------------------

def parse_bbox(bbox) -> tuple[float, float, float, float] | None:
    """Four finite numbers, strictly ordered, from text or a sequence."""
    if bbox is None:
        return None
    values = bbox.split(",") if isinstance(bbox, str) else list(bbox)
    if len(values) != 4:
        raise BadRequest("bbox must have 4 comma-separated values: minx,miny,maxx,maxy")
    try:
        x0, y0, x1, y1 = (float(v) for v in values)
    except (TypeError, ValueError):
        raise BadRequest("bbox values must be valid numbers") from None
    if not all(map(math.isfinite, (x0, y0, x1, y1))):
        raise BadRequest("bbox values must be finite")
    if x0 >= x1 or y0 >= y1:
        raise BadRequest("bbox min must be less than max")
    return x0, y0, x1, y1


def box_overlap(bbox) -> Column:
    """Closed overlap of the box columns with a box; reaches the Parquet scan."""
    x0, y0, x1, y1 = bbox
    return ((F.col(BBOX[2]) >= x0) & (F.col(BBOX[0]) <= x1)
            & (F.col(BBOX[3]) >= y0) & (F.col(BBOX[1]) <= y1))


def bbox_filter(df: DataFrame, bbox, geom: str = "geometry", points: bool = False) -> DataFrame:
    """Features that touch the box.

    The box columns decide first, inside the scan.  Points need no more; of the
    others only those that stick out of the box go through the exact test.
    """
    bbox = parse_bbox(bbox)
    if bbox is None:
        return df
    near = df.where(box_overlap(bbox))
    if points:
        return near
    x0, y0, x1, y1 = bbox
    contained = ((F.col(BBOX[0]) >= x0) & (F.col(BBOX[2]) <= x1)
                 & (F.col(BBOX[1]) >= y0) & (F.col(BBOX[3]) <= y1))
    crossing = F.when(~contained, F.col(f"`{geom}`"))
    exact = spatial.st_intersects(crossing, spatial.st_makeenvelope(x0, y0, x1, y1))
    return near.where(contained | F.coalesce(exact, F.lit(False)))


# --- projection, filter, statistics ---------------------------------------

def project(df: DataFrame, geom: str = "geometry", keep_fid: bool = False) -> DataFrame:
    """Attributes in table order, geometry last under the name ``geometry``."""
    names = [c for c in df.columns if c not in INTERNAL and c != geom]
    columns = [F.col(f"`{c}`") for c in names] + [F.col(f"`{geom}`").alias("geometry")]
    return df.select(*columns, *([FID] if keep_fid else []))


def where_text(df: DataFrame, condition: str | None) -> DataFrame:
    """Filter by a SQL condition; blank text keeps everything."""
    if not condition or not condition.strip():
        return df
    with quoted_identifiers(df.sparkSession):
        return df.where(condition)


def _attribute(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or ""):
        raise BadRequest(f"Invalid column name: {name}")
    return name


def column_range(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value as doubles; NULLs when there is none."""
    c = F.col(_attribute(column))
    return df.where(c.isNotNull()).agg(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))


def unique_values(df: DataFrame, column: str, limit: int = MAX_DISTINCT) -> DataFrame:
    """The first distinct non-NULL values in sort order."""
    c = F.col(_attribute(column))
    return df.where(c.isNotNull()).select(c.alias("val")).distinct().orderBy("val").limit(limit)


# --- order, paging --------------------------------------------------------

def cap_limit(requested: int | None, count: int, cap: int | None = MAX_FEATURES) -> tuple[int, bool]:
    """(rows to return, whether the cap cut something off)."""
    wanted = count if requested is None else requested
    return (wanted, False) if cap is None else (min(wanted, cap), wanted > cap)


def in_order(df: DataFrame, *keys) -> DataFrame:
    """``df`` staged in the order of ``keys``, with ``_part`` and ``_place``: range partition and place within it.

    Partitions are ranges of the keys as they are spread, so sparse or crowded values make no partition large; only rows
    that agree in all keys have to share one.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()  # partition number in the upper bits, row number within it in the others
    ordered = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("_number", number)
    return staged(ordered).withColumns({"_part": F.shiftright("_number", 33),
                                        "_place": F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_number")


def with_position(df: DataFrame, key: str = FID, out: str = "_pos") -> DataFrame:
    """Dense 0-based position in the order of a unique key of any orderable type.

    Rows are counted by range partition; only those counts, one for each partition, pass a running sum.
    """
    ordered = in_order(df, key)
    counts = ordered.groupBy(F.col("_part").alias("_counted")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_counted").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_counted", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (ordered.join(F.broadcast(starts), F.col("_part") == F.col("_counted"))
            .withColumn(out, F.col("_before") + F.col("_place")).select(*df.columns, out))


def page(df: DataFrame, limit: int, offset: int = 0, key: str = FID, near: int = NEAR, accuracy: int = 10_000) -> DataFrame:
    """Rows ``offset .. offset + limit`` in the order of a unique key.

    Some thousand rows near the start are one top-k.  For larger or deeper pages approximate quantiles give a range of
    keys around the page and a count tells what lies before it, round by round until the range holds little else; so
    no task merges large top-k lists, however the keys are spread.
    """
    if limit < 0 or offset < 0:
        raise BadRequest("limit and offset must not be negative")
    if offset + limit <= near:
        return df.orderBy(key).offset(offset).limit(limit)
    rows = df.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull())
    total = rows.count()
    if offset >= total:
        return df.limit(0)
    inside, count, skipped, slack = F.lit(True), total, 0, 2 / accuracy
    while count > limit + near:
        first = (offset - skipped) / count
        ends = [max(0.0, first - slack), min(1.0, first + limit / count + slack)]
        low, high = rows.where(inside).agg(F.percentile_approx("_key", ends, accuracy)).head()[0]
        within = F.col("_key").between(low, high)
        below, found = rows.where(inside).agg(F.count_if(F.col("_key") < low), F.count_if(within)).head()
        if below > offset - skipped or below + found < min(offset + limit, total) - skipped:
            slack *= 4  # the sketch was off by more than it promised
            continue
        if found > 0.9 * count:
            break
        inside, count, skipped = within, found, skipped + below
    in_range = df.withColumn("_key", F.col(key)).where(inside).drop("_key")
    return in_range.orderBy(key).offset(offset - skipped).limit(limit)


# --- identify -------------------------------------------------------------

def identify(df: DataFrame, x: float, y: float, tolerance: float = 0.0,
             geom: str = "geometry", points: bool = False) -> DataFrame:
    """Features within ``tolerance`` of a place, attributes as display text, nearest first."""
    near = df.where(box_overlap((x - tolerance, y - tolerance, x + tolerance, y + tolerance)))
    if points:
        distance = F.hypot(F.col(BBOX[0]) - x, F.col(BBOX[1]) - y)
    else:
        distance = spatial.st_distance(f"`{geom}`", spatial.st_point(x, y))
    found = near.withColumn("_distance", distance).where(F.col("_distance") <= tolerance)
    texts = [display_text(df.schema[c]).alias(c) for c in df.columns if c not in INTERNAL and c != geom]
    order = ["_distance", FID] if FID in df.columns else ["_distance"]
    return found.orderBy(*order).select(*texts)


def display_text(field) -> Column:
    """Whole numbers as they are, other numbers with 4 decimals, long text cut at 120."""
    c = F.col(f"`{field.name}`")
    kind = field.dataType.typeName()
    if kind in ("double", "float", "decimal"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.coalesce(F.when(whole, c.cast("decimal(38,0)").cast("string"))
                          .otherwise(F.format_string("%.4f", c.cast("double"))), F.lit("NULL"))
    text = F.to_json(c) if kind in ("struct", "array", "map") else c.cast("string")
    cut = F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 120), F.lit("…"))).otherwise(text)
    return F.coalesce(cut, F.lit("NULL"))
