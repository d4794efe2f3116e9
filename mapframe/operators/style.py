"""Data-driven colours: one colour, a ramp over numbers, or one colour per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.color import (CATEGORY_COLORS, DEFAULT_FILL, GREY, js_round, parse_hex, ramp_color, rgba)
from .features import with_position
from .profile import FID


def as_number(df: DataFrame, column: str) -> Column:
    """The value as a double: text is parsed, booleans are 0/1, times are epoch milliseconds."""
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        text = F.trim(c)
        return F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return (F.unix_micros(c.cast("timestamp")) / 1000).cast("double")
    return c.cast("double")


def is_numeric(df: DataFrame, column: str) -> bool:
    """Whether every non-NULL value reads as a number; only text needs to be looked at."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        return isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))
    bad = F.col(f"`{column}`").isNotNull() & as_number(df, column).isNull()
    return not df.where(bad).limit(1).count()


def style_statistics(df: DataFrame, column: str) -> DataFrame:
    """Range of the numeric values and number of distinct values, in one aggregation."""
    v = as_number(df, column)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"),
                  F.count(F.col(f"`{column}`")).alias("non_null"),
                  F.countDistinct(F.col(f"`{column}`")).alias("distinct_values"))


def classify_graduated(df: DataFrame, column: str, colors: list[str], opacity: float = 0.8,
                       out: str = "fill") -> DataFrame:
    """Ramp colour by position between the smallest and largest value; NULL is grey."""
    alpha = js_round(opacity * 255)
    v = as_number(df, column)
    limits = df.agg(F.min(v).alias("low"), F.max(v).alias("high"))
    low, high = limits.select("low").scalar(), limits.select("high").scalar()
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    # a column of its own, because the ramp refers to the position many times
    placed = df.withColumn("_t", (v - low) / span)
    color = ramp_color(F.col("_t"), colors, alpha)
    return placed.withColumn(out, F.when(v.isNull(), rgba((*GREY, alpha))).otherwise(color)).drop("_t")


def category_order(df: DataFrame, column: str, key: str = FID) -> DataFrame:
    """Distinct values as text with their index in order of first appearance."""
    text = F.col(f"`{column}`").cast("string")
    first = (df.where(F.col(f"`{column}`").isNotNull()).groupBy(text.alias("_value"))
             .agg(F.min(key).alias("_first")))
    return with_position(first, "_first", "_index").select("_value", "_index")


def classify_categorized(df: DataFrame, column: str, colors: list[str], opacity: float = 0.8,
                         out: str = "fill", key: str = FID) -> DataFrame:
    """Colour per value by first appearance: the ramp when it is long enough, else the palette.

    The table of categories is joined without a hint: it is broadcast only when
    its measured size is small.
    """
    alpha = js_round(opacity * 255)
    order = category_order(df, column, key)
    total = order.agg(F.count(F.lit(1))).scalar()

    def pick(palette, index):
        return F.get(F.array(*[rgba(parse_hex(c, alpha)) for c in palette]), index.cast("int"))

    index = F.col("_index")
    color = F.when(total <= len(colors), pick(colors, index)).otherwise(
        pick(CATEGORY_COLORS, index % len(CATEGORY_COLORS)))
    joined = df.join(order.withColumn("_color", color).drop("_index"),
                     F.col(f"`{column}`").cast("string") == F.col("_value"), "left")
    return joined.withColumn(out, F.coalesce("_color", rgba((*GREY, alpha)))).drop("_value", "_color")


def classify(df: DataFrame, style: dict, opacity: float | None = None, out: str = "fill", key: str = FID) -> DataFrame:
    """Fill colour of a layer style: ``type``, ``property``, ``colors``, ``fillColor``.

    ``breaks`` and ``categories`` may be present and are not used.  A graduated
    style on a column that is not numeric colours by category.
    """
    opacity = opacity if opacity is not None else style.get("opacity", 0.8)
    alpha = js_round(opacity * 255)
    plain = rgba(parse_hex(style.get("fillColor") or DEFAULT_FILL, alpha))
    column, colors, kind = style.get("property"), style.get("colors"), style.get("type", "simple")
    if not column or not colors or kind == "simple" or column not in df.columns:
        return df.withColumn(out, plain)
    some = df.where(F.col(f"`{column}`").isNotNull()).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    graduated = kind == "graduated" and is_numeric(df, column)
    painted = (classify_graduated(df, column, colors, opacity, out) if graduated
               else classify_categorized(df, column, colors, opacity, out, key))
    return painted.withColumn(out, F.when(some, F.col(out)).otherwise(plain))
