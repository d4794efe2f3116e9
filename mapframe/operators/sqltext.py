"""SQL text: previews and checked queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest
from ..functions import spatial
from ..session import prepare, quoted_identifiers
from . import sqljoins

# Rows shown by default and at most.
PREVIEW_ROWS, PREVIEW_MAX = 200, 500


@dataclass(frozen=True)
class Preview:
    columns: list[dict]
    rows: list[list[str | None]]
    row_count: int


def query(spark: SparkSession, sql: str) -> DataFrame:
    """A query as a DataFrame; anything but one query is refused before it runs.

    Joins on ``ST_*`` predicates become grid joins; their inputs run here, before the result is asked for.
    """
    if not sql or not sql.strip():
        raise BadRequest("SQL query is required")
    prepare(spark)
    text = sql.strip().rstrip(";").rstrip()
    try:
        with quoted_identifiers(spark):
            found = spark.sql(f"SELECT * FROM (\n{text}\n) AS _q")
    except (ParseException, AnalysisException) as e:
        raise BadRequest(f"SQL error: {e}") from e
    return sqljoins.with_grid_joins(found)


def as_text(field: T.StructField) -> Column:
    """Text of a value: geometries as WKT with NULL spelled out, nested values as JSON."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.when(c.isNull(), F.lit("NULL")).otherwise(F.coalesce(spatial.st_astext(c), F.hex(c)))
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.try_cast("string")


def clamp(limit: int) -> int:
    return max(1, min(limit, PREVIEW_MAX))


def preview_frame(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows with every column as text."""
    return df.limit(clamp(limit)).select(*[as_text(f).alias(f.name) for f in df.schema])


def preview_sql(spark: SparkSession, sql: str, limit: int = PREVIEW_ROWS) -> Preview:
    found = query(spark, sql)
    if len({c.lower() for c in found.columns}) < len(found.columns):
        raise BadRequest("Query returns a column name twice")
    columns = [{"name": f.name, "data_type": f.dataType.simpleString(), "nullable": True} for f in found.schema]
    rows = [list(r) for r in preview_frame(found, limit).collect()]
    return Preview(columns, rows, len(rows))
