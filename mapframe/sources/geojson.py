"""GeoJSON in and out.

Reading: a file with one feature per line (newline-delimited, or a collection
written that way) is split over tasks line by line; other documents are cut at
the ends of their features (see ``documents``), also over many tasks.  A folder
may hold both kinds.  What is neither a feature, nor a geometry, nor a line of a
collection around them, is an error.
Writing: typed, valid JSON; newline-delimited files at any size, and one
collection text for pages of bounded size.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest
from ..functions import spatial
from ..operators.profile import FID, INTERNAL
from .documents import DOCUMENT, GEOMETRIES, document_features

# whole lines of a collection that hold no feature: brackets, and members of the collection itself
MEMBER = (r'("type"\s*:\s*"FeatureCollection"|"features"\s*:\s*\[|"(name|title|description|id)"\s*:\s*("[^"]*"|[0-9]+)'
          r'|"bbox"\s*:\s*\[[^\[\]]*\]|"crs"\s*:\s*\{[^{}]*(\{[^{}]*\})?[^{}]*\})')
WRAPPER = rf'^[\[\]{{}},\s]*({MEMBER}[\[\]{{}},\s]*)*$'
CRS = r'"crs"\s*:\s*\{[^}]*\{[^}]*EPSG:{1,2}(\d+)'


def read_geojson(spark: SparkSession, path: str, layout: str = "auto", schema: str | None = None) -> DataFrame:
    """Typed attributes and a ``geometry`` column of WKB; ``layout`` is auto (chosen for each file), lines or document."""
    if layout not in ("auto", "lines", "document"):
        raise BadRequest(f"Unknown layout: {layout}")
    if layout == "lines":
        features = _lines(spark, path)
    else:
        by_line, whole = _layouts(spark, path) if layout == "auto" else ([], _files(spark, path))
        parts = [read(spark, files) for read, files in ((_lines, by_line), (document_features, whole)) if files]
        features = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    features = features.select(F.monotonically_increasing_id().alias(FID), "*")
    if schema is None:
        schema = infer_properties(features)
    geometry = spatial.st_geomfromgeojson("geometry").alias("geometry")
    if not schema:
        return features.select(FID, geometry)
    typed = features.select(FID, F.from_json("properties", schema).alias("p"), geometry)
    return typed.select(FID, *[F.col(f"p.`{f.name}`") for f in T.StructType.fromDDL(schema)], "geometry")


def declared_srid(spark: SparkSession, path: str) -> int | None:
    """EPSG code of a ``crs`` member, wherever it stands; files that disagree give the smallest."""
    code = F.regexp_extract("value", CRS, 1)  # the member's inner object ends with the first brace, on whatever line
    found = spark.read.option("lineSep", "}").text(path).where(code != "").agg(F.min(code.cast("int")))
    return found.head()[0]


def _stripped() -> Column:
    return F.regexp_replace(F.trim("value"), r",$", "")


def _files(spark: SparkSession, path: str) -> list[str]:
    return spark.read.text(path).inputFiles()


def _layouts(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Names of the files in which every line is a feature, a geometry or a line around them, and of all others."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), _stripped().alias("line")).where("line <> ''")
    kind = F.from_json("line", "type string")["type"]
    own = F.coalesce(kind.isin("Feature", *GEOMETRIES), F.lit(False))
    around = F.col("line").rlike(WRAPPER) & (F.coalesce(kind, F.lit("")) != "FeatureCollection")
    by_line = {r.file for r in lines.groupBy("file").agg(F.bool_and(own | around).alias("all"), F.bool_or(own).alias("some"))
               .where("all AND some").select("file").collect()}
    # the two sources spell the same file's name in different ways
    names = {unquote(urlparse(f).path): f for f in _files(spark, path)}
    lined = {unquote(urlparse(f).path) for f in by_line}
    return sorted(by_line), sorted(f for name, f in names.items() if name not in lined)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    parsed = (spark.read.text(path).select(_stripped().alias("line")).where("line <> ''")
              .select("line", F.from_json("line", DOCUMENT).alias("f")))
    problem = F.concat(F.lit("not one feature per line: "), F.substring("line", 1, 80))
    bare = F.col("f.type").isin(*GEOMETRIES)
    known = (F.when((F.col("f.type") == "Feature") | bare, True).when(F.col("line").rlike(WRAPPER), False)
             .otherwise(F.raise_error(problem).cast("boolean")))
    return parsed.where(known).select("f.properties", F.when(bare, F.col("line")).otherwise(F.col("f.geometry")).alias("geometry"))


def infer_properties(features: DataFrame) -> str:
    """DDL of the attributes in order of first appearance, from all rows in one aggregation."""
    pairs = features.select(FID, F.posexplode(F.from_json("properties", "map<string,variant>")))
    found = (pairs.groupBy("key").agg(F.min(F.struct(FID, "pos")).alias("first"),
                                      F.schema_of_variant_agg("value").alias("type"))
             .orderBy("first").collect())
    return ", ".join(f"`{r.key.replace('`', '``')}` {_simple_type(r.type)}" for r in found)


def _simple_type(kind: str) -> str:
    if kind in ("STRING", "BOOLEAN", "BIGINT", "DOUBLE"):
        return kind
    return "DOUBLE" if kind.startswith(("DECIMAL", "FLOAT")) else "STRING"


# --- output ---------------------------------------------------------------

def feature_text(df: DataFrame, position: str, geom: str = "geometry") -> DataFrame:
    """Column ``value`` with one Feature per row; rows without a geometry are left out.

    Attributes keep their types: numbers and booleans stay as they are, text is
    always quoted and escaped, nested values become JSON.
    """
    names = [c for c in df.columns if c not in (geom, position, *INTERNAL)]
    body = (F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
            if names else F.lit("{}"))
    text = spatial.st_asgeojson(f"`{geom}`")
    shown = df.select(F.col(position), text.alias("_g"), body.alias("_p")).where("_g IS NOT NULL")
    return shown.select(F.col(position), F.concat(
        F.lit('{"type":"Feature","id":'), F.col(position).cast("string"), F.lit(',"geometry":'), F.col("_g"),
        F.lit(',"properties":'), F.col("_p"), F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str, position: str = FID, geom: str = "geometry", mode: str = "errorifexists"):
    """Newline-delimited features, one file per task."""
    feature_text(df, position, geom).select("value").write.mode(mode).text(path)


def collection(page: DataFrame, geom: str = "geometry") -> str:
    """One FeatureCollection of a bounded page; ids count the rows of the page from 0."""
    numbered = page.withColumn("_pos", F.row_number().over(Window.orderBy(FID)) - 1)
    rows = feature_text(numbered, "_pos", geom).orderBy("_pos").select("value").collect()
    return '{"type":"FeatureCollection","features":[' + ",".join(r.value for r in rows) + "]}"
