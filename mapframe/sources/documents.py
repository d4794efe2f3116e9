"""Features of whole JSON documents, read by many tasks.

A document is cut at every ``}``, wherever it stands, so a file of one line is split into byte ranges like any other. What
a ``}`` means depends on all that comes before it: whether a string is open, and how deep braces and brackets are nested.
Each byte range is summed up for either answer to the first question; a running sum over the ranges, of which there are
few, settles both, and then every piece of text between the ends of two features is put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged

DOCUMENT = "type string, properties string, geometry string"
GEOMETRIES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
SPLIT = ["file", "block"]
# where the first feature of a collection begins
HEAD = r'(?s)^.*?(?<!\\)"features"\s*:\s*\[\s*(?=\{)'


def document_features(spark: SparkSession, files: list[str]) -> DataFrame:
    """(properties, geometry) as JSON text, in the order of files and of what stands in them.

    A file holds collections, features and geometries, one or several, over any number of lines. Whatever else it holds
    is an error, as are braces that do not match. Other members of a collection are left out.
    """
    fragments = staged(_fragments(spark, files))
    starts = staged(_starts(fragments))
    nested = _nested(fragments, starts)
    ends = nested.groupBy(*SPLIT).agg(F.count_if("border").alias("ends"))
    by_file = Window.partitionBy("file").orderBy("block")
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in SPLIT],
                       F.coalesce(F.sum("ends").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    numbered = nested.join(ends, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    within = Window.partitionBy(*SPLIT).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.col("first") + F.coalesce(F.sum(F.col("border").cast("int")).over(within), F.lit(0))
    pieces = (numbered.withColumn("piece", piece).groupBy("file", "piece")
              .agg(F.sort_array(F.collect_list(F.struct("block", "place", "value"))).alias("parts"),
                   F.max("border").alias("whole"), F.min("braces").alias("least"),
                   F.max("all_braces").alias("all_braces"), F.max("all_brackets").alias("all_brackets")))
    raw = F.array_join("parts.value", "}")
    # after the last brace of a file may come white space, which is a fragment without a brace
    blank = ~F.col("whole") & (F.col("least") == -1) & raw.rlike(r"^\s+$")
    odd = (F.col("all_brackets") != 0) | ~F.col("all_braces").isin(0, -1)
    text = F.regexp_replace(F.concat(raw, F.lit("}")), r"^[\s,]+", "")
    pieces = pieces.select("file", "piece", F.col("whole") & ~odd, blank.alias("blank"), text.alias("text")).toDF(
        "file", "piece", "whole", "blank", "text")
    return _features(pieces).orderBy("file", "piece").select("properties", "geometry")


def _fragments(spark: SparkSession, files: list[str]) -> DataFrame:
    """Texts up to each ``}`` with their byte range and place in it; for either state of the quotes at its beginning,
    how many braces open, how many more brackets open than close, and how many quotes there are."""
    rows = spark.read.option("lineSep", "}").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    # an escape is a pair of characters and never begins before the fragment, because \\} is none
    quoted = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')

    def outside(open_quote: int) -> Column:
        return F.array_join(F.filter("quoted", lambda _, i: i % 2 == open_quote), "")

    def count(c: str, sign: str) -> Column:
        return F.length(c) - F.length(F.replace(F.col(c), F.lit(sign), F.lit("")))

    rows = rows.withColumn("quoted", quoted)
    rows = rows.select("file", "block", "place", "value", (F.size("quoted") - 1).alias("quotes"),
                       *[outside(p).alias(f"out_{p}") for p in (0, 1)])
    return rows.select("file", "block", "place", "value", "quotes",
                       *[count(f"out_{p}", "{").alias(f"open_{p}") for p in (0, 1)],
                       *[(count(f"out_{p}", "[") - count(f"out_{p}", "]")).alias(f"arrays_{p}") for p in (0, 1)])


def _running(fragments: DataFrame) -> DataFrame:
    """Quotes before each fragment of its byte range."""
    before = Window.partitionBy(*SPLIT).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return fragments.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))


def _depth(start: Column | int) -> tuple[Column, Column]:
    """What a fragment adds to the braces and brackets, if ``start`` quotes come before its byte range."""
    state = (F.col("quotes_before") + start) % 2
    closes = ((F.col("quotes_before") + start + F.col("quotes")) % 2 == 0).cast("int")
    return (F.when(state == 0, F.col("open_0")).otherwise(F.col("open_1")) - closes,
            F.when(state == 0, F.col("arrays_0")).otherwise(F.col("arrays_1")))


def _starts(fragments: DataFrame) -> DataFrame:
    """Quotes, braces and brackets before each byte range, and what is left open at the end of its file."""
    sums = []
    for p in (0, 1):
        braces, brackets = _depth(p)
        sums += [F.sum(braces).alias(f"braces_{p}"), F.sum(brackets).alias(f"brackets_{p}")]
    ranges = _running(fragments).groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"), *sums)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start_quotes", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    even = F.col("start_quotes") % 2 == 0
    for name in ("braces", "brackets"):
        ranges = ranges.withColumn(name, F.when(even, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1")))
    return ranges.select(*[F.col(c).alias(f"_{c}") for c in SPLIT], "start_quotes",
                         *[F.sum(n).over(Window.partitionBy("file")).alias(f"all_{n}") for n in ("braces", "brackets")],
                         *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"start_{n}") for n in ("braces", "brackets")])


def _nested(fragments: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, place, value, braces, border): the depth after each fragment, and whether a feature ends with it.

    A feature ends where the only things still open are the collection and its array, or nothing at all.
    """
    joined = _running(fragments).join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    braces, brackets = _depth(F.col("start_quotes"))
    so_far = Window.partitionBy(*SPLIT).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = joined.withColumns({
        "braces": F.col("start_braces") + F.sum(braces).over(so_far),
        "brackets": F.col("start_brackets") + F.sum(brackets).over(so_far),
        "closed": (F.col("start_quotes") + F.col("quotes_before") + F.col("quotes")) % 2 == 0})
    levels = ((F.col("braces") == 1) & (F.col("brackets") == 1)) | ((F.col("braces") == 0) & (F.col("brackets") == 0))
    return deep.select("file", "block", "place", "value", "braces", "all_braces", "all_brackets", (F.col("closed") & levels).alias("border"))


def _features(pieces: DataFrame) -> DataFrame:
    """(file, piece, properties, geometry) of the pieces that are features; raises for what is neither that nor the
    rest of a collection."""
    parsed = F.from_json("text", DOCUMENT)
    rows = pieces.withColumn("text", F.when(F.col("text").startswith("]"), F.col("text"))
                             .otherwise(F.regexp_replace("text", HEAD, ""))).withColumn("f", parsed)
    bare = F.col("f.type").isin(*GEOMETRIES)
    rest = F.col("whole") & (F.col("text").rlike(r"^\]") | (F.col("f.type") == "FeatureCollection"))
    fault = F.concat(F.when(F.col("whole"), F.lit("not GeoJSON: ")).otherwise(F.lit("braces do not match: ")), F.substring("text", 1, 80))
    wanted = (F.when(F.col("blank") | F.coalesce(rest, F.lit(False)), False)
              .when(F.col("whole") & (bare | (F.col("f.type") == "Feature")), True)
              .otherwise(F.raise_error(fault).cast("boolean")))
    return rows.where(wanted).select("file", "piece", "f.properties",
                                     F.when(bare, F.col("text")).otherwise(F.col("f.geometry")).alias("geometry"))
