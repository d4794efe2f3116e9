"""Union of the geometries of a group.

Geometries are merged in rounds of bounded groups: neighbours within one grid cell
first, at most ``FAN_IN`` at a time, then coarser cells, until one geometry per
key is left.  Copies are removed before the first shuffle.  Every round is
written to the checkpoint folder, so a lost executor repeats one round at most.

Lines alone are merged edge by edge instead: distinct edges are sorted by direction, then by
distance from the origin, so those on one line are neighbours; each line is swept by itself,
and what is left is strung together as it streams by, so a task holds one result, not its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest
from ..functions import codec, overlay, spatial
from ..functions.spatial import BBOX
from ..session import scratch_path, staged
from .profile import with_bounds

FAN_IN = 32
GROUP_EDGES = 1 << 16  # edges for which a result gets a task of its own
MANY_GROUPS = 1 << 20
EDGE = ("_x0", "_y0", "_x1", "_y1")  # the low end comes first


def dissolve_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """One multipoint WKB per group from the distinct points, sorted by x, then y."""
    distinct = df.where(F.col(BBOX[0]).isNotNull()).select(
        *keys, F.col(BBOX[0]).alias("x"), F.col(BBOX[1]).alias("y")).distinct()
    grouped = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    return grouped.withColumn("geometry", _multipoint(F.col("points.x"), F.col("points.y"))).drop("points")


@F.arrow_udf(T.BinaryType())
def _multipoint(xs: pa.Array, ys: pa.Array) -> pa.Array:
    rows = zip(xs.to_pylist(), ys.to_pylist())
    return pa.array([codec.encode((codec.MULTIPOINT, [(codec.POINT, p) for p in zip(x, y)])) for x, y in rows],
                    pa.binary())


def dissolve_polygons(df: DataFrame, keys: list[str], geom: str = "geometry") -> DataFrame:
    """One geometry per group covering exactly what its members cover, of points, lines and polygons alike.

    What several lines cover counts once. Lines are not cut where they only cross, because long lines may cross as often
    as there are pairs of them; ``ST_Union`` of two geometries does cut there. A group without any geometry that covers something has NULL.
    """
    spark = df.sparkSession
    if any(k.startswith("_") for k in keys):
        raise BadRequest("key names must not start with an underscore")
    boxed = df if all(c in df.columns for c in BBOX) else with_bounds(df, geom)
    current = (boxed.where(F.col(BBOX[0]).isNotNull())
               .select(*keys, F.col(f"`{geom}`").alias("geometry")).distinct())
    groups = current.select(*keys).distinct().count()
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", geometry binary"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = overlay.union([codec.parse(g) for g in pdf["geometry"]], crossings=False)
        out = pdf[keys].head(1).copy()
        out["geometry"] = codec.encode(merged)
        return out

    west, south, size, reach = _grid(boxed, geom)
    every = df.select(*[F.col(k).alias(f"_every_{k}") for k in keys]).distinct()
    if reach is not None:
        done, covered = _dissolve_lines(current, keys, reach, groups)
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_every_{k}")) for k in keys], F.lit(True))
        rest = every.join(covered, same, "left_anti")
        return done.unionByName(rest.select(*[F.col(f"_every_{k}").alias(k) for k in keys],
                                            F.lit(None).cast("binary").alias("geometry")))
    while True:
        # counted from the lower corner, so that growing cells end as one cell
        cell = [F.floor(((F.col(low) + F.col(high)) / 2 - start) / size).alias(name)
                for low, high, start, name in ((BBOX[0], BBOX[2], west, "_cx"), (BBOX[1], BBOX[3], south, "_cy"))]
        # what covers nothing has no box, would never meet the others, and adds nothing to them
        placed = (with_bounds(current, "geometry").where(F.col(BBOX[0]).isNotNull())
                  .select(*keys, "geometry", *cell))
        cells = [*keys, "_cx", "_cy"]
        crowd = placed.groupBy(*[F.col(c).alias(f"_crowd_{c}") for c in cells]).agg(
            F.ceil(F.count(F.lit(1)) / FAN_IN).alias("_splits"))
        same = [F.col(c).eqNullSafe(F.col(f"_crowd_{c}")) for c in cells]
        spread = placed.join(crowd, reduce(and_, same)).select(*placed.columns, "_splits")
        salted = spread.withColumn("_salt", F.pmod(F.xxhash64("geometry"), F.col("_splits")))
        merged = salted.groupBy(*keys, "_cx", "_cy", "_salt").applyInPandas(merge, schema)
        path = scratch_path(spark)
        merged.write.parquet(path)
        current = spark.read.schema(schema).parquet(path)
        if current.count() <= groups:
            break
        size *= 8
    done = with_bounds(current, "geometry").where(F.col(BBOX[0]).isNotNull()).select(*keys, "geometry")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_every_{k}")) for k in keys], F.lit(True))
    return every.join(done, same, "left").select(*[F.col(f"_every_{k}").alias(k) for k in keys], "geometry")


def _dissolve_lines(lines: DataFrame, keys: list[str], reach: float, groups: int) -> tuple[DataFrame, DataFrame]:
    """One geometry for each key of lines whose coordinates go up to ``reach``, the same as a union without crossings; and
    the keys that have one."""
    named = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys) + (", " if keys else "")
    doubles = ", ".join(f"{c} double" for c in EDGE)
    edges = staged(lines.select(*keys, "geometry").mapInArrow(_edges, named + doubles).distinct())
    lined = staged(_on_lines(edges.withColumn("_id", F.monotonically_increasing_id()), keys, reach))
    shared = lined.where(~F.col("_alone")).drop("_alone").repartition("_line").sortWithinPartitions("_line")
    pieces = lined.where("_alone").select(*keys, "_key", *EDGE).union(
        shared.mapInArrow(_swept, f"{named}_line long, _key long, {doubles}").select(*keys, "_key", *EDGE))
    pieces = staged(pieces).withColumn("_id", F.monotonically_increasing_id())
    # where exactly two pieces end they are joined
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(i).alias("end"))
                               for i, (x, y) in enumerate((EDGE[:2], EDGE[2:]))]))
    met = (pieces.select("_key", "_id", ends.alias("e")).groupBy("_key", "e.x", "e.y")
           .agg(F.count(F.lit(1)).alias("n"), *[f(F.struct("_id", "e.end")).alias(c) for f, c in ((F.min, "a"), (F.max, "b"))])
           .where("n = 2").select(F.explode(F.array("a", "b")).alias("m"))
           .groupBy(F.col("m._id").alias("_met")).agg(*[F.max(F.col("m.end") == i).alias(f"_join{i}") for i in (0, 1)]))
    joined = [F.coalesce(F.col(f"_join{i}"), F.lit(False)).alias(f"_join{i}") for i in (0, 1)]
    flagged = pieces.join(staged(met), F.col("_id") == F.col("_met"), "left").select(*keys, "_key", *EDGE, *joined)
    strung = flagged.repartition("_key").sortWithinPartitions("_key").mapInArrow(_strung(keys), f"{named}_key long, geometry binary")
    # a row may be very large, so those of large groups come one to a task
    n = max(1, min(groups, max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.count() // GROUP_EDGES)))
    numbers = pieces.select(F.col("_key").alias("_of")).distinct().select(
        "_of", ((F.row_number().over(Window.orderBy("_of")) - 1) % n).cast("int").alias("_task"))
    dealt = strung.join(F.broadcast(numbers) if groups <= MANY_GROUPS else numbers, F.col("_key") == F.col("_of"))
    done = dealt.repartitionById(n, "_task").select(*keys, "geometry")
    return done, pieces.select(*keys).distinct()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges, owner = overlay.line_edges(codec.decode(batch.column(batch.num_columns - 1)))
        names = batch.schema.names[:-1]
        yield _with_edges(batch.select(names).take(pa.array(owner)), edges)


def _with_edges(batch: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in edges.T)], [*batch.schema.names, *EDGE])


def _on_lines(edges: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Adds the key's number, the number of the line that an edge lies on, and whether it is alone there.

    As in a union within one task: a line ends where the next edge is farther away than roundings explain.
    """
    x0, y0, x1, y1 = map(F.col, EDGE)
    dx, dy = x1 - x0, y1 - y0
    first = Window.partitionBy(*keys).orderBy("_angle")
    second = Window.partitionBy(*keys, "_bundle").orderBy("_away")

    def begins(column, window, tolerance):
        return F.coalesce(F.col(column) - F.lag(column).over(window) > tolerance, F.lit(True))

    def latest(window):
        return F.last(F.when(F.col("_begins"), F.col("_id")), ignorenulls=True).over(
            window.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    placed = edges.withColumns({"_angle": F.atan2(dy, dx), "_away": (x0 * dy - y0 * dx) / F.hypot(dx, dy)})
    placed = placed.withColumns({"_begins": begins("_angle", first, overlay.SAME_LINE),
                                 "_key": F.first("_id").over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = placed.withColumn("_bundle", latest(first))
    placed = placed.withColumn("_begins", begins("_away", second, overlay.SAME_LINE * reach))
    alone = F.col("_begins") & F.coalesce(F.lead("_begins").over(second), F.lit(True))
    return placed.withColumns({"_line": latest(second), "_alone": alone}).select(*keys, "_line", "_key", *EDGE, "_alone")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the edges of whole lines, which come in order."""
    def done(held):
        table = pa.Table.from_batches(held).combine_chunks()
        edges = np.column_stack([table.column(c).to_numpy() for c in EDGE])
        pieces, owner = overlay.swept(edges, table.column("_line").to_numpy())
        rows = table.drop_columns(list(EDGE)).take(pa.array(owner)).combine_chunks().to_batches()
        return [_with_edges(rows[0], pieces)] if rows else []

    held: list[pa.RecordBatch] = []
    for batch in batches:
        line = batch.column("_line").to_numpy()
        if not len(line):
            continue
        last = int(np.searchsorted(line, line[-1]))  # the last line may go on
        if held and (last or held[-1].column("_line")[-1].as_py() != line[0]):
            yield from done([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield from done([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield from done(held)


def _strung(keys: list[str]):
    """One geometry for each key from its pieces, which come in order; those that stay alone are written as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, now, written, count, linked = None, None, bytearray(9), 0, []

        def done():
            n = count
            if linked:
                chains = overlay.joined(np.concatenate([p for p, _ in linked]), np.concatenate([j for _, j in linked]))
                n += len(chains)
                for chain in chains:
                    written.extend(codec.encode((codec.LINE, chain)))
            written[:9] = b"" if n == 1 else codec.multiline_head(n)
            geometry = pa.Array.from_buffers(pa.binary(), 1, [  # without a copy
                None, pa.py_buffer(np.array([0, len(written)], "i4")), pa.py_buffer(written)])
            return pa.RecordBatch.from_arrays([*row.columns, pa.array([now]), geometry], [*keys, "_key", "geometry"])

        for batch in batches:
            number = batch.column("_key").to_numpy()
            edges = np.column_stack([batch.column(c).to_numpy() for c in EDGE])
            joins = np.column_stack([np.asarray(batch.column(f"_join{i}")) for i in (0, 1)]).astype(bool)
            bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if number[a] != now:
                    if row is not None:
                        yield done()
                    row, now, written, count, linked = batch.select(keys).slice(a, 1), int(number[a]), bytearray(9), 0, []
                linking = joins[a:b].any(axis=1)
                own = edges[a:b][~linking]
                written.extend(codec.edges_as_lines(own))
                count += len(own)
                if linking.any():
                    linked.append((edges[a:b][linking], joins[a:b][linking]))
        if row is not None:
            yield done()

    return run


def _grid(boxed: DataFrame, geom: str) -> tuple[float, float, float, float | None]:
    """Lower corner of all features, a first cell size of four times their average width, and the largest coordinate if
    there are only lines."""
    width = F.greatest(F.col(BBOX[2]) - F.col(BBOX[0]), F.col(BBOX[3]) - F.col(BBOX[1]))
    lines = spatial.type_code(F.col(f"`{geom}`")).isin(codec.LINE, codec.MULTILINE)
    reach = F.max(F.greatest(*[F.abs(c) for c in BBOX]))
    row = boxed.agg(F.min(BBOX[0]), F.min(BBOX[1]), F.avg(width), F.min(lines | F.col(BBOX[0]).isNull()), reach).head()
    return row[0] or 0.0, row[1] or 0.0, 4 * (row[2] or 1.0), (row[4] or 0.0) if row[3] else None
