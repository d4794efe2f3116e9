"""Spatial joins as equi-joins on grid cells.

Every feature belongs to a level whose cells are as large as the feature, so it
covers at most four cells there.  It is listed at its own level and at the
coarser levels the other side uses; two features meet at the coarser of their
two levels.  A pair that shares several cells is kept only in the cell that
holds the lower corner of the overlap, so nothing is shuffled to remove
duplicates.

The smaller side is broadcast only when its measured size is below a limit, and
all rows with all others would be few enough; then the other side is not
shuffled at all.  Otherwise ids, boxes and kinds alone are staged and meet on the
cell.  Where points and rectangles meet, boxes decide the exact test; for other
pairs geometries are fetched by id, and attributes for the pairs that survive;
a side that was measured to be large is never collected by the driver for that.
A cell with more rows than ``CROWD`` on either side is cut into blocks of both
sides, each pair of blocks a group of its own, and there are as many partitions
as the counted meetings ask for, so neither a group nor a task grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions import spatial
from ..functions.spatial import BBOX
from ..session import staged
from .profile import FID, with_bounds

FINEST, COARSEST = -20, 40   # powers of two of the cell size
BROADCAST_BYTES = 64 << 20   # largest side sent to every executor
BROADCAST_PAIRS = 1 << 26    # rows of one side times rows of the other with which a side is still broadcast
CROWD = 2_000                # rows of one side that meet in one group, about
TASK_MEETINGS = 1 << 22      # rows that meet in a cell, by task
MOST_TASKS = 20_000
FEW_CELLS = 1 << 20          # crowded cells that are sent to every executor, at most
FETCH_ROWS = 1 << 20         # rows of a side that may be sent to every executor to be fetched by id, at most


@dataclass(frozen=True)
class _Side:
    """Measured facts of one side, from one aggregation."""

    rows: int
    size: int
    shapes: int  # bytes of geometries alone
    levels: list[int]
    points: bool
    kinds: list[int]


def _level(d: float) -> Column:
    extent = F.greatest(F.col(BBOX[2]) - F.col(BBOX[0]), F.col(BBOX[3]) - F.col(BBOX[1])) + F.lit(2 * d)
    level = F.when(extent > 0, F.ceil(F.log2(extent))).otherwise(F.lit(FINEST))
    return F.greatest(F.lit(FINEST), F.least(F.lit(COARSEST), level)).cast("int")


def _ready(df: DataFrame, geom: str, tag: str) -> DataFrame:
    if not all(c in df.columns for c in BBOX):
        df = with_bounds(df, geom)
    if FID not in df.columns:
        raise BadRequest(f"the {tag} side needs a unique {FID} column")
    return df.where(F.col(BBOX[0]).isNotNull())


def _measure(df: DataFrame, geom: str, d: float) -> _Side:
    def size(field):
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("array", "map", "struct", "variant"):
            c = F.to_json(F.struct(c))
        elif kind not in ("string", "binary"):
            return F.lit(16)
        return F.coalesce(F.octet_length(c), F.lit(0))

    shape = F.coalesce(F.octet_length(F.col(f"`{geom}`")), F.lit(0))
    width = sum((size(f) for f in df.schema if f.name != geom), shape)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("size"), F.sum(shape).alias("shapes"),
                 F.collect_set(_level(d)).alias("levels"), F.collect_set(spatial.plain_kind(f"`{geom}`")).alias("kinds"),
                 F.bool_and((F.col(BBOX[0]) == F.col(BBOX[2])) & (F.col(BBOX[1]) == F.col(BBOX[3]))).alias("points"),
                 ).head()
    return _Side(row.n, row["size"] or 0, row.shapes or 0, sorted(row.levels), bool(row.points), sorted(row.kinds))


def _listed(other_levels: list[int], d: float) -> Column:
    """Levels of a row: its own, if the other side has rows as fine or finer, and the coarser ones of the other side."""
    own = _level(d)
    return F.array_distinct(F.concat(
        F.filter(F.array(own), lambda v: v >= min(other_levels)),
        F.filter(F.array(*[F.lit(v) for v in other_levels]), lambda v: v > own)))


def _in_cells(listed: DataFrame, tag: str, d: float) -> DataFrame:
    """One row per cell of a row with ``level`` and the box, grown by ``d``."""
    def span(low, high):
        return F.sequence(cell_of(F.col(low) - d, F.col("level")), cell_of(F.col(high) + d, F.col("level")))

    return (listed.withColumn("cx", F.explode(span(f"{tag}_x0", f"{tag}_x1")))
            .withColumn("cy", F.explode(span(f"{tag}_y0", f"{tag}_y1"))))


def _facts(geom: str, d: float, tag: str) -> list[Column]:
    """Level, box and kind of a feature, which is all that cells and box tests need."""
    ends = zip(("x0", "y0", "x1", "y1"), BBOX)
    return [_level(d).alias(f"{tag}_own"), *[F.col(c).alias(f"{tag}_{end}") for end, c in ends],
            spatial.plain_kind(f"`{geom}`").alias(f"{tag}_kind")]


def _cells(df: DataFrame, geom: str, names: list[str], other_levels: list[int], d: float, tag: str) -> DataFrame:
    """One row per (level, cell) of a feature; columns get the side's prefix."""
    return _in_cells(df.select(*[F.col(f"`{c}`").alias(f"{tag}__{c}") for c in names], F.col(FID).alias(f"{tag}_id"),
                               *_facts(geom, d, tag), F.explode(_listed(other_levels, d)).alias("level")), tag, d)


def _narrow_cells(df: DataFrame, geom: str, other_levels: list[int], d: float, tag: str) -> DataFrame:
    """The same with nothing but the id; the staged rows are what both counts and join read."""
    ids = staged(df.select(F.col(FID).alias(f"{tag}_id"), *_facts(geom, d, tag), _listed(other_levels, d).alias("levels")))
    return _in_cells(ids.select(*[c for c in ids.columns if c != "levels"], F.explode("levels").alias("level")), tag, d)


def _of(tag: str, name: str) -> Column:
    return F.col(f"`{tag}__{name}`")


def cell_of(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level.cast("double")))


def _blocks(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, dealt by the keys they meet on: the cell, and a block of either side if the cell is crowded."""
    keys = ["level", "cx", "cy"]
    counts = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "l_rows"), (right, "r_rows"))]
    counted = staged(counts[0].join(counts[1], keys))
    crowd = F.greatest("l_rows", "r_rows") > CROWD
    total = counted.agg(F.sum(F.col("l_rows").cast("double") * F.col("r_rows") + F.col("l_rows") + F.col("r_rows")).alias("meetings"),
                        F.count(F.when(crowd, 1)).alias("crowded")).head()
    tasks = int(min(MOST_TASKS, (total.meetings or 0) // TASK_MEETINGS + 1))
    if not total.crowded:
        return left.repartition(tasks, *keys), right.repartition(tasks, *keys), keys
    crowded = counted.where(crowd).select(
        *keys, *[F.ceil(F.col(n) / CROWD).cast("int").alias(parts) for n, parts in (("l_rows", "l_parts"), ("r_rows", "r_parts"))])
    crowded = F.broadcast(crowded) if total.crowded <= FEW_CELLS else crowded
    keyed = [*keys, "l_block", "r_block"]
    out = []
    for side, own, other in ((left, "l", "r"), (right, "r", "l")):
        mine, theirs = (F.coalesce(f"{tag}_parts", F.lit(1)) for tag in (own, other))
        side = side.join(crowded, keys, "left").withColumn(f"{own}_block", F.pmod(F.xxhash64(f"{own}_id"), mine).cast("int"))
        side = side.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), theirs - 1))).drop("l_parts", "r_parts")
        out.append(side.repartition(tasks, *keyed))
    return out[0], out[1], keyed


def _meeting(predicate: str, d: float) -> Column:
    """Boxes that allow the predicate, in the one cell that reports them."""
    met = F.col("level") == F.greatest("l_own", "r_own")
    near = ((F.col("l_x1") + d >= F.col("r_x0")) & (F.col("l_x0") - d <= F.col("r_x1"))
            & (F.col("l_y1") + d >= F.col("r_y0")) & (F.col("l_y0") - d <= F.col("r_y1")))
    if predicate == "within":
        near &= ((F.col("l_x0") >= F.col("r_x0")) & (F.col("l_x1") <= F.col("r_x1"))
                 & (F.col("l_y0") >= F.col("r_y0")) & (F.col("l_y1") <= F.col("r_y1")))
    corner = ((F.col("cx") == cell_of(F.greatest(F.col("l_x0") - d, F.col("r_x0")), F.col("level")))
              & (F.col("cy") == cell_of(F.greatest(F.col("l_y0") - d, F.col("r_y0")), F.col("level"))))
    return met & near & corner


POINT_KIND, BOX_KIND, AREA_KIND = spatial.POINT_KIND, spatial.BOX_KIND, spatial.AREA_KIND
# kinds of both sides for which boxes that pass ``_meeting`` decide, as ``_by_boxes`` does
DECIDED = {"intersects": [(POINT_KIND, POINT_KIND), (POINT_KIND, BOX_KIND), (BOX_KIND, POINT_KIND), (BOX_KIND, BOX_KIND)],
           "within": [(POINT_KIND, POINT_KIND), (POINT_KIND, BOX_KIND), (BOX_KIND, BOX_KIND), (AREA_KIND, BOX_KIND)],
           "distance": [(POINT_KIND, POINT_KIND)]}


def _by_boxes(predicate: str, d: float) -> Column:
    """The exact test of a decided pair."""
    if predicate == "distance":
        return F.hypot(F.col("l_x0") - F.col("r_x0"), F.col("l_y0") - F.col("r_y0")) <= d
    if predicate == "within":  # a point on the boundary of a rectangle is not within it
        inside = ((F.col("l_x0") > F.col("r_x0")) & (F.col("l_x0") < F.col("r_x1"))
                  & (F.col("l_y0") > F.col("r_y0")) & (F.col("l_y0") < F.col("r_y1")))
        return (F.col("l_kind") != POINT_KIND) | (F.col("r_kind") == POINT_KIND) | inside
    return F.lit(True)


def _exact(predicate: str, d: float, l: Column, r: Column) -> Column:
    if predicate == "distance":
        return spatial.st_distance(l, r) <= d
    return spatial.st_intersects(l, r) if predicate == "intersects" else spatial.st_within(l, r)


def _passing(pairs: DataFrame, predicate: str, d: float, a: _Side, b: _Side, geometries, out: list[Column]) -> DataFrame:
    """``out`` of pairs that pass the exact test; ``geometries`` adds ``_l`` and ``_r`` to those that boxes do not decide."""
    if a.points and b.points:
        return (pairs.where(_by_boxes(predicate, d)) if predicate == "distance" else pairs).select(*out)
    kinds = [(x, y) for x in a.kinds for y in b.kinds]
    known = [k for k in kinds if k in DECIDED[predicate]]
    decided = F.lit(False)
    for x, y in known:
        decided |= (F.col("l_kind") == x) & (F.col("r_kind") == y)
    found = []
    if known:
        found.append(pairs.where(decided & _by_boxes(predicate, d)).select(*out))
    if len(known) < len(kinds) or not kinds:
        asked = geometries(pairs.where(~decided))
        found.append(asked.where(_exact(predicate, d, F.col("_l"), F.col("_r"))).select(*out))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def joined_pairs(left: DataFrame, right: DataFrame, predicate: str, left_geom="geometry", right_geom="geometry",
                 distance: float = 0.0, broadcast_bytes: int = BROADCAST_BYTES, only_ids: bool = False) -> DataFrame:
    """Pairs that pass the predicate, each once, columns ``l__*`` and ``r__*``; with ``only_ids`` nothing but the ids."""
    # pairs are made of rows with a box, so what is fetched for them by id needs no such filter, and no geometry for it
    whole = {"l": left, "r": right}
    left, right = _ready(left, left_geom, "left"), _ready(right, right_geom, "right")
    a, b = _measure(left, left_geom, distance), _measure(right, right_geom, 0.0)
    # every feature is listed at most 4 times per level
    copies_l, copies_r = 4 * (1 + len(b.levels)), 4 * (1 + len(a.levels))
    sides = ((left, left_geom, "l"), (right, right_geom, "r"))
    names = [[FID] if only_ids else side.columns for side, _, _ in sides]
    l_levels, r_levels = b.levels or [COARSEST], a.levels or [COARSEST]
    if min(a.size * copies_l, b.size * copies_r) <= broadcast_bytes and a.rows * b.rows <= BROADCAST_PAIRS:
        with_geom = [[*dict.fromkeys([*n, geom])] for n, (_, geom, _) in zip(names, sides)]
        l_cells = _cells(left, left_geom, with_geom[0], l_levels, distance, "l")
        r_cells = _cells(right, right_geom, with_geom[1], r_levels, 0.0, "r")
        if a.size * copies_l < b.size * copies_r:
            l_cells = F.broadcast(l_cells)
        else:
            r_cells = F.broadcast(r_cells)
        pairs = l_cells.join(r_cells, ["level", "cx", "cy"]).where(_meeting(predicate, distance))
        return _passing(pairs, predicate, distance, a, b, lambda some: some.withColumns(
            {"_l": _of("l", left_geom), "_r": _of("r", right_geom)}), [_of(tag, c) for n, tag in zip(names, "lr") for c in n])

    measured = {"l": a, "r": b}

    def large(tag, size):
        """Spark guesses the size of computed columns, so it would collect and send such a side."""
        return measured[tag].rows > FETCH_ROWS or size + 16 * measured[tag].rows > BROADCAST_BYTES

    def fetched(pairs, tag, columns, size):
        side = whole[tag].select(F.col(FID).alias("_key"), *columns)
        return pairs.join(side.hint("merge") if large(tag, size) else side, F.col(f"{tag}_id") == F.col("_key")).drop("_key")

    def geometries(some):
        some = some.select("l_id", "r_id")
        # what is fetched first travels to the second side, so that is the lighter one; small sides come to the pairs
        order = sorted(sides, key=lambda s: (not large(s[2], measured[s[2]].shapes),
                                             measured[s[2]].shapes / max(1, measured[s[2]].rows)))
        for _, geom, tag in order:
            some = fetched(some, tag, [F.col(f"`{geom}`").alias(f"_{tag}")], measured[tag].shapes)
        return some

    l_cells, r_cells, keys = _blocks(_narrow_cells(left, left_geom, l_levels, distance, "l"),
                                     _narrow_cells(right, right_geom, r_levels, 0.0, "r"))
    pairs = l_cells.join(r_cells, keys).where(_meeting(predicate, distance))
    found = _passing(pairs, predicate, distance, a, b, geometries, [F.col("l_id"), F.col("r_id")])
    if only_ids:
        return found.select(F.col("l_id").alias(f"l__{FID}"), F.col("r_id").alias(f"r__{FID}"))
    for side, _, tag in sides:
        found = fetched(found, tag, [F.col(f"`{c}`").alias(f"{tag}__{c}") for c in side.columns], measured[tag].size)
    return found.drop("l_id", "r_id")


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", how: str = "inner",
                 distance: float | None = None, left_geom: str = "geometry", right_geom: str = "geometry",
                 suffix: str = "_right", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join two feature tables by ``intersects``, ``within`` or ``distance``.

    ``how`` is inner, left, left_semi or left_anti.  Right columns whose name is
    taken get the suffix.  Both sides carry a unique ``_fid``.
    """
    if predicate not in ("intersects", "within", "distance"):
        raise BadRequest(f"Unknown spatial predicate: {predicate}")
    if (predicate == "distance") != (distance is not None):
        raise BadRequest("distance goes with the distance predicate")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise BadRequest(f"Unsupported join type: {how}")
    l_columns, r_columns = left.columns, right.columns
    left, right = (side if all(c in side.columns for c in BBOX) else with_bounds(side, geom)
                   for side, geom in ((left, left_geom), (right, right_geom)))
    pairs = joined_pairs(left, right, predicate, left_geom, right_geom, distance or 0.0, broadcast_bytes, how != "inner")

    taken = {c.lower() for c in l_columns}
    r_names = {c: c + suffix if c.lower() in taken else c for c in r_columns}
    def out(rows):
        return rows.select(*[_of("l", c).alias(c) for c in l_columns], *[_of("r", c).alias(n) for c, n in r_names.items()])

    if how == "inner":
        return out(pairs)
    # distinct ids: a left feature with very many partners stays one row
    ids = pairs.select(_of("l", FID).alias(FID))
    if how == "left_semi":
        return left.join(ids.distinct(), FID, "left_semi").select(*l_columns)
    if how == "left_anti":
        return left.join(ids.distinct(), FID, "left_anti").select(*l_columns)
    # pairs serve twice, so they are found once
    found = staged(pairs.select(_of("l", FID).alias("l_id"), _of("r", FID).alias("r_id")))
    matched = found
    for side, tag in ((left, "l"), (right, "r")):
        matched = matched.join(side.select(*[F.col(f"`{c}`").alias(f"{tag}__{c}") for c in side.columns]),
                               F.col(f"{tag}_id") == _of(tag, FID))
    matched = out(matched)
    unmatched = left.join(found.select(F.col("l_id").alias(FID)).distinct(), FID, "left_anti").select(*l_columns)
    types = {n: right.schema[c].dataType for c, n in r_names.items()}
    empty = [F.lit(None).cast(t).alias(n) for n, t in types.items()]
    return matched.unionByName(unmatched.select("*", *empty))
