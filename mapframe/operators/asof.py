"""As-of join: the latest right row at or before each left row, per key.

Both sides are put in one order of key and time and cut into range partitions, so
a key that holds most rows, even within one moment, is spread over many tasks.
Within a partition a window finds the latest row; across partitions only one
summary row per key and partition is looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import in_order


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str = "latest") -> DataFrame:
    """``left`` with the struct ``out`` of time and value of the latest right row, NULL without one.

    NULL keys and NULL times match nothing. Of right rows at the same time, the one with the largest value counts.
    """
    row = F.struct(F.col(time).alias("time"), F.col(value).alias("value"))
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    marks = right.where(known).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), row.alias("_r"))
    names = [F.col(f"`{c}`") for c in left.columns]
    rows = left.where(known).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"),
                                    F.struct(*names).alias("_left"))
    # right rows before left rows at the same time; the rest only spreads rows that agree in everything else
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_spread", F.xxhash64(F.to_json("_left")))
    ordered = in_order(both, "_k", "_t", "_side", "_r", "_spread")

    so_far = Window.partitionBy("_part", "_k").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ordered.withColumn("_near", F.last("_r", ignorenulls=True).over(so_far)).where("_side = 1")
    # carried into a partition: the latest right row of the key in all earlier ones; right rows are in order of _r
    last = ordered.groupBy("_k", "_part").agg(F.max("_r").alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_k", "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carry")).where("_carry IS NOT NULL")

    matched = found.join(carried, ["_k", "_part"], "left").select("_left.*", F.coalesce("_near", "_carry").alias(out))
    alone = left.where(~known).select("*", F.lit(None).cast(matched.schema[out].dataType).alias(out))
    return matched.unionByName(alone)
