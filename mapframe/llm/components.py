"""Connected components of a table of links, by turns of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import FEW, counted, packed, small, written


def _to_least(edges: DataFrame, u: str, v: str, rows: int) -> DataFrame:
    """Every edge (u, v) with the least of u and all of its v."""
    least = edges.groupBy(F.col(u).alias("_k")).agg(F.min(v).alias("_m"))
    least = F.broadcast(packed(least, rows)) if rows <= FEW else least
    return packed(edges.join(least, F.col(u) == F.col("_k")), rows).select(u, v, F.least(u, "_m").alias("m"))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(doc_id, label) for every id in links (a, b), ``rows`` of them if that is known: label is the smallest id that can be reached.

    Each round keeps the components, and ends when every id points at its smallest. Minima are taken before rows are
    dealt out and joined back, so that an id with very many links is split like any other large key.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    edges, rows = counted(edges if rows is None else packed(edges, rows))
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, "u", "v", rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = packed(large.where("u <> v").distinct(), rows)
        least = _to_least(large, "u", "v", rows)  # here v < u
        edges = (least.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = Observation()
        edges = written(packed(edges, rows).observe(seen, F.count("*").alias("n"),
                                                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("check")))
        now = seen.get
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("label"))
        before = now


def connected(labels: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """What ``components`` would give for the links that ``labels`` come from and ``links`` (a, b), of which there are ``rows``.

    Only classes that the new links connect are looked at. A class's smallest id and an id without links have no row in
    ``labels``, so each id that moves gets its row from one side.
    """
    la, lb = (small(labels.select(F.col("doc_id").alias(f"_{s}"), F.col("label").alias(f"_l{s}"))) for s in "ab")
    ends = links.join(la, F.col("a") == F.col("_a"), "left").join(lb, F.col("b") == F.col("_b"), "left")
    moved = components(ends.select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b")), rows)
    to = moved.select(F.col("doc_id").alias("_from"), F.col("label").alias("_to"))
    old = labels.join(small(to), F.col("label") == F.col("_from"), "left")
    return written(old.select("doc_id", F.coalesce("_to", "label").alias("label")).union(moved))
