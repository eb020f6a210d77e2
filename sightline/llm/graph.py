"""Connected components of an edge table, with every step distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


#: Edges in a partition, at least.
EDGES = 100_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One round of large-star or small-star (Kiveris et al., 2014).

    The minimum of each neighbourhood is a partial aggregate, is written out and
    comes back by a join of plain exchanges, so that a hub's rows split over tasks.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts))
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return cut(out.where("u <> v").distinct().coalesce(parts))


def forest(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` to ``(node, root)`` for every node but the roots;
    root: the least node reachable.

    Null ends and loops are ignored; repeated and reversed edges are as one; no
    edges: no rows.
    """
    edges = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not mark["n"] or (mark["n"], mark["x"]) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (mark["n"], mark["x"])
        # Few edges are written to few files.
        parts = 1 + mark["n"] // EDGES
        edges = _star(_star(edges, True, parts), False, parts)


def connected_components(edges: DataFrame) -> DataFrame:
    """``forest`` with the roots: every node that has an edge to another one."""
    found = forest(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
