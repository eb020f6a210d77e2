"""Connected components by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut


def components(nodes: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """``nodes(on..., label)`` and ``edges(on..., a, b)`` to ``(on..., label, root)``.

    The columns ``on`` tell graphs apart, so that all graphs advance in one job.
    Each round lowers a root to the least of its neighbours' roots and then to its
    root's root, so rounds grow with the logarithm of a path's length.
    """
    both = cut(edges.unionByName(edges.select(*on, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(nodes.select(*on, "label").distinct().withColumn("root", F.col("label")))
    while True:
        around = both.join(roots.select(*on, F.col("label").alias("b"), "root"), [*on, "b"]).groupBy(*on, F.col("a").alias("label")).agg(F.min("root").alias("_near"))
        lower = roots.join(around, [*on, "label"], "left").select(*on, "label", F.col("root").alias("_old"), F.least("root", F.coalesce("_near", "root")).alias("_new"))
        jump = lower.select(*on, F.col("label").alias("_new"), F.col("_new").alias("_far"))
        after = cut(lower.join(jump, [*on, "_new"], "left").select(*on, "label", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("root")))
        if after.where("root <> _old").isEmpty():
            return after.select(*on, "label", "root")
        roots = after.select(*on, "label", "root")
