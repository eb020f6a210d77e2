"""Grouping sets, ranks, set operations and layered settings over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import views as V
from .registry import query

_D = f"WITH {V.DETECTIONS}"


@query(f"{_D} SELECT camera_id, cls, CAST(grouping(camera_id) * 2 + grouping(cls) AS BIGINT) AS level, count(*) AS n, round(avg(confidence), 6) AS confidence FROM detections GROUP BY ROLLUP (camera_id, cls)")
def detection_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by camera and class, by camera, and of all."""
    r = V.detections(spark, sf_dir).rollup("camera_id", "cls")
    return r.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")).select("camera_id", "cls", "level", "n", "confidence")


@query(f"{_D} SELECT camera_id, cls, user_id % 5 AS zone, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT * FROM detections) GROUP BY GROUPING SETS ((camera_id, cls), (user_id % 5), ())")
def detection_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groupings in one pass over the detections."""
    zoned = V.detections(spark, sf_dir).withColumn("zone", F.col("user_id") % 5)
    sets = [[F.col("camera_id"), F.col("cls")], [F.col("zone")], []]
    return zoned.groupingSets(sets, "camera_id", "cls", "zone").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select("camera_id", "cls", "zone", "n", "users")


_W = "OVER (PARTITION BY user_id ORDER BY confidence DESC, det_id)"


@query(f"""{_D} SELECT det_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY round(confidence, 1) DESC) AS INTEGER) AS place, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY round(confidence, 1) DESC) AS INTEGER) AS level, CAST(ntile(4) {_W} AS INTEGER) AS quarter,
  round(percent_rank() {_W}, 6) AS share, round(avg(confidence) OVER (PARTITION BY user_id ORDER BY confidence DESC, det_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS around, first_value(det_id) {_W} AS best FROM detections""")
def detection_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, quarters and a moving mean of a source's detections by confidence."""
    w = Window.partitionBy("user_id").orderBy(F.desc("confidence"), "det_id")
    tied = Window.partitionBy("user_id").orderBy(F.desc(F.round("confidence", 1)))
    return V.detections(spark, sf_dir).select(
        "det_id", F.rank().over(tied).alias("place"), F.dense_rank().over(tied).alias("level"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"),
        F.round(F.avg("confidence").over(w.rowsBetween(-2, 1)), 6).alias("around"), F.first("det_id").over(w).alias("best"),
    )


def _seen(cls: str) -> str:
    return f"SELECT user_id FROM detections WHERE cls = '{cls}'"


@query(f"""{_D} SELECT 'either' AS kind, user_id FROM ({_seen("human")} UNION {_seen("cat")}) UNION ALL SELECT 'both', user_id FROM ({_seen("human")} INTERSECT {_seen("cat")}) UNION ALL SELECT 'only', user_id FROM ({_seen("human")} EXCEPT {_seen("cat")})""")
def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with one class or another, with both, and with the first alone."""
    d = V.detections(spark, sf_dir)
    human, cat = (d.where(F.col("cls") == c).select("user_id") for c in ("human", "cat"))
    sets = {"either": human.union(cat).distinct(), "both": human.intersect(cat), "only": human.exceptAll(cat).distinct().join(cat, "user_id", "left_anti")}
    out = [df.select(F.lit(kind).alias("kind"), "user_id") for kind, df in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# What a node is called if nothing names it.
NAMES = ("camera server", "server", "about:blank")


@query(f"""WITH t AS (SELECT p_partkey AS i, CASE WHEN p_size % 3 <> 0 THEN '  ' || p_name || chr(10) || ' ' || chr(10) || CASE WHEN p_size % 2 = 0 THEN ' s' || p_size ELSE '' END END AS node, CASE WHEN p_size % 5 <> 0 THEN 'shared' || chr(10) || 'sh' || chr(10) || 'link ' || p_partkey END AS shared FROM part),
l AS (SELECT i, list_filter(list_transform(string_split(coalesce(node, shared), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM t)
SELECT i, coalesce(l[1], '{NAMES[0]}') AS product, coalesce(l[2], '{NAMES[1]}') AS short, coalesce(l[3], '{NAMES[2]}') AS link FROM l""")
def product_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node's own three lines go before the shared ones, as a whole."""
    size, end = F.col("p_size"), F.lit("\n")
    node = F.when(size % 3 != 0, F.concat(F.lit("  "), "p_name", end, F.lit(" "), end, F.when(size % 2 == 0, F.concat(F.lit(" s"), size.cast("string"))).otherwise("")))
    shared = F.when(size % 5 != 0, F.concat(F.lit("shared"), end, F.lit("sh"), end, F.lit("link "), F.col("p_partkey").cast("string")))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), X.identity([node, shared], NAMES).alias("n")).select("i", "n.product", "n.short", "n.link")
