"""Observation tables derived from the generic test tables, and their SQL twins.

No camera footage comes with the data, so detections, frames, sectors, notches and
settings are integer functions of the given tables: both engines get equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Which class an event stands for.
CLASSES = {"view": "human", "click": "cat", "purchase": "cat", "signup": "teddy bear", "error": "motion"}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The number is exploded out of the JSON: later filters on what derives from it
    # are then pushed no further, where each mention would parse the text again.
    e = table(spark, sf_dir, "events").withColumn("k", F.explode(F.array(F.get_json_object("props", "$.k").cast("long"))))
    k, u = F.col("k"), F.col("user_id")
    kind = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(c)) for t, c in CLASSES.items()])
    confidence = F.least("value", F.lit(100.0)) / 100
    return e.select(
        F.col("event_id").alias("det_id"), "ts", (u % 4).alias("camera_id"), kind.alias("cls"), confidence.alias("confidence"), (confidence + (k % 10) / F.lit(10.0)).alias("evidence"),
        ((u * 7 + k * 3) % 1100).cast("int").alias("x"), ((u * 5 + k * 11) % 640).cast("int").alias("y"), (k % 60 + 40).cast("int").alias("w"), (u % 50 + 30).cast("int").alias("h"), u.alias("user_id"), k,
    )


DETECTIONS = """detections AS (
  SELECT *, confidence + (k % 10) / 10.0::DOUBLE AS evidence, CAST((user_id * 7 + k * 3) % 1100 AS INTEGER) AS x, CAST((user_id * 5 + k * 11) % 640 AS INTEGER) AS y,
         CAST(k % 60 + 40 AS INTEGER) AS w, CAST(user_id % 50 + 30 AS INTEGER) AS h
  FROM (SELECT event_id AS det_id, ts, user_id % 4 AS camera_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, least(value, 100.0::DOUBLE) / 100 AS confidence,
               CASE event_type WHEN 'view' THEN 'human' WHEN 'click' THEN 'cat' WHEN 'purchase' THEN 'cat' WHEN 'signup' THEN 'teddy bear' WHEN 'error' THEN 'motion' END AS cls FROM events))"""


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle for each nation; neighbours overlap on purpose."""
    n = F.col("n_nationkey").cast("int")
    x0, y0 = ((n % 5) * 60).cast("double"), (F.floor(n / 5) * 50).cast("double")

    def at(dx: int, dy: int):
        return F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))

    polygon = F.array(at(0, 0), at(70, 0), at(70, 60), at(0, 60))
    return table(spark, sf_dir, "nation").select(n.alias("sector_id"), F.col("n_name").alias("label"), polygon.alias("polygon"), (F.col("n_regionkey") * 15).cast("double").alias("floor_height"), F.when(n % 3 == 0, "proposed").otherwise("confirmed").alias("source"), (n % 4 == 0).alias("locked"))


SECTORS = """sectors AS (
  SELECT CAST(n_nationkey AS INTEGER) AS sector_id, n_name AS label, CAST((n_nationkey % 5) * 60 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 50 AS DOUBLE) AS y0,
         CAST(n_regionkey * 15 AS DOUBLE) AS floor_height, CASE WHEN n_nationkey % 3 = 0 THEN 'proposed' ELSE 'confirmed' END AS source, n_nationkey % 4 = 0 AS locked FROM nation
), vertices AS (
  SELECT sector_id, 0 AS i, x0 AS x, y0 AS y FROM sectors UNION ALL SELECT sector_id, 1, x0 + 70, y0 FROM sectors
  UNION ALL SELECT sector_id, 2, x0 + 70, y0 + 60 FROM sectors UNION ALL SELECT sector_id, 3, x0, y0 + 60 FROM sectors
), edges AS (
  SELECT a.sector_id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM vertices a JOIN vertices b ON a.sector_id = b.sector_id AND b.i = (a.i + 3) % 4)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 x 8 luma values, one row a pixel."""
    v = F.col("v").cast("double")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), (F.col("vec_id") % 2).alias("camera_id"), F.posexplode("embedding").alias("p", "v"))
    luma = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.6) * 212 + 0.5).cast("int")))
    return e.select("frame_id", "camera_id", "p", (F.col("p") % 8).alias("px"), F.floor(F.col("p") / 8).cast("int").alias("py"), luma.alias("luma"))


PIXELS = """pixels AS (
  SELECT frame_id, camera_id, p, p % 8 AS px, p // 8 AS py, least(255, greatest(0, CAST(floor((v::DOUBLE + 0.6::DOUBLE) * 212 + 0.5::DOUBLE) AS INTEGER))) AS luma
  FROM (SELECT vec_id AS frame_id, vec_id % 2 AS camera_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS p, unnest(embedding) AS v FROM embeddings))"""

# Objects of a reference picture of the scene.
SCENE_REGIONS = [("couch", 100, 300, 400, 200, True), ("cat", 0, 0, 200, 200, True), ("chair", 600, 100, 250, 250, True), ("human", 700, 400, 300, 200, True), ("human", 200, 100, 300, 300, False)]


def scene_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_rows()} AS r(label, rx, ry, rw, rh, static)")


def _rows() -> str:
    return ", ".join(f"('{a}', {b}, {c}, {d}, {e}, {str(f).lower()})" for a, b, c, d, e, f in SCENE_REGIONS)


REGIONS = f"regions(label, rx, ry, rw, rh, static) AS (VALUES {_rows()})"


def notches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected frequency bands: a centre and width, or a range; some malformed."""
    s = F.col("s_suppkey")
    c = (s * 197 % 19000 + 20).cast("double")
    ranged = s % 3 == 0
    return table(spark, sf_dir, "supplier").select(
        s.alias("i"), F.when(~ranged, c).alias("center"), F.when(~ranged, (s % 40 * 5).cast("double")).alias("width"), F.when(ranged, c).alias("lo"), F.when(ranged, c + F.col("s_nationkey")).alias("hi"),
        F.when(s % 5 == 0, F.lit(False)).when(s % 5 != 1, F.lit(True)).alias("enabled"), F.col("s_name").alias("note"),
    )


NOTCHES = """notches AS (
  SELECT i, CASE WHEN i % 3 <> 0 THEN c END AS center, CASE WHEN i % 3 <> 0 THEN CAST(i % 40 * 5 AS DOUBLE) END AS width, CASE WHEN i % 3 = 0 THEN c END AS lo, CASE WHEN i % 3 = 0 THEN c + s_nationkey END AS hi,
         CASE WHEN i % 5 = 0 THEN false WHEN i % 5 <> 1 THEN true END AS enabled, s_name AS note
  FROM (SELECT s_suppkey AS i, CAST(s_suppkey * 197 % 19000 + 20 AS DOUBLE) AS c, s_nationkey, s_name FROM supplier))"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.when(p % 7 == 0, "abc").otherwise((p * 100).cast("string")).alias("value"), F.col("p_name").alias("name"))


SETTINGS = "settings AS (SELECT p_partkey AS i, CASE WHEN p_size % 7 = 0 THEN 'abc' ELSE CAST(p_size * 100 AS VARCHAR) END AS value, p_name AS name FROM part)"
