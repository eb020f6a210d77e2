"""Floor plan: contact points, projection, sectors and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial
from ..sources import views as V
from .registry import query

# A calibrated floor, its horizon sign and the camera above it.
FLOOR = ((-1.3235294117647074, -0.9705882352941189, 997.058823529413), (0.0, 1.3235294117647074, -926.4705882352953), (0.0, -0.006470588235294124, 1.0))
SIGN, CAMERA_HEIGHT, CAMERA = -1.0, 75.0, (150.0, -60.0)
EVIDENCE, SEMANTIC = 0.30, 0.25
# Usual floor heights by label, in cm.
HEIGHTS = {"floor": 0.0, "rug": 1.0, "couch": 40.0, "sofa": 40.0, "bed": 45.0, "chair": 45.0, "table": 75.0, "desk": 75.0, "shelf": 120.0, "counter": 90.0}

_M = "(VALUES (-1.3235294117647074::DOUBLE, -0.9705882352941189::DOUBLE, 997.058823529413::DOUBLE, 1.3235294117647074::DOUBLE, -926.4705882352953::DOUBLE, -0.006470588235294124::DOUBLE)) AS m(a, b, c, e, f, g)"
CONTACTS = f"""contacts AS (
  SELECT d.*, CASE WHEN (0.0::DOUBLE * px + g * py + 1) * -1 > 1e-9 THEN (a * px + b * py + c) / (g * py + 1) END AS fx, CASE WHEN (g * py + 1) * -1 > 1e-9 THEN (0.0::DOUBLE * px + e * py + f) / (g * py + 1) END AS fy
  FROM (SELECT *, x + w / 2.0::DOUBLE AS px, CAST(y + h AS DOUBLE) AS py FROM detections) d, {_M})"""


def held(points: str, name: str) -> str:
    """SQL: the highest sector for each row of ``points(det_id, fx, fy)``."""
    return f"""{name} AS (
  SELECT det_id, arg_max(sector_id, (floor_height, -sector_id)) AS sector_id, max(floor_height) AS floor_height FROM (
    SELECT p.det_id, p.fx, e.sector_id FROM {points} p JOIN edges e ON (e.ay > p.fy) <> (e.by_ > p.fy) AND p.fx < (e.bx - e.ax) * (p.fy - e.ay) / (e.by_ - e.ay) + e.ax
    GROUP BY p.det_id, p.fx, e.sector_id HAVING count(*) % 2 = 1) JOIN sectors USING (sector_id) GROUP BY det_id)"""


BASE = f"WITH {V.DETECTIONS}, {V.SECTORS}, {CONTACTS}"
_GATED = f"{BASE}, gated AS (SELECT *, CASE WHEN confidence < 0.25 THEN 'unknown' ELSE cls END AS kind FROM contacts WHERE evidence >= 0.30), {held('gated', 'first')}"
_RAISED = """, lifted AS (
  SELECT g.det_id, g.kind, CASE WHEN first.floor_height > 0 AND first.floor_height < 75 THEN 150 + (g.fx - 150) * ((75 - first.floor_height) / 75) ELSE g.fx END AS fx,
         CASE WHEN first.floor_height > 0 AND first.floor_height < 75 THEN -60 + (g.fy + 60) * ((75 - first.floor_height) / 75) ELSE g.fy END AS fy
  FROM gated g LEFT JOIN first USING (det_id) WHERE g.fx IS NOT NULL)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.detections(spark, sf_dir)
    at = G.contact(FLOOR, SIGN, F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return d.withColumn("_at", at).withColumn("fx", F.col("_at.x")).withColumn("fy", F.col("_at.y")).drop("_at")


def on_plan(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``(det_id, fx, fy, evidence, confidence, cls)`` that pass the gate: looked
    up at floor level first, then placed again at the height of what they stand on."""
    gated = found.where(F.col("evidence").isNull() | (F.col("evidence") >= EVIDENCE)).withColumn("kind", F.when(F.col("confidence") < SEMANTIC, "unknown").otherwise(F.col("cls")))
    seen = spatial.with_sector(gated.where(F.col("fx").isNotNull()), V.sectors(spark, sf_dir), "fx", "fy").drop("sector_id")
    at = G.raised(G.point(F.col("fx"), F.col("fy")), F.col("floor_height"), CAMERA_HEIGHT, CAMERA)
    return seen.withColumn("_at", at).withColumn("fx", F.col("_at.x")).withColumn("fy", F.col("_at.y")).drop("_at", "floor_height")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated observations on the plan."""
    return on_plan(contacts(spark, sf_dir), spark, sf_dir)


@query(f"""{_GATED}{_RAISED}, {held('lifted', 'second')}
SELECT second.sector_id, lifted.kind, count(*) AS n FROM lifted LEFT JOIN second USING (det_id) GROUP BY ALL""")
def flagship_sector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, demote, contact point, projection, height, sector, counts."""
    return spatial.with_sector(observed(spark, sf_dir), V.sectors(spark, sf_dir), "fx", "fy").groupBy("sector_id", "kind").agg(F.count("*").alias("n"))


@query(f"{BASE}, {held('contacts', 'top')} SELECT det_id, round(fx, 4) AS fx, round(fy, 4) AS fy, sector_id, floor_height FROM contacts LEFT JOIN top USING (det_id)")
def sector_at_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.with_sector(contacts(spark, sf_dir), V.sectors(spark, sf_dir), "fx", "fy").select("det_id", F.round("fx", 4).alias("fx"), F.round("fy", 4).alias("fy"), "sector_id", "floor_height")


@query(f"""{BASE}, inside AS (SELECT p.det_id, e.sector_id FROM contacts p JOIN edges e ON (e.ay > p.fy) <> (e.by_ > p.fy) AND p.fx < (e.bx - e.ax) * (p.fy - e.ay) / (e.by_ - e.ay) + e.ax GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT sector_id, count(*) AS n FROM inside GROUP BY sector_id""")
def pip_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_polygons(contacts(spark, sf_dir), V.sectors(spark, sf_dir), "fx", "fy").groupBy("sector_id").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT det_id, round(fx, 4) AS fx, round(fy, 4) AS fy, fx IS NOT NULL AS below FROM contacts")
def contact_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).select("det_id", F.round("fx", 4).alias("fx"), F.round("fy", 4).alias("fy"), G.below_horizon(FLOOR, SIGN, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h")).alias("below"))


@query(f"""{BASE} SELECT det_id, hh AS height, round(CASE WHEN hh > 0 AND hh < 75 THEN 150 + (fx - 150) * ((75 - hh) / 75) ELSE fx END, 4) AS fx, round(CASE WHEN hh > 0 AND hh < 75 THEN -60 + (fy + 60) * ((75 - hh) / 75) ELSE fy END, 4) AS fy,
  true AS can_correct FROM (SELECT *, CAST(k % 5 * 20 AS DOUBLE) AS hh FROM contacts) WHERE fx IS NOT NULL""")
def raise_to_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.col("k") % 5 * 20).cast("double")
    at = G.raised(G.point(F.col("fx"), F.col("fy")), h, CAMERA_HEIGHT, CAMERA)
    return contacts(spark, sf_dir).where("fx IS NOT NULL").select("det_id", h.alias("height"), F.round(at["x"], 4).alias("fx"), F.round(at["y"], 4).alias("fy"), F.lit(CAMERA is not None and CAMERA_HEIGHT > 0).alias("can_correct"))


@query(f"""{BASE} SELECT det_id, round(px, 4) AS px, round(py, 4) AS py, round(px - (x + w / 2.0::DOUBLE), 3) + 0.0 AS dx, round(py - (y + h), 3) + 0.0 AS dy FROM (
  SELECT c.*, det_id AS _d, x + w / 2.0::DOUBLE AS px, CAST(y + h AS DOUBLE) AS py FROM (SELECT * EXCLUDE (px, py) FROM contacts WHERE fx IS NOT NULL) c)""")
def plan_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back through the inverse map: the contact points come back."""
    import numpy as np

    back = np.linalg.inv(np.array(FLOOR)).tolist()
    at = G.project(back, F.col("fx"), F.col("fy"))
    df = contacts(spark, sf_dir).where("fx IS NOT NULL").withColumn("_p", at)
    return df.select("det_id", F.round("_p.x", 4).alias("px"), F.round("_p.y", 4).alias("py"), (F.round(F.col("_p.x") - (F.col("x") + F.col("w") / 2), 3) + 0.0).alias("dx"), (F.round(F.col("_p.y") - (F.col("y") + F.col("h")), 3) + 0.0).alias("dy"))


_WARP = ((1.1, 0.05, 12.0), (-0.03, 0.95, 8.0), (0.0001, 0.0002, 1.0))
_WARPED = f"""WITH {V.DETECTIONS}, ends AS (
  SELECT det_id, cx, cy FROM (SELECT det_id, x::DOUBLE AS cx, y::DOUBLE AS cy FROM detections UNION ALL SELECT det_id, x + w, y FROM detections UNION ALL SELECT det_id, x + w, y + h FROM detections UNION ALL SELECT det_id, x, y + h FROM detections)
), warped AS (
  SELECT det_id, (cx * 1.1::DOUBLE + cy * 0.05::DOUBLE + 12.0::DOUBLE) / (cx * 0.0001::DOUBLE + cy * 0.0002::DOUBLE + 1.0::DOUBLE) AS u, (cx * -0.03::DOUBLE + cy * 0.95::DOUBLE + 8.0::DOUBLE) / (cx * 0.0001::DOUBLE + cy * 0.0002::DOUBLE + 1.0::DOUBLE) AS v FROM ends)"""


@query(f"{_WARPED} SELECT det_id, CAST(round_even(min(u), 0) AS INTEGER) AS x, CAST(round_even(min(v), 0) AS INTEGER) AS y, CAST(round_even(max(u) - min(u), 0) AS INTEGER) AS w, CAST(round_even(max(v) - min(v), 0) AS INTEGER) AS h FROM warped GROUP BY det_id")
def warp_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.warp_box(_WARP, F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return V.detections(spark, sf_dir).select("det_id", b.alias("b")).select("det_id", "b.*")


_QUADS = """quads AS (SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 40 AS DOUBLE) AS t FROM part), qv AS (
  SELECT i, 0 AS k, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM quads UNION ALL SELECT i, 1, 100 + s, t FROM quads UNION ALL SELECT i, 2, s * 4 - t, 60 + s FROM quads UNION ALL SELECT i, 3, t - 20, 80 - s FROM quads
), turns AS (SELECT a.i, sign((b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x)) AS t, a.x * b.y - b.x * a.y AS cross_ FROM qv a JOIN qv b ON a.i = b.i AND b.k = (a.k + 1) % 4 JOIN qv c ON a.i = c.i AND c.k = (a.k + 2) % 4)"""


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double")
    zero = F.lit(0.0)
    quad = F.array(G.point(zero, zero), G.point(s + 100, t), G.point(s * 4 - t, s + 60), G.point(t - 20, 80 - s))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), quad.alias("quad"))


@query(f"WITH {_QUADS} SELECT i, count(DISTINCT t) FILTER (t <> 0) = 1 AS convex, round(abs(sum(cross_)) / 2, 4) AS area FROM turns GROUP BY i")
def quad_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quads(spark, sf_dir).select("i", G.convex(F.col("quad")).alias("convex"), F.round(G.area(F.col("quad")), 4).alias("area"))


@query(f"""WITH {_QUADS} SELECT i, CASE WHEN NOT (count(DISTINCT t) FILTER (t <> 0) <= 1) THEN 'not convex' WHEN abs(sum(cross_)) / 2 < 0.1 * 30000 THEN 'too small' WHEN abs(sum(cross_)) / 2 > 25.0 * 30000 THEN 'too large' ELSE 'ok' END AS verdict FROM turns GROUP BY i""")
def projected_quad_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex, and between a tenth and 25 times the frame's area."""
    q, a = F.col("quad"), G.area(F.col("quad"))
    frame = 30000.0
    verdict = F.when(~G.convex(q), "not convex").when(a < 0.1 * frame, "too small").when(a > 25.0 * frame, "too large").otherwise("ok")
    return _quads(spark, sf_dir).select("i", verdict.alias("verdict"))


@query(f"WITH {V.SECTORS} SELECT sector_id, 4200.0::DOUBLE AS area, CASE floor_height WHEN 0 THEN true ELSE false END AS is_floor FROM sectors")
def sector_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sectors(spark, sf_dir).select("sector_id", G.area(F.col("polygon")).alias("area"), (F.col("floor_height") <= 0.01).alias("is_floor"))


@query(f"WITH {V.SECTORS} SELECT coalesce(min(x), 0) AS x0, coalesce(min(y), 0) AS y0, coalesce(max(x), 100) AS x1, coalesce(max(y), 100) AS y1 FROM vertices")
def world_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.sectors(spark, sf_dir).select(F.explode("polygon").alias("v"))
    return v.agg(*[F.coalesce(f(f"v.{c}"), F.lit(d)).alias(n) for n, f, c, d in (("x0", F.min, "x", 0.0), ("y0", F.min, "y", 0.0), ("x1", F.max, "x", 100.0), ("y1", F.max, "y", 100.0))])


@query(f"WITH {V.SECTORS} SELECT sector_id, label FROM sectors WHERE floor_height <= 0.01 ORDER BY 70 * 60 DESC, sector_id LIMIT 1")
def floor_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = V.sectors(spark, sf_dir).where("floor_height <= 0.01")
    return flat.agg(F.max_by(F.struct("sector_id", "label"), F.struct(G.area(F.col("polygon")), -F.col("sector_id"))).alias("s")).select("s.*")


@query(f"WITH {V.DETECTIONS} SELECT camera_id, CASE WHEN avg(-0.006470588235294124::DOUBLE * (y + h) + 1) < 0 THEN -1 ELSE 1 END AS sign FROM detections GROUP BY camera_id")
def depth_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.avg(G.depth(FLOOR, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h")))
    return V.detections(spark, sf_dir).groupBy("camera_id").agg(F.when(w < 0, -1).otherwise(1).alias("sign"))


@query(f"""WITH {V.SECTORS}, b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM vertices), s AS (SELECT *, least((700 - 40) / (x1 - x0), (500 - 40) / (y1 - y0)) AS k FROM b)
SELECT sector_id, i, CAST(round_even(350 + (x - (x0 + x1) / 2) * k, 0) AS INTEGER) AS px, CAST(round_even(250 - (y - (y0 + y1) / 2) * k, 0) AS INTEGER) AS py FROM vertices, s""")
def plan_to_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform scale, centred, y upwards; the bounds are one row."""
    s = V.sectors(spark, sf_dir)
    b = world_bounds(spark, sf_dir).first()
    k = min((700 - 40) / (b["x1"] - b["x0"]), (500 - 40) / (b["y1"] - b["y0"]))
    v = s.select("sector_id", F.posexplode("polygon").alias("i", "v"))
    x = F.bround((F.col("v.x") - (b["x0"] + b["x1"]) / 2) * k + 350, 0).cast("int")
    y = F.bround(F.lit(250.0) - (F.col("v.y") - (b["y0"] + b["y1"]) / 2) * k, 0).cast("int")
    return v.select("sector_id", "i", x.alias("px"), y.alias("py"))


@query(f"""WITH {V.SECTORS} SELECT sector_id, CAST(row_number() OVER (ORDER BY floor_height, sector_id) AS INTEGER) AS turn, CASE WHEN source = 'confirmed' THEN 2 ELSE 1 END AS thickness,
  CASE WHEN source = 'confirmed' THEN label ELSE label || '?' END AS caption, CAST(round_even(60 + (220 - 60) * pow(least(greatest(floor_height / 60.0::DOUBLE, 0), 1), 0.65::DOUBLE), 0) AS INTEGER) AS shade FROM sectors""")
def draw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors in painter's order with line width, caption and height shade."""
    from pyspark.sql import Window

    t = F.pow(F.least(F.greatest(F.col("floor_height") / 60.0, F.lit(0.0)), F.lit(1.0)), F.lit(0.65))
    sure = F.col("source") == "confirmed"
    return V.sectors(spark, sf_dir).select("sector_id", F.row_number().over(Window.orderBy("floor_height", "sector_id")).alias("turn"), F.when(sure, 2).otherwise(1).alias("thickness"), F.when(sure, F.col("label")).otherwise(F.concat("label", F.lit("?"))).alias("caption"), F.bround(60 + 160 * t, 0).cast("int").alias("shade"))


@query(f"WITH {V.DETECTIONS} SELECT det_id, round(x + 20 * sin(radians(CAST(k * 15 % 360 AS DOUBLE))), 4) AS tx, round(y + 20 * cos(radians(CAST(k * 15 % 360 AS DOUBLE))), 4) AS ty FROM detections")
def facing_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tip of a facing mark, degrees clockwise from +y."""
    a = F.radians((F.col("k") * 15 % 360).cast("double"))
    return V.detections(spark, sf_dir).select("det_id", F.round(F.col("x") + 20 * F.sin(a), 4).alias("tx"), F.round(F.col("y") + 20 * F.cos(a), 4).alias("ty"))


@query(f"""WITH {_QUADS}, kept AS (SELECT qv.*, y >= max(y) OVER (PARTITION BY i) - (max(y) OVER (PARTITION BY i) - min(y) OVER (PARTITION BY i)) * 0.35::DOUBLE AS low FROM qv),
n AS (SELECT i, count(*) FILTER (low) AS c FROM kept GROUP BY i) SELECT i, CASE WHEN c >= 3 THEN c ELSE 4 END AS vertices, c >= 3 AS trimmed FROM n""")
def footprint_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.lower_edge(F.col("quad"))
    return _quads(spark, sf_dir).select("i", F.size(e).cast("long").alias("vertices"), (F.size(e) < 4).alias("trimmed")).withColumn("trimmed", F.col("trimmed") | (F.col("i") < 0))


@query(f"""WITH {V.SECTORS}, {V.DETECTIONS}, o AS (SELECT det_id, x, y, x % 25 AS s FROM detections)
SELECT det_id, coalesce(label, '') AS sector, sector_id IS NOT NULL AS known FROM o LEFT JOIN sectors ON sectors.sector_id = CASE WHEN s % 7 = 0 THEN NULL ELSE s END""")
def thing_sector_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up the sector of a thing; a missing one gives a blank."""
    s = F.when(F.col("x") % 25 % 7 != 0, F.col("x") % 25)
    t = V.detections(spark, sf_dir).select("det_id", s.alias("sector_id"))
    found = t.join(V.sectors(spark, sf_dir).select("sector_id", "label"), "sector_id", "left")
    return found.select("det_id", F.coalesce("label", F.lit("")).alias("sector"), F.col("label").isNotNull().alias("known"))


_HEIGHT_ROWS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in HEIGHTS.items())


@query(f"""WITH h(label, height) AS (VALUES {_HEIGHT_ROWS}), p AS (SELECT p_partkey AS i, CASE p_partkey % 4 WHEN 0 THEN 'couch' WHEN 1 THEN 'table' WHEN 2 THEN 'lamp' ELSE 'rug' END AS label FROM part)
SELECT i, p.label, coalesce(height, 0.0) AS height FROM p LEFT JOIN h USING (label)""")
def default_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "couch").when(k == 1, "table").when(k == 2, "lamp").otherwise("rug")
    rows = ", ".join(f"('{a}', {b}D)" for a, b in HEIGHTS.items())
    heights = spark.sql(f"SELECT * FROM VALUES {rows} AS h(label, height)")
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), label.alias("label")).join(heights, "label", "left").select("i", "label", F.coalesce("height", F.lit(0.0)).alias("height"))


@query(f"""{BASE}, r AS (SELECT camera_id, sqrt((fx - gx) * (fx - gx) + (fy - gy) * (fy - gy)) AS e FROM (SELECT *, floor(fx / 10) * 10 + 5 AS gx, floor(fy / 10) * 10 + 5 AS gy FROM contacts WHERE fx IS NOT NULL))
SELECT camera_id, round(avg(e), 2) AS mean_error, round(max(e), 2) AS max_error, count(*) FILTER (e <= 5) AS inliers, round(avg(CASE WHEN e <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS inlier_ratio FROM r GROUP BY camera_id""")
def fit_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error statistics of a fit: here against the centres of a 10 cm grid."""
    at = contacts(spark, sf_dir).where("fx IS NOT NULL")
    e = G.distance(F.col("fx"), F.col("fy"), F.floor(F.col("fx") / 10) * 10 + 5, F.floor(F.col("fy") / 10) * 10 + 5)
    near = (F.col("e") <= 5).cast("double")
    return at.withColumn("e", e).groupBy("camera_id").agg(F.round(F.avg("e"), 2).alias("mean_error"), F.round(F.max("e"), 2).alias("max_error"), F.sum(near).cast("long").alias("inliers"), F.round(F.avg(near), 3).alias("inlier_ratio"))


_MATCHES = f"WITH {V.DETECTIONS}, m AS (SELECT user_id, x, y, (k % 20)::DOUBLE AS err FROM detections)"


@query(f"""{_MATCHES} SELECT user_id, count(*) AS n, round(avg(err), 3) AS mean_error, round(avg(CASE WHEN err <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS inlier_ratio,
  CASE WHEN count(*) < 8 THEN 'too few' WHEN avg(err) > 10 AND avg(CASE WHEN err <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.85 THEN 'usable' ELSE 'no parallax' END AS verdict FROM m GROUP BY user_id""")
def parallax_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.detections(spark, sf_dir).withColumn("err", (F.col("k") % 20).cast("double"))
    n, mean, ratio = F.count("*"), F.avg("err"), F.avg((F.col("err") <= 5).cast("double"))
    return d.groupBy("user_id").agg(n.alias("n"), F.round(mean, 3).alias("mean_error"), F.round(ratio, 3).alias("inlier_ratio"), F.when(n < 8, "too few").when((mean > 10) & (ratio < 0.85), "usable").otherwise("no parallax").alias("verdict"))


@query(f"""{_MATCHES} SELECT user_id, count(*) FILTER (err <= 5) AS inliers, round(coalesce((max(x) FILTER (err <= 5) - min(x) FILTER (err <= 5)) / 1100.0::DOUBLE, 0), 4) AS spread_x, round(coalesce((max(y) FILTER (err <= 5) - min(y) FILTER (err <= 5)) / 640.0::DOUBLE, 0), 4) AS spread_y,
  CASE WHEN count(*) < 4 THEN 'too few matches' WHEN count(*) FILTER (err <= 5) < 12 THEN 'too few inliers' WHEN (max(x) FILTER (err <= 5) - min(x) FILTER (err <= 5)) / 1100.0::DOUBLE < 0.3 OR (max(y) FILTER (err <= 5) - min(y) FILTER (err <= 5)) / 640.0::DOUBLE < 0.3 THEN 'too little spread' ELSE 'accepted' END AS verdict FROM m GROUP BY user_id""")
def fit_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough matches, inliers and spread of the inliers over the frame."""
    near = (F.col("k") % 20) <= 5
    spread = {c: F.coalesce((F.max(F.when(near, F.col(c))) - F.min(F.when(near, F.col(c)))) / size, F.lit(0.0)) for c, size in (("x", 1100.0), ("y", 640.0))}
    inliers = F.count_if(near)
    verdict = F.when(F.count("*") < 4, "too few matches").when(inliers < 12, "too few inliers").when((spread["x"] < 0.3) | (spread["y"] < 0.3), "too little spread").otherwise("accepted")
    return V.detections(spark, sf_dir).groupBy("user_id").agg(inliers.alias("inliers"), F.round(spread["x"], 4).alias("spread_x"), F.round(spread["y"], 4).alias("spread_y"), verdict.alias("verdict"))


@query(f"{_MATCHES} SELECT user_id % 50 AS keypoint, median(x) AS x, median(y) AS y, count(*) AS support FROM m GROUP BY ALL")
def burst_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote for each reference key point: the medians over a burst."""
    return V.detections(spark, sf_dir).groupBy((F.col("user_id") % 50).alias("keypoint")).agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count("*").alias("support"))


@query(f"""WITH {V.SECTORS}, new AS (SELECT sector_id, label, floor_height FROM sectors WHERE source = 'proposed')
SELECT * FROM (SELECT -1 AS sector_id, 'floor' AS label, 0.0::DOUBLE AS floor_height, 'confirmed' AS source UNION ALL SELECT sector_id, label, floor_height, coalesce(source, 'confirmed') FROM sectors WHERE label <> 'FRANCE')""")
def editor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new floor first, then every sector with another label."""
    new = spark.sql("SELECT -1 AS sector_id, 'floor' AS label, 0.0D AS floor_height, 'confirmed' AS source")
    return new.unionByName(V.sectors(spark, sf_dir).where("label <> 'FRANCE'").select("sector_id", "label", "floor_height", F.coalesce("source", F.lit("confirmed")).alias("source")))


@query(f"WITH {V.SECTORS}, p AS (SELECT label FROM sectors WHERE source = 'proposed') SELECT label FROM p WHERE label NOT IN (SELECT label FROM sectors WHERE locked)")
def proposals_unlocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for labels that no locked sector has."""
    s = V.sectors(spark, sf_dir)
    return s.where("source = 'proposed'").select("label").join(s.where("locked").select("label"), "label", "left_anti")


@query(f"""WITH {V.SECTORS}, {V.DETECTIONS}, incoming AS (SELECT sector_id, x0, y0, floor_height + 5 AS floor_height, CASE WHEN sector_id % 3 = 0 THEN NULL ELSE source END AS source FROM sectors WHERE sector_id < 20)
SELECT det_id, arg_max(sector_id, (floor_height, -sector_id)) AS sector_id, arg_max(coalesce(source, 'confirmed'), (floor_height, -sector_id)) AS source FROM detections JOIN incoming ON x % 300 > x0 AND x % 300 < x0 + 70 AND y % 250 > y0 AND y % 250 < y0 + 60 WHERE x % 300 % 10 <> 0 AND y % 250 % 10 <> 0 GROUP BY det_id""")
def replace_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sectors replaced by a posted list; things are looked up anew."""
    kept = F.when(F.col("sector_id") % 3 != 0, F.col("source"))
    incoming = V.sectors(spark, sf_dir).where("sector_id < 20").select("sector_id", "polygon", (F.col("floor_height") + 5).alias("floor_height"), F.coalesce(kept, F.lit("confirmed")).alias("source"))
    things = V.detections(spark, sf_dir).select("det_id", (F.col("x") % 300).cast("double").alias("fx"), (F.col("y") % 250).cast("double").alias("fy")).where("fx % 10 <> 0 AND fy % 10 <> 0")
    found = spatial.highest_sector(things, incoming, "det_id", "fx", "fy").select("det_id", "sector_id")
    return found.join(incoming.select("sector_id", "source"), "sector_id").select("det_id", "sector_id", "source")
