"""Detections: filters, box arithmetic, scene joins, matching and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import hamming, spatial
from ..sources import views as V
from .registry import query

_D = f"WITH {V.DETECTIONS}"
# Detector classes by id, and classes of static furniture.
LIVE_CLASSES = {0: "human", 15: "cat", 77: "teddy bear"}
FURNITURE_CLASSES = {56: "chair", 57: "couch", 59: "bed", 60: "table", 62: "tv"}
# Names that a class filter may use for a class.
ALIASES = {"person": 0, "human": 0, "cat": 15, "teddy bear": 77}

_FILTERS = "filters AS (SELECT p_partkey AS i, CASE p_partkey % 5 WHEN 0 THEN 'person, cat' WHEN 1 THEN '15,99' WHEN 2 THEN 'zebra' WHEN 3 THEN '' ELSE ' Human ,77,77' END AS spec FROM part)"


@query(f"""WITH {_FILTERS}, parts AS (SELECT DISTINCT i, lower(trim(unnest(string_split(spec, ',')))) AS part FROM filters),
names(part, id) AS (VALUES {", ".join(f"('{n}', {i})" for n, i in ALIASES.items())}), labels(id, label) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in LIVE_CLASSES.items())})
SELECT DISTINCT i, coalesce(names.id, try_cast(parts.part AS INTEGER)) AS class_id, coalesce(label, parts.part) AS label
FROM parts LEFT JOIN names USING (part) LEFT JOIN labels ON labels.id = coalesce(names.id, try_cast(parts.part AS INTEGER)) WHERE coalesce(names.id, try_cast(parts.part AS INTEGER)) IS NOT NULL""")
def class_filter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids or names; unknown names are ignored, unlabelled ids named by number."""
    k = F.col("p_partkey") % 5
    spec = F.when(k == 0, "person, cat").when(k == 1, "15,99").when(k == 2, "zebra").when(k == 3, "").otherwise(" Human ,77,77")
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.explode(F.split(spec, ",")).alias("part")).select("i", F.lower(F.trim("part")).alias("part")).distinct()
    names = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {i})" for n, i in ALIASES.items()) + " AS n(part, named)")
    labels = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{n}')" for i, n in LIVE_CLASSES.items()) + " AS l(class_id, label)")
    ids = parts.join(names, "part", "left").withColumn("class_id", F.coalesce("named", F.expr("try_cast(part AS INT)"))).where("class_id IS NOT NULL")
    return ids.join(labels, "class_id", "left").select("i", "class_id", F.coalesce("label", "part").alias("label")).distinct()


@query(f"{_D} SELECT det_id, cls, round(confidence, 4) AS confidence FROM detections WHERE confidence >= 0.35 AND cls IN ('human', 'cat', 'teddy bear')")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.detections(spark, sf_dir).where((F.col("confidence") >= 0.35) & F.col("cls").isin(*LIVE_CLASSES.values())).select("det_id", "cls", F.round("confidence", 4).alias("confidence"))


_LETTER = f"""{_D}, raw AS (SELECT det_id, x * 0.5::DOUBLE - 40 AS cx, y * 0.5::DOUBLE - 10 AS cy, w * 0.5::DOUBLE AS cw, h * 0.5::DOUBLE AS ch FROM detections), c AS (
  SELECT det_id, least(greatest(round_even((cx - cw / 2 - 20) / 0.45::DOUBLE, 0), 0), 1099) AS x1, least(greatest(round_even((cy - ch / 2 - 5) / 0.45::DOUBLE, 0), 0), 639) AS y1, least(greatest(round_even((cx + cw / 2 - 20) / 0.45::DOUBLE, 0), 0), 1100) AS x2, least(greatest(round_even((cy + ch / 2 - 5) / 0.45::DOUBLE, 0), 0), 640) AS y2 FROM raw)"""


@query(f"{_LETTER} SELECT det_id, CAST(x1 AS INTEGER) AS x, CAST(y1 AS INTEGER) AS y, CAST(x2 - x1 AS INTEGER) AS w, CAST(y2 - y1 AS INTEGER) AS h FROM c WHERE x2 > x1 AND y2 > y1")
def letterbox_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from a scaled and padded input back to the frame, clamped, rounded
    half to even; empty ones go."""
    d = V.detections(spark, sf_dir)
    cx, cy, cw, ch = F.col("x") * 0.5 - 40, F.col("y") * 0.5 - 10, F.col("w") * 0.5, F.col("h") * 0.5

    def back(v, pad: float, most: float):
        return F.least(F.greatest(F.bround((v - pad) / 0.45, 0), F.lit(0.0)), F.lit(most))

    x1, y1, x2, y2 = back(cx - cw / 2, 20, 1099.0), back(cy - ch / 2, 5, 639.0), back(cx + cw / 2, 20, 1100.0), back(cy + ch / 2, 5, 640.0)
    return d.where((x2 > x1) & (y2 > y1)).select("det_id", x1.cast("int").alias("x"), y1.cast("int").alias("y"), (x2 - x1).cast("int").alias("w"), (y2 - y1).cast("int").alias("h"))


@query(f"{_D} SELECT det_id, x + w // 2 AS cx, y + h // 2 AS cy, x + w / 2.0::DOUBLE AS fx, y + h / 2.0::DOUBLE AS fy, CAST(greatest(0, w) * greatest(0, h) AS DOUBLE) AS area FROM detections")
def box_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = map(F.col, "xywh")
    return V.detections(spark, sf_dir).select("det_id", (x + F.expr("w div 2").cast("int")).alias("cx"), (y + F.expr("h div 2").cast("int")).alias("cy"), (x + w / 2).alias("fx"), (y + h / 2).alias("fy"), G.box_area(w, h).alias("area"))


_OBSERVED = f"{_D}, o AS (SELECT *, confidence AS objectness, CASE WHEN cls IS NOT NULL AND confidence >= 0.25 THEN cls END AS klass, CASE WHEN cls IS NOT NULL AND confidence >= 0.25 THEN confidence ELSE 0 END AS klass_confidence FROM detections)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections through the semantic floor: the class only where it is sure
    enough, the objectness always."""
    sure = F.col("cls").isNotNull() & (F.col("confidence") >= 0.25)
    return V.detections(spark, sf_dir).withColumn("objectness", F.col("confidence")).withColumn("klass", F.when(sure, F.col("cls"))).withColumn("klass_confidence", F.when(sure, F.col("confidence")).otherwise(0.0))


@query(f"{_OBSERVED} SELECT det_id, round(objectness, 4) AS objectness, klass, round(klass_confidence, 4) AS klass_confidence FROM o")
def semantic_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("det_id", F.round("objectness", 4).alias("objectness"), "klass", F.round("klass_confidence", 4).alias("klass_confidence"))


@query(f"{_D} SELECT camera_id, count(*) FILTER (evidence >= 0.30) AS written, count(*) FILTER (evidence < 0.30) AS weak, count(*) FILTER (evidence >= 0.30 AND confidence < 0.25) AS unknown, count(*) FILTER (evidence >= 0.30 AND (-0.006470588235294124::DOUBLE * (y + h) + 1) * -1 <= 1e-9) AS above FROM detections GROUP BY camera_id")
def observer_gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .floor import FLOOR, SIGN

    strong = F.col("evidence").isNull() | (F.col("evidence") >= 0.30)
    above = ~G.below_horizon(FLOOR, SIGN, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h"))
    return V.detections(spark, sf_dir).groupBy("camera_id").agg(F.count_if(strong).alias("written"), F.count_if(~strong).alias("weak"), F.count_if(strong & (F.col("confidence") < 0.25)).alias("unknown"), F.count_if(strong & above).alias("above"))


@query(f"""{_D} SELECT camera_id, count(*) FILTER (evidence >= 0.5) AS confirmed, count(*) FILTER (NOT evidence >= 0.5) AS candidates,
  CAST(count(*) FILTER (evidence >= 0.5) AS VARCHAR) || ' confirmed' || CASE WHEN count(*) FILTER (NOT evidence >= 0.5) = 1 THEN ', 1 candidate' ELSE ', ' || CAST(count(*) FILTER (NOT evidence >= 0.5) AS VARCHAR) || ' candidates' END AS banner,
  string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM detections WHERE cls <> 'motion' GROUP BY camera_id""")
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed and candidate counts, a pluralised banner and the classes seen."""
    yes, no = F.count_if(F.col("evidence") >= 0.5), F.count_if(~(F.col("evidence") >= 0.5))
    banner = F.concat(yes.cast("string"), F.lit(" confirmed"), F.when(no == 1, ", 1 candidate").otherwise(F.concat(F.lit(", "), no.cast("string"), F.lit(" candidates"))))
    return V.detections(spark, sf_dir).where("cls <> 'motion'").groupBy("camera_id").agg(yes.alias("confirmed"), no.alias("candidates"), banner.alias("banner"), F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"))


_OVERLAP = "greatest(least(x + w, rx + rw) - greatest(x, rx), 0) * greatest(least(y + h, ry + rh) - greatest(y, ry), 0)"
_BOX, _REGION = ("x", "y", "w", "h"), ("rx", "ry", "rw", "rh")


def _shared() -> Column:
    return G.overlap(*map(F.col, _BOX), *map(F.col, _REGION))


@query(f"""{_D}, {V.REGIONS}, f AS (SELECT det_id, max(least(CAST({_OVERLAP} AS DOUBLE) / (w * h), 1)) AS m FROM detections JOIN regions ON static AND label <> cls GROUP BY det_id)
SELECT det_id, round(coalesce(nullif(m, 0), 1.0), 4) AS scene_consistency FROM detections LEFT JOIN f USING (det_id)""")
def scene_consistency_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest share of the box that a static object of another class covers;
    nothing covered is neutral."""
    d = V.detections(spark, sf_dir)
    met = spatial.overlapping(d, V.scene_regions(spark, sf_dir).where("static"), _BOX, _REGION).where("label <> cls")
    most = met.groupBy("det_id").agg(F.max(F.least(_shared() / G.box_area(F.col("w"), F.col("h")), F.lit(1.0))).alias("m"))
    return d.select("det_id").join(most, "det_id", "left").select("det_id", F.round(F.coalesce("m", F.lit(1.0)), 4).alias("scene_consistency"))


@query(f"{_D}, {V.REGIONS} SELECT det_id, cls FROM detections WHERE NOT EXISTS (SELECT 1 FROM regions WHERE static AND label = cls AND CAST({_OVERLAP} AS DOUBLE) / (w * h) > 0.5)")
def suppress_static_same_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections go that lie by more than half on a static object of their class."""
    d = V.detections(spark, sf_dir)
    met = spatial.overlapping(d.withColumnRenamed("cls", "label"), V.scene_regions(spark, sf_dir).where("static"), _BOX, _REGION, on=["label"])
    covered = met.where(_shared() / G.box_area(F.col("w"), F.col("h")) > 0.5).select("det_id").distinct()
    return d.join(covered, "det_id", "left_anti").select("det_id", "cls")


_IOU = f"CAST({_OVERLAP} AS DOUBLE) / (w * h + rw * rh - {_OVERLAP})"


@query(f"""{_D}, {V.REGIONS}, m AS (SELECT det_id, label, {_IOU} AS iou, row_number() OVER (PARTITION BY det_id ORDER BY {_IOU} DESC, label, rx) AS r FROM detections JOIN regions ON {_OVERLAP} > 0 WHERE {_IOU} >= 0.05)
SELECT det_id, label, floor(iou * 1000000 + 0.5::DOUBLE) / 1000000 AS iou FROM m WHERE r = 1""")
def iou_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best overlap with a known region, at a low bar here so that rows appear."""
    met = spatial.overlapping(V.detections(spark, sf_dir), V.scene_regions(spark, sf_dir), _BOX, _REGION).withColumn("iou", G.iou(*map(F.col, _BOX), *map(F.col, _REGION))).where("iou >= 0.05")
    best = met.groupBy("det_id").agg(F.min_by(F.struct("label", "iou"), F.struct(-F.col("iou"), "label", "rx")).alias("b"))
    return best.select("det_id", "b.label", (F.floor(F.col("b.iou") * 1000000 + 0.5) / 1000000.0).alias("iou"))


_NEAR = "sqrt((a.x - b.x)::DOUBLE * (a.x - b.x) + (a.y - b.y)::DOUBLE * (a.y - b.y))"


@query(f"""{_D}, a AS (SELECT det_id, cls, camera_id, x, y FROM detections WHERE k % 2 = 0), b AS (SELECT det_id, cls, camera_id, x, y FROM detections WHERE k % 2 = 1),
n AS (SELECT a.det_id, b.det_id AS thing_id, {_NEAR} AS d, row_number() OVER (PARTITION BY a.det_id ORDER BY {_NEAR}, b.det_id) AS r FROM a JOIN b ON a.cls = b.cls AND a.camera_id = b.camera_id AND abs(a.x - b.x) < 60 AND abs(a.y - b.y) < 60 WHERE {_NEAR} < 60)
SELECT a.det_id, thing_id, round(d, 4) AS distance, thing_id IS NULL AS new FROM a LEFT JOIN n ON a.det_id = n.det_id AND r = 1""")
def nearest_thing_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of association: the nearest thing of the kind under 60 away."""
    d = V.detections(spark, sf_dir)
    a = d.where("k % 2 = 0").select("det_id", "cls", "camera_id", "x", "y")
    b = d.where("k % 2 = 1").select(F.col("det_id").alias("thing_id"), "cls", "camera_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = spatial.nearest_within(a, b, "det_id", ("x", "y"), ("tx", "ty"), 60.0, ["cls", "camera_id"], "thing_id")
    return a.join(found, "det_id", "left").select("det_id", "thing_id", F.round("distance", 4).alias("distance"), F.col("thing_id").isNull().alias("new"))


@query(f"""WITH a AS (SELECT p_partkey AS i, (p_partkey * 2654435761) % 2147483648 AS da FROM part), b AS (SELECT s_suppkey AS j, (s_suppkey * 40503 * 65537) % 2147483648 AS db FROM supplier),
r AS (SELECT i, j, CAST(bit_count(xor(da, db)) AS INTEGER) AS d, row_number() OVER (PARTITION BY i ORDER BY bit_count(xor(da, db)), j) AS r FROM a, b),
p AS (SELECT i, max(j) FILTER (r = 1) AS j, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2 FROM r WHERE r <= 2 GROUP BY i)
SELECT i, j, d1, d2 FROM p WHERE d2 IS NOT NULL AND d1 < 0.75 * d2""")
def lowe_ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest descriptors by Hamming distance, kept when the nearer is clearly so."""
    b = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), (F.col("s_suppkey") * 40503 * 65537 % 2147483648).alias("db"))
    a = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_partkey") * 2654435761 % 2147483648).alias("da"))
    two = hamming.two_nearest(a, b, ("i", "da"), ("j", "db"))
    return two.where(F.col("d2").isNotNull() & (F.col("d1") < 0.75 * F.col("d2"))).select("i", "j", "d1", "d2")


@query(f"""{_D} SELECT det_id, round(least(0.99::DOUBLE, 0.4::DOUBLE + 3 * (w * h) / 704000.0::DOUBLE), 4) AS motion_confidence, greatest(0, CAST(trunc(x - w * 0.25::DOUBLE) AS INTEGER)) AS px, greatest(0, CAST(trunc(y - h * 0.25::DOUBLE) AS INTEGER)) AS py,
  least(1100, CAST(trunc(x + w * 1.25::DOUBLE) AS INTEGER)) AS qx, least(640, CAST(trunc(y + h * 1.25::DOUBLE) AS INTEGER)) AS qy, round(least(greatest(k / 360.0::DOUBLE, 0.3), 1.0), 4) AS detect_scale,
  round(CASE WHEN k < 35 THEN 1.0::DOUBLE WHEN k >= 70 THEN 0.0::DOUBLE ELSE (70 - k) / 35.0::DOUBLE END, 4) AS edge_ramp, round(t * t * (3 - 2 * t), 4) AS ink
FROM (SELECT *, least(greatest((confidence - 0.12::DOUBLE) / 0.6::DOUBLE, 0), 1) AS t FROM detections)""")
def box_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion confidence, padded crop, detector scale, edge ramp and ink."""
    x, y, w, h, k = map(F.col, ("x", "y", "w", "h", "k"))
    t = F.least(F.greatest((F.col("confidence") - 0.12) / 0.6, F.lit(0.0)), F.lit(1.0))
    ramp = F.when(k < 35, 1.0).when(k >= 70, 0.0).otherwise((F.lit(70) - k) / 35)
    return V.detections(spark, sf_dir).select(
        "det_id", F.round(F.least(F.lit(0.99), 3 * (w * h) / 704000.0 + 0.4), 4).alias("motion_confidence"),
        F.greatest(F.lit(0), (x - w * 0.25).cast("int")).alias("px"), F.greatest(F.lit(0), (y - h * 0.25).cast("int")).alias("py"), F.least(F.lit(1100), (x + w * 1.25).cast("int")).alias("qx"), F.least(F.lit(640), (y + h * 1.25).cast("int")).alias("qy"),
        F.round(F.least(F.greatest(k / 360, F.lit(0.3)), F.lit(1.0)), 4).alias("detect_scale"), F.round(ramp, 4).alias("edge_ramp"), F.round(t * t * (3 - 2 * t), 4).alias("ink"),
    )


def _top(df: DataFrame, n: int, part: str, *order) -> DataFrame:
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("turn") <= n)


@query(f"{_D}, r AS (SELECT user_id, det_id, w * h AS area, CAST(row_number() OVER (PARTITION BY user_id ORDER BY w * h DESC, det_id) AS INTEGER) AS turn FROM detections) SELECT * FROM r WHERE turn <= 6")
def motion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.detections(spark, sf_dir).select("user_id", "det_id", (F.col("w") * F.col("h")).alias("area"))
    return _top(d, 6, "user_id", F.desc("area"), "det_id")


@query(f"{_D}, r AS (SELECT camera_id, det_id, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY confidence DESC, w * h DESC, y, x, det_id) AS INTEGER) AS turn FROM detections) SELECT * FROM r")
def target_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target of a camera with its turn."""
    order = Window.partitionBy("camera_id").orderBy(F.desc("confidence"), F.desc(F.col("w") * F.col("h")), "y", "x", "det_id")
    return V.detections(spark, sf_dir).select("camera_id", "det_id", F.row_number().over(order).alias("turn"))


@query(f"{_D} SELECT det_id, cls, round(confidence, 3) AS confidence FROM detections ORDER BY confidence DESC, det_id LIMIT 6")
def best_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.detections(spark, sf_dir).orderBy(F.desc("confidence"), "det_id").limit(6).select("det_id", "cls", F.round("confidence", 3).alias("confidence"))


@query(f"{_D} SELECT cls, count(*) AS detections, count(DISTINCT user_id) AS sources, count(*) FILTER (confidence >= 0.5) AS strong, round(sum(confidence), 4) AS total FROM detections GROUP BY cls")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.detections(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("detections"), F.countDistinct("user_id").alias("sources"), F.count_if(F.col("confidence") >= 0.5).alias("strong"), F.round(F.sum("confidence"), 4).alias("total"))


@query(f"{_D} SELECT * FROM (SELECT camera_id, arg_max(det_id, (ts, det_id)) AS det_id, max(ts) AS ts, count(*) AS dropped FROM detections GROUP BY camera_id, date_trunc('day', ts))")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each camera in a batch; here a day is a batch."""
    return V.detections(spark, sf_dir).groupBy("camera_id", F.date_trunc("day", F.col("ts")).alias("day")).agg(F.max_by("det_id", F.struct("ts", "det_id")).alias("det_id"), F.max("ts").alias("ts"), F.count("*").alias("dropped")).drop("day")


@query(f"""{_D}, b AS (SELECT det_id, user_id, cls, confidence, x, y, w, h FROM detections), s AS (
  SELECT DISTINCT a.det_id FROM b a JOIN b o ON a.user_id = o.user_id AND (o.confidence > a.confidence OR (o.confidence = a.confidence AND o.det_id < a.det_id))
  AND least(a.x + a.w, o.x + o.w) > greatest(a.x, o.x) AND least(a.y + a.h, o.y + o.h) > greatest(a.y, o.y)
  WHERE CAST((least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * (least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) AS DOUBLE) / (a.w * a.h + o.w * o.h - (least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * (least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y))) > 0.45)
SELECT det_id FROM b WHERE det_id NOT IN (SELECT det_id FROM s)""")
def nms_single_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that no better box of the frame covers by more than 0.45."""
    d = V.detections(spark, sf_dir).select("det_id", "user_id", "confidence", "x", "y", "w", "h")
    o = d.select("user_id", *[F.col(c).alias(f"o_{c}") for c in ("det_id", "confidence", "x", "y", "w", "h")])
    better = (F.col("o_confidence") > F.col("confidence")) | ((F.col("o_confidence") == F.col("confidence")) & (F.col("o_det_id") < F.col("det_id")))
    other = ("o_x", "o_y", "o_w", "o_h")
    met = spatial.overlapping(d, o, _BOX, other, on=["user_id"]).where(better & (G.iou(*map(F.col, _BOX), *map(F.col, other)) > 0.45))
    return d.join(met.select("det_id").distinct(), "det_id", "left_anti").select("det_id")


@query(f"""{_D}, l AS (SELECT det_id, user_id, x - 4 AS x0, y - 4 AS y0, x + w + 4 AS x1, y + 22 AS y1 FROM detections)
SELECT a.det_id, count(*) AS collisions FROM l a JOIN l b ON a.user_id = b.user_id AND a.det_id <> b.det_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.det_id""")
def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of a source that would overlap, with a margin around each."""
    l = V.detections(spark, sf_dir).select("user_id", "det_id", (F.col("x") - 4).alias("lx"), (F.col("y") - 4).alias("ly"), (F.col("w") + 8).alias("lw"), F.lit(26).alias("lh"))
    other = l.select("user_id", *[F.col(c).alias(f"o_{c}") for c in ("det_id", "lx", "ly", "lw", "lh")])
    met = spatial.overlapping(l, other, ("lx", "ly", "lw", "lh"), ("o_lx", "o_ly", "o_lw", "o_lh"), on=["user_id"])
    return met.where("det_id <> o_det_id").groupBy("det_id").agg(F.count("*").alias("collisions"))
