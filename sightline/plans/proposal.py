"""Proposals for a map: floor by stability or colour, sectors from furniture."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K
from ..sources import views as V
from .floor import FLOOR, HEIGHTS, SIGN
from .frames import bands, cell_stats, foreground
from .registry import query

#: Cells along a side of the test grid, and the share of it that is the low band.
GRID, LOW_BAND = 8, 0.45
QUAD = "camera_id long, cells int, quad array<struct<x: double, y: double>>"


def ordered(quad: np.ndarray) -> np.ndarray:
    """Near left, near right, far right, far left; near is lower in the picture."""
    by_y = quad[np.argsort(-quad[:, 1], kind="stable")]
    near, far = by_y[:2], by_y[2:]
    near, far = near[np.argsort(near[:, 0], kind="stable")], far[np.argsort(far[:, 0], kind="stable")]
    return np.array([near[0], near[1], far[1], far[0]])


def floor_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The largest blob of steady, empty cells in the lowest band of one camera's
    grid, as a quadrilateral. A grid has a few thousand cells at most."""
    side, low = GRID, LOW_BAND
    mask = np.zeros((side, side), bool)
    good = rows[rows["steady"]]
    mask[good["py"], good["px"]] = True
    mask[: int(side * (1 - low))] = False
    label, n = K.blobs(K.closed(mask))
    if not n:
        return pd.DataFrame({"camera_id": [], "cells": [], "quad": []})
    k = int(np.bincount(label.ravel())[1:].argmax()) + 1
    ys, xs = np.nonzero(label == k)
    corners = np.concatenate([np.stack([xs + dx, ys + dy], axis=1) for dx in (0, 1) for dy in (0, 1)])
    quad = ordered(K.least_rectangle(corners))
    return pd.DataFrame({"camera_id": [rows["camera_id"].iloc[0]], "cells": [len(ys)], "quad": [[{"x": float(x), "y": float(y)} for x, y in quad]]})


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = V.pixels(spark, sf_dir)
    stats = cell_stats(px)
    near = (F.abs(F.col("luma") - F.col("med")) <= F.greatest("sd", F.lit(1e-6))).cast("double")
    stability = px.select("camera_id", "p", "luma").join(stats, ["camera_id", "p"]).groupBy("camera_id", "p", "px", "py").agg(F.avg(near).alias("stability"))
    fg = foreground(spark, sf_dir).groupBy("camera_id", "p").agg(F.avg(F.col("on_").cast("double")).alias("fg"))
    return stability.join(fg, ["camera_id", "p"])


@query()
def floor_by_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds suit the test frames, whose cells all change."""
    steady = (F.col("fg") <= 0.15) & (F.col("stability") >= 0.6)
    return _cells(spark, sf_dir).withColumn("steady", steady).groupBy("camera_id").applyInPandas(floor_of, QUAD)


_COLOUR = f"""WITH {V.PIXELS}, b AS (SELECT camera_id, p, px, py, CAST(trunc(median(luma)) AS INTEGER) AS g FROM pixels GROUP BY ALL), r AS (SELECT camera_id, min(g) AS lo, max(g) AS hi FROM b GROUP BY camera_id),
banded AS (SELECT b.*, least(5, CAST(trunc((g - lo) / (hi - lo)::DOUBLE * 6) AS INTEGER)) AS band FROM b JOIN r USING (camera_id) WHERE hi - lo >= 1),
s AS (SELECT camera_id, band, count(*) / 64.0::DOUBLE AS area, avg(CASE WHEN px BETWEEN 1 AND 3 AND py BETWEEN 1 AND 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS covered, avg(py / 8.0::DOUBLE) AS cy, avg(g) AS mean FROM banded GROUP BY ALL),
k AS (SELECT *, round(area * (1 - covered) * (cy + 0.5), 6) AS score FROM s WHERE mean >= 25 AND area >= 0.02)
SELECT camera_id, band, turn, score, round(area, 6) AS area FROM (SELECT *, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY score DESC, band) AS INTEGER) AS turn FROM k) WHERE turn <= 4"""


@query(_COLOUR)
def floor_by_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the background ranked by area, bareness and lowness, four a camera."""
    bg = V.pixels(spark, sf_dir).groupBy("camera_id", "p", "px", "py").agg(F.median("luma").cast("int").alias("g"))
    covered = F.avg(((F.col("px").between(1, 3)) & F.col("py").between(1, 3)).cast("double"))
    s = bands(bg).groupBy("camera_id", "band").agg((F.count("*") / 64.0).alias("area"), covered.alias("covered"), F.avg(F.col("py") / 8.0).alias("cy"), F.avg("g").alias("mean"))
    score = F.col("area") * (1 - F.col("covered")) * (F.col("cy") + 0.5)
    ranked = s.where("mean >= 25 AND area >= 0.02").withColumn("score", F.round(score, 6)).withColumn("turn", F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("score"), "band")))
    return ranked.where("turn <= 4").select("camera_id", "band", "turn", "score", F.round("area", 6).alias("area"))


def outline(image: np.ndarray, x: int, y: int, w: int, h: int, near: float = 20.0) -> list[dict]:
    """Outline of what the middle of a box shows: pixels of its most frequent tone,
    their hull; the box itself where these are too few."""
    crop = image[y : y + h, x : x + w]
    box = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    if crop.size:
        inner = crop[h // 3 : max(h // 3 + 1, 2 * h // 3), w // 3 : max(w // 3 + 1, 2 * w // 3)]
        tones, counts = np.unique(inner // 16, return_counts=True)
        label, n = K.blobs(np.abs(crop - (tones[counts.argmax()] * 16 + 8)) < near)
        if n:
            k = int(np.bincount(label.ravel())[1:].argmax()) + 1
            ys, xs = np.nonzero(label == k)
            shape = K.hull(np.concatenate([np.stack([xs + dx, ys + dy], axis=1) for dx in (0, 1) for dy in (0, 1)]))
            if len(ys) >= 0.08 * crop.size and len(shape) >= 3:
                box = [(float(a) + x, float(b) + y) for a, b in shape]
    return [{"x": float(a), "y": float(b)} for a, b in box]


@query()
def propose_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture boxes to sectors: outline, lower edge, horizon, projection, height.

    Outlines with fewer than three vertices below the horizon are dropped.
    """
    from .imaging import frames

    boxes = V.scene_regions(spark, sf_dir).where("static").select("label", "rx", "ry", "rw", "rh")
    picture = frames(spark, sf_dir).where("frame_id = 0").select("luma")
    pairs = boxes.withColumn("luma", picture.scalar())

    def outlines(batches):
        for b in batches:
            images = [np.kron(np.asarray(v, float).reshape(-1, 8), np.ones((90, 140))) for v in b["luma"]]
            yield pd.DataFrame({"label": b["label"], "polygon": [outline(i, *map(int, r)) for i, r in zip(images, b[["rx", "ry", "rw", "rh"]].to_numpy(), strict=True)]})

    shapes = pairs.mapInPandas(outlines, "label string, polygon array<struct<x: double, y: double>>")
    foot = G.lower_edge(F.col("polygon"))
    seen = F.filter(foot, lambda v: G.below_horizon(FLOOR, SIGN, v["x"], v["y"]))
    plan = F.transform(seen, lambda v: G.project(FLOOR, v["x"], v["y"]))
    rows = ", ".join(f"('{a}', {b}D)" for a, b in HEIGHTS.items())
    heights = spark.sql(f"SELECT * FROM VALUES {rows} AS h(label, height)")
    made = shapes.select("label", plan.alias("polygon")).where(F.size("polygon") >= 3).join(heights, "label", "left")
    floor = spark.sql("SELECT 'floor' AS label, 0.0D AS floor_height, 'proposed' AS source, 4 AS vertices")
    return floor.unionByName(made.select("label", F.coalesce("height", F.lit(0.0)).alias("floor_height"), F.lit("proposed").alias("source"), F.size("polygon").alias("vertices")))


_LEARNER = f"""WITH {V.PIXELS}, t AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_id) AS turn FROM (SELECT DISTINCT camera_id, frame_id FROM pixels)), dealt AS (SELECT * FROM pixels JOIN t USING (camera_id, frame_id)),
d AS (SELECT camera_id, px, turn, abs(luma - lag(luma) OVER (PARTITION BY frame_id, py ORDER BY px)) AS step FROM dealt), l AS (SELECT camera_id, px % 4 AS phase, avg(step) AS m FROM d WHERE turn <= 40 AND px > 0 GROUP BY ALL),
prior AS (SELECT camera_id, arg_max(phase, (m, -phase)) AS phase, max(m) / median(m) AS excess FROM l GROUP BY camera_id), f AS (SELECT frame_id, p, luma, excess, turn > 40 AND excess >= 1.05 AND px % 4 = phase AS corrected FROM dealt JOIN prior USING (camera_id))
SELECT frame_id, p, CASE WHEN corrected THEN CAST(trunc(luma / excess) AS INTEGER) ELSE luma END AS luma, corrected FROM f"""


@query(_LEARNER)
def grid_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty frames of a camera teach the grid's phase and pass as they
    are; later ones are corrected, if there is a grid."""
    px = V.pixels(spark, sf_dir)
    turn = px.select("camera_id", "frame_id").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_id")))
    dealt = px.join(turn, ["camera_id", "frame_id"])
    step = F.abs(F.col("luma") - F.lag("luma").over(Window.partitionBy("frame_id", "py").orderBy("px")))
    learned = dealt.where("turn <= 40").withColumn("step", step).where("px > 0").groupBy("camera_id", (F.col("px") % 4).alias("phase")).agg(F.avg("step").alias("m"))
    prior = learned.groupBy("camera_id").agg(F.max_by("phase", F.struct(F.col("m"), -F.col("phase"))).alias("phase"), (F.max("m") / F.median("m")).alias("excess"))
    on = (F.col("turn") > 40) & (F.col("excess") >= 1.05) & (F.col("px") % 4 == F.col("phase"))
    fixed = F.when(on, (F.col("luma") / F.col("excess")).cast("int")).otherwise(F.col("luma"))
    return dealt.join(prior, "camera_id").select("frame_id", "p", fixed.alias("luma"), on.alias("corrected"))


#: Mean flow of a frame with motion, and how many such frames teach the marks.
MOTION, SAMPLES = 0.4, 30


@query()
def artifact_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks on the lens from a camera's first thirty frames with motion, as a still
    scene would be learned too; too large a mask, or fewer such frames, is none."""
    from .imaging import flow_lengths, frames, neighbours

    every = frames(spark, sf_dir)
    two = neighbours(every)

    def moving(batches):
        for b in batches:
            yield b.loc[np.array([f.mean() for f in flow_lengths(b)]) >= MOTION, ["camera_id", "frame_id", "luma"]]

    moved = two.select("camera_id", "frame_id", "before", "luma").mapInPandas(moving, "camera_id long, frame_id long, luma array<double>")
    first = moved.withColumn("turn", F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_id"))).where(F.col("turn") <= SAMPLES)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        stack = [np.asarray(v, float).reshape(-1, 8) for v in rows.sort_values("frame_id")["luma"]]
        mask = K.artifact_mask(stack) if len(stack) == SAMPLES else None
        return pd.DataFrame({"camera_id": [rows["camera_id"].iloc[0]], "accepted": [mask is not None], "marked": [int(mask.sum()) if mask is not None else 0]})

    learned = first.select("camera_id", "frame_id", "luma").groupBy("camera_id").applyInPandas(learn, "camera_id long, accepted boolean, marked int")
    return every.select("camera_id").distinct().join(learned, "camera_id", "left").select("camera_id", F.coalesce("accepted", F.lit(False)).alias("accepted"), F.coalesce("marked", F.lit(0)).alias("marked"))
