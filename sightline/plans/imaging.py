"""Kernels over whole frames in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import detectors
from ..sources import views as V
from .registry import query


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame, its luma as an array of 8 rows."""
    luma = F.transform("embedding", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((v.cast("double") + 0.6) * 212 + 0.5).cast("double"))))
    return V.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("camera_id"), F.col("vec_id").alias("frame_id"), luma.alias("luma"))


#: Kernels from one frame to one frame.
FILTERS = {
    "gaussian": lambda v: K.gaussian(v, 1.0),
    "unsharp": K.unsharp,
    "equalise": lambda v: K.equalise(v, tiles=2),
    "bilateral": K.bilateral,
    "xdog": lambda v: K.xdog(v, sigma=0.8),
    "edge_overlay": K.edge_overlay,
    "line_drawing": lambda v: K.line_drawing(v, smooth=0.7),
    "illumination": K.illumination,
    "laplacian": K.laplacian,
    "superpixels": lambda v: K.superpixels(v, size=4),
    "lightness": lambda v: K.to_lab(np.repeat(v[..., None], 3, axis=2))[..., 0],
}


def filtered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``(frame_id, mean, low, high)`` of the filtered frame."""
    kernel = FILTERS[name]

    def run(batches):
        for b in batches:
            out = [kernel(np.asarray(v, float).reshape(-1, 8)) for v in b["luma"]]
            yield pd.DataFrame({"frame_id": b["frame_id"], "mean": [round(float(o.mean()), 6) for o in out], "low": [round(float(o.min()), 6) for o in out], "high": [round(float(o.max()), 6) for o in out]})

    return frames(spark, sf_dir).select("frame_id", "luma").mapInPandas(run, "frame_id long, mean double, low double, high double")


def _add(name: str):
    def kernel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filtered(spark, sf_dir, name)

    kernel_query.__name__ = f"kernel_{name}"
    query()(kernel_query)


for _name in FILTERS:
    _add(_name)


@query()
def kernel_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of foreground by a mixture model, one state a camera, frames in order."""

    def run(batches):
        camera, model = None, None
        for b in batches:
            share = []
            for f in b.itertuples(index=False):
                if f.camera_id != camera:
                    camera, model = f.camera_id, K.Mixture((8, 8))
                share.append(round(float(model.apply(np.asarray(f.luma, float).reshape(-1, 8)).mean()), 6))
            yield pd.DataFrame({"frame_id": b["frame_id"], "foreground": share})

    return frames(spark, sf_dir).repartition("camera_id").sortWithinPartitions("camera_id", "frame_id").mapInPandas(run, "frame_id long, foreground double")


def neighbours(every: DataFrame) -> DataFrame:
    """``(camera_id, frame_id, before, luma)``: frames with the one before of their
    camera. Only numbers go through the window by camera; the frames are joined to
    them and dealt to all tasks, as what follows takes long for each frame."""
    ids = every.select("camera_id", "frame_id").withColumn("prior", F.lag("frame_id").over(Window.partitionBy("camera_id").orderBy("frame_id"))).where("prior IS NOT NULL")
    before = every.select(F.col("frame_id").alias("prior"), F.col("luma").alias("before"))
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.join(before, "prior").join(every.select("frame_id", "luma"), "frame_id").select("camera_id", "frame_id", "before", "luma").repartition(parts, "frame_id")


def flow_lengths(b: pd.DataFrame) -> list[np.ndarray]:
    """Length of the flow from ``before`` to ``luma`` at each pixel of each row, all
    frames of a batch at once."""
    if not len(b):
        return []
    stacks = [np.stack([np.asarray(v, float).reshape(-1, 8) for v in b[c]], axis=-1) for c in ("before", "luma")]
    return list(np.moveaxis(np.hypot(*np.moveaxis(K.flow(*stacks), -1, 0)), -1, 0))


@query()
def kernel_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of the optical flow between a camera's neighbouring frames."""

    def run(batches):
        for b in batches:
            far = flow_lengths(b)
            yield pd.DataFrame({"frame_id": b["frame_id"], "length": [round(float(f.mean()), 4) for f in far], "moving": [int((f > 1.5).sum()) for f in far]})

    return neighbours(frames(spark, sf_dir)).select("frame_id", "before", "luma").mapInPandas(run, "frame_id long, length double, moving long")


@query()
def motion_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detections(frames(spark, sf_dir), "motion", 8)


@query()
def kernel_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [K.keypoints(np.asarray(v, float).reshape(-1, 8), patch=2) for v in b["luma"]]
            yield pd.DataFrame({"frame_id": b["frame_id"], "n": [len(p) for p, _ in found], "first": [d[0].tobytes().hex() if len(d) else "" for _, d in found]})

    return frames(spark, sf_dir).select("frame_id", "luma").mapInPandas(run, "frame_id long, n long, first string")


def suppress_batches(batches, keys: list[str], together: int = 1 << 17):
    """Frames sorted by ``keys`` to ``(det_id, turn)`` of the boxes kept. About
    ``together`` rows of many groups are done at once; a larger group is taken whole."""

    def kept(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        at, turn = K.suppressed_groups(group, rows[["x", "y", "w", "h"]].to_numpy(float), rows["confidence"].to_numpy(float), rows["det_id"].to_numpy())
        return pd.DataFrame({"det_id": rows["det_id"].to_numpy()[at], "turn": turn})

    held, count, enough = [], 0, together
    for b in batches:
        held.append(b)
        count += len(b)
        if count < enough or not count:
            continue
        rows = pd.concat(held)
        group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        # The last group may go on in the next batch.
        whole = int(np.searchsorted(group, group[-1]))
        if whole:
            yield kept(rows[:whole], group[:whole])
        held, count = [rows[whole:]], len(rows) - whole
        enough = max(together, 2 * count)
    if count:
        rows = pd.concat(held)
        yield kept(rows, rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy())


@query()
def greedy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-maximum suppression over the boxes of a source's day, best first."""
    d = V.detections(spark, sf_dir).select("user_id", F.date_trunc("day", "ts").cast("long").alias("day"), "det_id", "confidence", "x", "y", "w", "h")
    keys = ["user_id", "day"]
    return d.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda batches: suppress_batches(batches, keys), "det_id long, turn int")


@query()
def acuity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur that brings a frame's sharpness to half of what it is."""

    def run(batches):
        for b in batches:
            sigma = [K.acuity_sigma(v := np.asarray(x, float).reshape(-1, 8), K.laplacian(v).var() / 2) for x in b["luma"]]
            yield pd.DataFrame({"frame_id": b["frame_id"], "sigma": [round(s, 4) for s in sigma]})

    return frames(spark, sf_dir).select("frame_id", "luma").mapInPandas(run, "frame_id long, sigma double")
