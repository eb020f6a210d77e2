"""Detectors by name: functions from frames to boxes, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kernels

BOXES = "frame_id long, camera_id long, cls string, confidence double, x int, y int, w int, h int"
Detect = Callable[[np.ndarray, np.ndarray | None], list[dict]]


def nothing(frame, before) -> list[dict]:
    return []


def motion(frame, before) -> list[dict]:
    return [] if before is None else [{**b, "cls": "motion"} for b in kernels.motion_boxes(before, frame)]


def onnx(path: str, classes: dict[int, str], confidence: float = 0.35, overlap: float = 0.45) -> Detect:
    """A single-stage detector in an ONNX file whose output rows are centre x, y,
    width, height and class scores; decoding, class filter, suppression here."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    name = session.get_inputs()[0].name

    def detect(frame, before) -> list[dict]:
        image = np.repeat(np.asarray(frame, np.float32)[None, None] / 255, 3, axis=1)
        return decode(np.asarray(session.run(None, {name: image})[0])[0].T, classes, confidence, overlap)

    return detect


def decode(rows: np.ndarray, classes: dict[int, str], confidence: float, overlap: float) -> list[dict]:
    scores = rows[:, 4:]
    best = scores.argmax(axis=1)
    sure = [i for i in range(len(rows)) if scores[i, best[i]] >= confidence and (not classes or int(best[i]) in classes)]
    boxes = [(rows[i, 0] - rows[i, 2] / 2, rows[i, 1] - rows[i, 3] / 2, rows[i, 2], rows[i, 3]) for i in sure]
    kept = kernels.suppressed(boxes, [scores[i, best[i]] for i in sure], overlap)
    return [{"cls": classes.get(int(best[sure[k]]), str(best[sure[k]])), "confidence": float(scores[sure[k], best[sure[k]]]), **dict(zip("xywh", map(round, boxes[k]), strict=True))} for k in kept]


KINDS: dict[str, Callable[..., Detect]] = {"null": lambda **_: nothing, "motion": lambda **_: motion, "onnx": onnx}


def detector(kind: str, **settings) -> Detect:
    """Unknown kinds detect nothing."""
    return KINDS.get(kind, KINDS["null"])(**settings)


def detections(frames: DataFrame, kind: str, side: int, **settings) -> DataFrame:
    """``frames(camera_id, frame_id, luma array)``: each frame with the one before it
    of its camera, in order, one camera at a time in a task."""

    def run(batches):
        detect, last = detector(kind, **settings), {}
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                image = np.asarray(f.luma, float).reshape(-1, side)
                rows += [(f.frame_id, f.camera_id, b["cls"], b["confidence"], b["x"], b["y"], b["w"], b["h"]) for b in detect(image, last.get(f.camera_id))]
                last = {f.camera_id: image}
            yield pd.DataFrame.from_records(rows, columns=[c.split()[0] for c in BOXES.split(", ")])

    return frames.repartition("camera_id").sortWithinPartitions("camera_id", "frame_id").mapInPandas(run, BOXES)
