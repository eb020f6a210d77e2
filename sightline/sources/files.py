"""Files that a camera node keeps, as tables: frames, config, maps, scenes, notches,
checkpoints, sinks. Readers are tolerant: missing keys get defaults."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME = "path string, frame_id long, h int, w int, c int, data binary"
SECTOR = "id STRING, label STRING, polygon ARRAY<ARRAY<DOUBLE>>, floor_height DOUBLE, source STRING, confidence DOUBLE, locked BOOLEAN"
THING = "id STRING, kind STRING, label STRING, x DOUBLE, y DOUBLE, facing DOUBLE, last_seen DOUBLE, observations BIGINT, confidence DOUBLE, sector_id STRING"
WORLD = f"version INT, revision BIGINT, updated DOUBLE, homography ARRAY<ARRAY<DOUBLE>>, sectors ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in SECTOR.split(', '))}>>, things ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in THING.split(', '))}>>"
SCENE = "homography ARRAY<ARRAY<DOUBLE>>, regions ARRAY<STRUCT<label: STRING, box: ARRAY<INT>, ref_box: ARRAY<INT>, source_confidence: DOUBLE, static: BOOLEAN>>"
NOTCHES = "notches ARRAY<STRUCT<center: DOUBLE, width: DOUBLE, range: ARRAY<DOUBLE>, note: STRING, added: STRING, enabled: BOOLEAN>>"


def raw_frames(spark: SparkSession, path: str, height: int = 720, width: int = 1280, channels: int = 3, stride: int = 1) -> DataFrame:
    """Raw captures split into frames, every ``stride``-th kept; a short rest of a
    file is no frame. Split captures into files of bounded size: one is read whole."""
    size = height * width * channels

    def split(batches):
        for b in batches:
            rows = [(p, k // size, height, width, channels, bytes(d[k : k + size])) for p, d in zip(b["path"], b["content"], strict=True) for k in range(0, len(d) - size + 1, size * stride)]
            yield pd.DataFrame.from_records(rows, columns=[f.split()[0] for f in FRAME.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, FRAME)


def frame_pixels(frames: DataFrame) -> DataFrame:
    """``(path, frame_id, p, luma)`` from frames of three channels."""

    def explode(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                rgb = np.frombuffer(f.data, np.uint8).reshape(-1, f.c).astype(float)
                luma = np.rint(rgb @ np.array([0.299, 0.587, 0.114]) if f.c == 3 else rgb[:, 0]).astype(int)
                yield pd.DataFrame({"path": f.path, "frame_id": f.frame_id, "p": np.arange(len(luma)), "luma": luma})

    return frames.mapInPandas(explode, "path string, frame_id long, p int, luma int")


def config(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of ``KEY=VALUE`` lines; blanks and comments are skipped, of
    keys that repeat the last line counts within a file."""
    line = F.trim("value")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "value"))
    pairs = rows.where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("="))).select("n", F.split(line, "=", 2).alias("kv"))
    return pairs.groupBy(F.trim(F.col("kv")[0]).alias("key")).agg(F.max_by(F.trim(F.col("kv")[1]), "n").alias("value"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file; a missing file: no rows; a broken one: NULLs."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j")).select("j.*")


def world(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``sectors``, ``things`` and ``meta`` of a saved map; no file: an empty map."""
    saved = _json(spark, path, WORLD)
    s = saved.select(F.explode("sectors").alias("s")).select("s.*")
    t = saved.select(F.explode("things").alias("t")).select("t.*")
    return {
        "sectors": s.select("id", F.coalesce("label", F.lit("")).alias("label"), F.transform("polygon", lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))).alias("polygon"), F.coalesce("floor_height", F.lit(0.0)).alias("floor_height"), F.coalesce("source", F.lit("confirmed")).alias("source"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("locked", F.lit(False)).alias("locked")),
        "things": t.select("id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("label", F.lit("")).alias("label"), "x", "y", "facing", F.coalesce("last_seen", F.lit(0.0)).alias("last_seen"), F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "sector_id"),
        "meta": saved.select(F.coalesce("revision", F.lit(0)).alias("revision"), F.coalesce("updated", F.lit(0.0)).alias("updated"), "homography"),
    }


def save_world(sectors: DataFrame, things: DataFrame, revision: int, updated: float, path: str | None) -> str:
    """Write a map as a new version below ``path``; its name sorts after older ones
    and appears whole, as the commit of a job. Returns the version's path."""
    if not path:
        raise ValueError("a map needs a path to be saved to")
    flat = sectors.withColumn("polygon", F.transform("polygon", lambda v: F.array(v["x"], v["y"])))
    # One document: the sectors and things of one floor plan.
    one = flat.agg(F.collect_list(F.struct(*flat.columns)).alias("sectors")).withColumn("things", things.agg(F.collect_list(F.struct(*things.columns))).scalar())
    out = f"{path}/v-{revision:012d}-{uuid.uuid4().hex[:8]}"
    one.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(revision).alias("revision"), F.lit(updated).alias("updated"), "sectors", "things"))).coalesce(1).write.text(out)
    return out


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The newest version that ``save_world`` completed below ``path``."""
    try:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"(v-\d{12}-\w{8})/part-", 1).alias("v"))
    except AnalysisException:
        return None
    newest = names.agg(F.max("v")).first()[0]
    return f"{path}/{newest}" if newest else None


def scene(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a registered scene; a model without a 3 x 3 map is no model."""
    model = _json(spark, path, SCENE).where((F.size("homography") == 3) & F.forall("homography", lambda r: F.size(r) == 3))
    r = model.select(F.explode("regions").alias("r")).select("r.*")
    box = [F.col("box")[k].alias(n) for k, n in enumerate(("rx", "ry", "rw", "rh"))]
    return r.select("label", *box, F.coalesce("source_confidence", F.lit(0.0)).alias("source_confidence"), F.coalesce("static", F.lit(True)).alias("static"))


def notches(spark: SparkSession, path: str) -> DataFrame:
    n = _json(spark, path, NOTCHES).select(F.posexplode("notches").alias("i", "n"))
    return n.select("i", "n.center", "n.width", F.get("n.range", F.lit(0)).alias("lo"), F.get("n.range", F.lit(1)).alias("hi"), "n.note", "n.added", "n.enabled")


def save_detections(detections: DataFrame, path: str) -> None:
    """Detections as JSON, best first in each file's order, confidence to 3 places."""
    detections.withColumn("confidence", F.bround("confidence", 3)).orderBy(F.desc("confidence"), "det_id").write.mode("overwrite").json(path)


def notification_sink(path: str):
    """For ``foreachBatch``: one row for each promoted track, appended; a batch that
    runs again after a failure replaces its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy("camera_id", "track_id").orderBy("pass_no")
        first = batch.where("promoted").withColumn("r", F.row_number().over(order)).where("r = 1")
        first.select("camera_id", "track_id", "cls", "pass_no", F.round("evidence", 2).alias("evidence"), F.concat(F.upper("cls"), F.lit(" detected")).alias("title")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def snapshot_sink(path: str):
    """For ``foreachBatch``: the newest row of each key as of the batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
