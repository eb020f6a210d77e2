"""Readers, writers, sinks and windowed streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.plans import machines as P
from sightline.plans import proposal
from sightline.sources import files
from sightline.streaming import adapters as A
from sightline.streaming import windows as W


def test_raw_frames(spark, tmp_path):
    data = np.arange(3 * 2 * 4 * 3 + 5, dtype=np.uint8)
    (tmp_path / "a.rgb").write_bytes(data.tobytes())
    got = files.raw_frames(spark, str(tmp_path), 2, 4, 3).orderBy("frame_id").collect()
    assert [r["frame_id"] for r in got] == [0, 1, 2] and bytes(got[1]["data"]) == data[24:48].tobytes()
    assert files.raw_frames(spark, str(tmp_path), 2, 4, 3, stride=2).count() == 2
    luma = files.frame_pixels(files.raw_frames(spark, str(tmp_path), 2, 4, 3)).where("frame_id = 0 AND p = 1").first()["luma"]
    assert luma == round(0.299 * 3 + 0.587 * 4 + 0.114 * 5)


def test_config(spark, tmp_path):
    (tmp_path / "c.env").write_text("# note\n\nA=1\n B = x=y \nbad line\nA=2\n")
    assert {r["key"]: r["value"] for r in files.config(spark, str(tmp_path / "c.env")).collect()} == {"A": "2", "B": "x=y"}


def test_world_round_trip(spark, tmp_path):
    where = str(tmp_path / "maps")
    assert files.latest_version(spark, where) is None
    empty = files.world(spark, str(tmp_path / "none.json"))
    assert all(t.count() == 0 for t in empty.values())
    (tmp_path / "w.json").write_text(json.dumps({"version": 1, "revision": 4, "sectors": [{"id": "s1", "polygon": [[0, 0], [3, 0], [3, 2]], "floor_height": 40}], "things": [{"id": "t1", "x": 1.5, "y": 0.5}]}))
    w = files.world(spark, str(tmp_path / "w.json"))
    s, t = w["sectors"].first(), w["things"].first()
    assert (s["source"], s["floor_height"], s["locked"], s["polygon"][1]["x"]) == ("confirmed", 40.0, False, 3.0)
    assert (t["kind"], t["facing"], t["sector_id"], t["observations"]) == ("unknown", None, None, 0)
    for revision in (4, 5):
        files.save_world(w["sectors"], w["things"], revision, 9.0, where)
    again = files.world(spark, files.latest_version(spark, where))
    assert again["meta"].first()["revision"] == 5
    assert again["sectors"].collect() == w["sectors"].collect() and again["things"].collect() == w["things"].collect()
    with pytest.raises(ValueError):
        files.save_world(w["sectors"], w["things"], 1, 0.0, None)


def test_scene_and_notches(spark, tmp_path):
    eye = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    region = {"label": "couch", "box": [1, 2, 3, 4]}
    (tmp_path / "good.json").write_text(json.dumps({"homography": eye, "regions": [region]}))
    (tmp_path / "bad.json").write_text(json.dumps({"homography": eye[:2], "regions": [region]}))
    (tmp_path / "broken.json").write_text("{")
    r = files.scene(spark, str(tmp_path / "good.json")).first()
    assert (r["label"], r["rw"], r["static"]) == ("couch", 3, True)
    assert files.scene(spark, str(tmp_path / "bad.json")).count() == files.scene(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "n.json").write_text(json.dumps({"notches": [{"range": [3072, 3092]}, {"center": 8000, "width": 30, "enabled": False}]}))
    n = files.notches(spark, str(tmp_path / "n.json")).orderBy("i").collect()
    assert (n[0]["lo"], n[0]["hi"], n[0]["center"], n[1]["center"], n[1]["enabled"]) == (3072, 3092, None, 8000, False)


def test_detection_sink(spark, tmp_path):
    files.save_detections(spark.createDataFrame([(1, 0.12345), (2, 0.9)], "det_id long, confidence double"), str(tmp_path / "d"))
    assert sorted(r["confidence"] for r in spark.read.json(str(tmp_path / "d")).collect()) == [0.123, 0.9]


def test_notifications_come_once_a_track(spark, sf_dir, tmp_path):
    rows = P.passes(spark, sf_dir)
    tracks = A.batch(rows, A.TrackScan, ["pass_no", "det_id"], A.TRACKS)
    files.notification_sink(str(tmp_path / "n"))(tracks, 0)
    got = spark.read.parquet(str(tmp_path / "n"))
    assert got.count() == got.select("camera_id", "track_id").distinct().count() == tracks.where("promoted").select("camera_id", "track_id").distinct().count()


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(200)


def test_session_stream(spark, sf_dir, tmp_path):
    run(W.sessions(W.event_stream(spark, sf_dir)), tmp_path, "sessions")
    got = spark.sql("SELECT * FROM sessions")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("beats"))
    closed = whole.join(got.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("beats").alias("b")), (whole.user_id == got.user_id) & (F.col("session_window.start") == F.col("started")))
    assert got.count() > 100 and closed.where("beats = b").count() == got.count()


def test_window_and_change_streams(spark, sf_dir, tmp_path):
    events = W.event_stream(spark, sf_dir)
    px = events.select("ts", (F.col("user_id") % 2).alias("camera_id"), F.lit(0).alias("p"), F.col("value").alias("luma"))
    run(W.window_stats(px, "1 day"), tmp_path, "stats")
    run(W.window_stats(px, "2 days", "1 day"), tmp_path, "sliding")
    assert 10 < spark.sql("SELECT * FROM stats").count() <= spark.sql("SELECT * FROM sliding").count()
    log = events.select("ts", (F.col("user_id") % 2).alias("camera_id"), F.floor(F.col("event_id") / 10).alias("revision"))
    run(W.changes(log), tmp_path, "changed")
    whole = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 2).alias("c"), F.floor(F.col("event_id") / 10).alias("r")).distinct()
    assert spark.sql("SELECT * FROM changed").count() == whole.count()


def test_latest_row_of_a_batch(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (0, 1, TIMESTAMP'2024-01-01 00:00:01'), (0, 2, TIMESTAMP'2024-01-01 00:00:02'), (1, 3, TIMESTAMP'2024-01-01 00:00:00') AS r(camera_id, frame_id, ts)")
    W.latest(str(tmp_path / "l"))(rows, 0)
    assert sorted(r["frame_id"] for r in spark.read.parquet(str(tmp_path / "l")).collect()) == [2, 3]


def test_corner_order_and_outline():
    quad = np.array([(9, 1), (0, 10), (10, 9), (1, 0)], float)
    assert proposal.ordered(quad).tolist() == [[0, 10], [10, 9], [9, 1], [1, 0]]
    image = np.full((60, 60), 200.0)
    image[20:40, 20:40] = 50
    shape = {(v["x"], v["y"]) for v in proposal.outline(image, 15, 15, 30, 30)}
    assert shape == {(20.0, 20.0), (40.0, 20.0), (40.0, 40.0), (20.0, 40.0)}
    assert len(proposal.outline(image, 100, 100, 5, 5)) == 4
