"""State machines alone, in batch and as streams."""

import functools

import pytest
from pyspark.sql import functions as F

from sightline.plans import machines as P
from sightline.sources import views as V
from sightline.streaming import adapters as A
from sightline.streaming import machines as M

SECTORS = [{"id": 1, "height": 0.0, "polygon": [(0, 0), (300, 0), (300, 250), (0, 250)]}, {"id": 2, "height": 40.0, "polygon": [(60, 90), (230, 90), (230, 190), (60, 190)]}]


def seen(cls="cat", box=(0, 0, 10, 10), confidence=0.4):
    return {"cls": cls, "box": list(box), "confidence": confidence}


def test_newborns_are_promoted_at_the_second_pass():
    t = M.Tracker()
    assert [x["promoted"] for x in t.observe([seen(confidence=0.9)], 0)] == [False]
    assert [x["promoted"] for x in t.observe([seen()], 1)] == [True]
    assert t.tracks[0]["evidence"] == pytest.approx(0.9 * 0.85 + 0.4)


def test_a_miss_can_promote_a_strong_newborn():
    t = M.Tracker()
    t.observe([seen(confidence=0.9)], 0)
    assert t.observe([], 1)[0]["promoted"]


def test_tracks_depart_after_six_misses():
    t = M.Tracker()
    t.observe([seen()], 0)
    states = [t.observe([], k)[0]["state"] for k in range(1, 7)]
    assert states == ["missing"] * 5 + ["departed"] and t.tracks == []


def test_matching_is_greedy_by_class_and_distance():
    t = M.Tracker()
    t.observe([seen(box=(0, 0, 10, 10)), seen(box=(100, 0, 10, 10))], 0)
    t.observe([seen(box=(60, 0, 10, 10)), seen(box=(95, 0, 10, 10)), seen("dog", (0, 0, 10, 10)), seen(box=(1000, 0, 10, 10))], 1)
    assert [(x["id"], x["box"][0], x["cls"]) for x in t.tracks] == [(1, 95, "cat"), (2, 60, "cat"), (3, 0, "dog"), (4, 1000, "cat")]
    edge = M.Tracker()
    edge.observe([seen(box=(0, 0, 10, 10))], 0)
    edge.observe([seen(box=(181, 0, 10, 10))], 1)
    assert len(edge.tracks) == 2


def test_world_changes_only_when_seen_to_change():
    w = M.WorldMap(sectors=SECTORS)
    first, changed = w.observe(150, 140, "cat", 0.5, 0)
    assert changed and first["sector"] == 2 and w.revision == 1
    for k in range(20):
        assert not w.observe(150 + (k % 2) * 8, 140, "cat", 0.4, k)[1]
    assert w.revision == 1 and w.things[0]["seen"] == 21 and w.things[0]["x"] == 150
    assert w.observe(150, 149, "cat", 0.4, 30)[1] and w.things[0]["y"] == 149
    assert w.observe(150, 149, "cat", 0.4, 31, facing=90.0)[1] and not w.observe(150, 149, "cat", 0.4, 32, facing=90.0)[1]
    assert w.observe(150, 209, "cat", 0.4, 33)[0]["id"] != first["id"]
    assert w.observe(150, 149, "dog", 0.4, 34)[0]["kind"] == "dog"
    assert w.forget("dog-3") and not w.forget("none")
    w.replace_sectors(SECTORS[:1])
    assert w.things[0]["sector"] == 1
    assert M.WorldMap.load(w.dump()).dump() == w.dump()


def test_highest_sector_and_ties():
    assert M.sector_at(SECTORS, 20, 20) == 1 and M.sector_at(SECTORS, 150, 140) == 2 and M.sector_at(SECTORS, -5, 0) is None
    twin = [dict(SECTORS[0], id=7), dict(SECTORS[0], id=8)]
    assert M.sector_at(twin, 20, 20) == 7


def test_entities_climb_the_ladder():
    s = M.EntityStore()
    for k in range(60):
        e = s.observe("image", (100 + k % 3, 50, 40, 40), k * 11.0, 0.6, "cat" if k == 3 else "dog", 0.9 if k == 3 else 0.5)
    assert (e["n"], e["state"], e["kind"], e["klass"], len(e["recent"])) == (60, "persistent", "static", "cat", 60)
    other = s.observe("plan", (100, 50, 40, 40), 700.0, 0.0, None, 0.0)
    assert other["id"] == 2 and other["hits"] == 0 and other["klass"] is None
    assert s.forget(700.0 + 604800.0) == 0 and s.forget(701.0 + 604800.0) == 1
    assert s.name(1, "Tom") and not s.name(9, "x")
    assert M.EntityStore.load(s.dump()) == s


def test_accumulator():
    a = M.Accumulator(rate=1.0)
    got = [a.tick(t / 4, [float(t), 10.0]) for t in range(4)]
    assert [g[0] for g in got] == ["wait"] * 3 + ["crop"] and got[3][1] == [1.0, 10.0]
    assert a.tick(1.0, [0.0, 0.0])[0] == "wait" and a.opened is None
    assert a.tick(1.2, None)[0] == "wait" and a.tick(1.75, None)[0] == "full"
    assert a.tick(3.0, [0.0, 0.0])[0] == "wait" and a.tick(3.5, [50.0, 50.0])[0] == "wait"
    assert a.tick(5.0, [50.0, 50.0]) == ("crop", [0.0, 0.0])


def test_notifier_order_of_refusals():
    n = M.Notifier(classes=["cat"], queue=2)
    assert n.promoted(1, "dog", 0) == "class"
    assert n.promoted(1, "cat", 0) == "sent" and n.promoted(1, "cat", 1) == "told"
    assert n.promoted(2, "cat", 100) == "cooldown" and n.promoted(2, "cat", 400) == "told"
    assert n.promoted(3, "cat", 300) == "sent"
    assert n.promoted(4, "cat", 700) == "full"
    n.delivered()
    assert n.promoted(4, "cat", 701) == "sent"
    assert M.Notifier(enabled=False).promoted(1, "human", 0) == "off"


def test_learner_and_scene():
    m = M.Learner(need=2)
    assert [m.step(lambda: 1) for _ in range(4)] == ["learning", "learning", "on", "on"]
    bad = M.Learner(need=0)
    assert bad.step(lambda: 1 / 0) == "off" and bad.step(lambda: 1) == "off"
    s = M.SceneModel()
    assert not s.register(0.4) and s.check(0, 99) == "unregistered"
    assert s.register(0.5) and s.check(0, 99) == "stale" and s.check(30, 0) == "stale" and s.check(60, 0) == "registered"


def play(spark, tmp_path, df, adapter, order, schema, keys, parts, make=None):
    """The rows through a file stream, a file a batch."""
    ordered = df.orderBy(*order).toPandas()
    step = -(-len(ordered) // parts)
    for k in range(parts):
        spark.createDataFrame(ordered.iloc[k * step : (k + 1) * step], df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = make(source) if make else A.stream(source, adapter, order, schema, keys)
    run = out.writeStream.format("memory").queryName("played").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    return [tuple(r) for r in spark.sql("SELECT * FROM played").collect()]


@pytest.mark.parametrize("by_cell", [False, True])
def test_world_stream_equals_batch(spark, sf_dir, tmp_path, by_cell):
    """With the whole machine as state, and with an entry for each grid cell."""
    from sightline.plans.floor import observed

    rows = observed(spark, sf_dir).select("camera_id", "kind", "det_id", F.col("ts").cast("timestamp").alias("ts"), "fx", "fy", "confidence").where("camera_id < 2")
    scan = functools.partial(A.WorldScan, P.sector_list(spark, sf_dir))
    keys = ("camera_id", "kind")
    want = [tuple(r) for r in A.batch(rows, scan, ["ts", "det_id"], A.WORLD, keys).collect()]
    assert len(want) > 50
    make = (lambda source: A.world_stream(source, P.sector_list(spark, sf_dir), ["ts", "det_id"], keys)) if by_cell else None
    assert sorted(map(str, play(spark, tmp_path, rows, scan, ["ts", "det_id"], A.WORLD, keys, 3, make))) == sorted(map(str, want))


def test_track_stream_equals_batch_but_for_the_open_pass(spark, sf_dir, tmp_path):
    rows = P.passes(spark, sf_dir).where("camera_id = 1")
    want = [tuple(r) for r in A.batch(rows, A.TrackScan, ["pass_no", "det_id"], A.TRACKS).collect()]
    last = max(r[1] for r in want)
    got = play(spark, tmp_path, rows, A.TrackScan, ["pass_no", "det_id"], A.TRACKS, ("camera_id",), 3)
    assert sorted(map(str, got)) == sorted(str(r) for r in want if r[1] < last)


def test_batches_of_the_scan_hold_state(spark, sf_dir):
    rows = P.passes(spark, sf_dir)
    whole = sorted(map(str, A.batch(rows, A.TrackScan, ["pass_no", "det_id"], A.TRACKS).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    small = sorted(map(str, A.batch(rows, A.TrackScan, ["pass_no", "det_id"], A.TRACKS).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == whole


def test_events_can_be_streamed(spark, sf_dir):
    assert V.detections(spark, sf_dir).count() > 0
