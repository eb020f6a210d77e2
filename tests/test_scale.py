"""Queries on crowded tables: the work that grew with the square of a crowd."""

import math
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from sightline import plans
from sightline.functions import kernels as K
from sightline.operators import hamming, spatial
from sightline.plans import imaging, machines
from sightline.streaming import adapters as A
from sightline.streaming import machines as M


def crowd(n, groups, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"user_id": np.sort(rng.integers(0, groups, n)), "day": 0, "det_id": rng.permutation(n), "confidence": rng.integers(0, 9, n) / 8, "x": rng.integers(0, 90, n), "y": rng.integers(0, 90, n), "w": rng.integers(0, 60, n), "h": rng.integers(1, 60, n)})


def test_groups_are_suppressed_together_as_one_by_one():
    """Groups cut by batches, ties of scores, empty boxes, boxes without a place."""
    rows = crowd(600, 12).astype(dict.fromkeys(("user_id", *"xyw"), float))
    rows.loc[rows.index[::50], ["x", "y", "w"]] = np.nan
    rows.loc[rows["user_id"] == 11, "user_id"] = np.nan
    want = set()
    for _, group in rows.groupby("user_id", dropna=False):
        group = group.sort_values("det_id")
        kept = K.suppressed(group[["x", "y", "w", "h"]].to_numpy().tolist(), group["confidence"].to_numpy())
        want |= {(int(group["det_id"].iloc[i]), n + 1) for n, i in enumerate(kept)}
    for size, together in ((7, 1), (50, 100), (600, 10_000)):
        out = list(imaging.suppress_batches((rows[k : k + size] for k in range(0, 600, size)), ["user_id", "day"], together))
        got = [tuple(map(int, r)) for f in out for r in f.itertuples(index=False)]
        assert len(got) == len(want) and set(got) == want
    assert list(imaging.suppress_batches(iter([rows[:0]]), ["user_id", "day"], 1)) == []


def test_suppression_makes_no_python_call_a_group(spark, sf_dir):
    plan = plans.QUERIES["greedy_suppression"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


def events(path, rows):
    """``rows``: SQL of event_id, user_id, event_type, k and hours, written as events."""
    c = duckdb.connect()
    c.sql(f"""copy (select event_id::bigint as event_id, timestamp '2024-01-01' + to_hours(hours::int) as ts, user_id::bigint as user_id, event_type, 40.0 + event_id % 50 as value, '{{"k": ' || k || '}}' as props from ({rows})) to '{path}/events.parquet'""")
    c.sql(f"create view events as select * from '{path}/events.parquet'")
    return c


def test_nearest_thing_in_a_crowd_equals_its_sql(spark, tmp_path):
    """Few users and two kinds, so that most places have many copies; a kind that is
    unknown meets nothing."""
    c = events(tmp_path, "select range as event_id, range * 7 % 23 * 4 as user_id, case when range % 50 = 0 then 'other' when range % 3 = 0 then 'view' else 'click' end as event_type, range % 100 as k, 0 as hours from range(4000)")
    got = [tuple(r) for r in plans.QUERIES["nearest_thing_in_radius"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(c.sql(plans.ORACLE_SQL["nearest_thing_in_radius"]).fetchall(), key=str)
    assert any(new for *_, new in got) and not all(new for *_, new in got)


@pytest.mark.parametrize("spread", [3.0, 60.0, 900.0])
def test_nearest_of_places(spread):
    """Clumps and single places, ties, and nothing within the radius."""
    rng = np.random.default_rng(int(spread))
    a, b = (np.round(np.vstack([rng.uniform(0, spread, (150, 2)), rng.uniform(-900, 900, (60, 2))])) for _ in "ab")
    at, far = spatial._nearest(a, b, 60.0)
    for p, k, d in zip(a.tolist(), at, far, strict=True):
        least, one = min((math.dist(p, q), n) for n, q in enumerate(b.tolist()))
        assert (k, d) == (one, pytest.approx(least)) if least < 60 else k == -1


def test_nearest_has_no_row_a_pair(spark):
    """All places of both sides in one cell: before, 1.5 million joined rows."""
    left = spark.range(1500).selectExpr("id AS l", "0 AS g", "id % 40 AS x", "id div 40 AS y")
    right = spark.range(1000).selectExpr("id AS r", "0 AS g", "(id * 3) % 41 AS tx", "id % 37 AS ty")
    near = spatial.nearest_within(left, right, "l", ("x", "y"), ("tx", "ty"), 60.0, ["g"], "r")
    plan = near._jdf.queryExecution().toString()
    assert near.count() == 1500 and "FlatMapCoGroupsInPandas" in plan and "Join" not in plan


@pytest.mark.parametrize("bits", [31, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 50, 9000])
def test_two_nearest_codes_are_those_of_all_pairs(n, bits):
    """Near and far codes, equal ones among them, below and above the size that is
    compared whole."""
    rng = np.random.default_rng(n + bits)
    right = rng.integers(0, 1 << (bits - 1), n).astype(np.uint64) * np.uint64(2)
    right[1::7] = right[: len(right[1::7])]
    left = np.concatenate([right[:60] ^ np.uint64(5), rng.integers(0, 1 << (bits - 1), 40).astype(np.uint64)])
    got = hamming.two_of(left, right)
    for code, two in zip(left, got, strict=True):
        every = sorted(int(d) << 32 | k for k, d in enumerate(np.bitwise_count(code ^ right)))[:2]
        assert [int(v) for v in two if v < np.iinfo(np.int64).max] == every


def test_codes_meet_in_slices(spark, monkeypatch):
    """Several slices of both sides, equal numbers on the left, NULLs; no cross join."""
    monkeypatch.setattr(hamming, "LEFT", 40)
    monkeypatch.setattr(hamming, "RIGHT", 30)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    a = spark.range(100).selectExpr("id % 90 AS i", "nullif(id * 2654435761 % 2147483648, 0) AS da")
    b = spark.range(200).selectExpr("nullif(id * 7, 14) AS j", "id * 40503 * 65537 % 2147483648 AS db")
    two = hamming.two_nearest(a, b, ("i", "da"), ("j", "db"))
    assert "CartesianProduct" not in (plan := two._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    want, others = {}, [r for r in b.collect() if r["j"] is not None]
    for r in a.collect():
        if r["da"] is not None:
            want.setdefault(r["i"], []).extend(((r["da"] ^ o["db"]).bit_count(), o["j"]) for o in others)
    near, got = {i: sorted(v)[:2] for i, v in want.items()}, sorted(map(tuple, two.collect()))
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == sorted((i, v[0][1], v[0][0], v[1][0]) for i, v in near.items())


@pytest.mark.parametrize("scale, shift", [(40, 0), (2000, 0), (1 << 22, 0), (300, 0.25)])
def test_nearest_are_taken_in_turn(scale, shift):
    """Against a loop over all pairs: ties, small, large and broken numbers."""
    rng = np.random.default_rng(scale)
    x, y, tx, ty = (rng.integers(0, scale, n) + shift for n in (300, 300, 200, 200))
    reach, free, want = scale / 6, set(range(200)), []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        far = min(((math.sqrt((tx[k] - a) ** 2 + (ty[k] - b) ** 2), k) for k in free), default=(reach, -1))
        want.append(far[1] if far[0] < reach else -1)
        free.discard(want[-1])
    assert M.take_nearest(x, y, tx, ty, reach) == want and -1 in want
    assert M.take_nearest(x[:2], y[:2], [], [], reach) == [-1, -1]


def test_tracks_by_pass_equal_those_by_row(spark, sf_dir):
    """Unknown kinds, passes without any known kind, passes cut by batches."""
    rows = machines.passes(spark, sf_dir).selectExpr("camera_id", "pass_no", "det_id", "if(det_id % 9 = 0 OR pass_no % 5 = 0, NULL, cls) AS cls", "confidence", "x", "y", "w", "h")
    want = sorted(map(str, A.batch(rows, A.TrackScan, ["pass_no", "det_id"], A.TRACKS).collect()))
    assert sorted(map(str, A.tracks(rows).collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    small = sorted(map(str, A.tracks(rows).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == want and any("departed" in r for r in want)


def test_crowded_passes_take_seconds():
    """Two passes of 6000 places: before, a minute of loops over pairs."""
    rng = np.random.default_rng(4)
    crowds = [[{"cls": "cat", "box": b, "confidence": 0.5} for b in rng.integers(1, 1000, (6000, 4)).tolist()] for _ in "ab"]
    tracker, began = M.Tracker(), time.perf_counter()
    for n, crowd_ in enumerate(crowds):
        out = tracker.observe(crowd_, n)
    assert time.perf_counter() - began < 6
    assert sum(t["state"] == "present" for t in out) > 5500 and len({t["id"] for t in out}) == len(out)


@pytest.mark.parametrize("name", ["tracker_full", "track_gate", "tracked_world"])
def test_tracker_queries_go_by_pass(spark, sf_dir, name):
    assert "track_passes" in plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_a_sighting_meets_the_sectors_of_its_cell_only(monkeypatch):
    """Of 1200 sectors; before, each sighting was held against all of them."""
    sectors = [{"id": k, "height": float(k % 7), "polygon": [(k % 40 * 60, k // 40 * 50), (k % 40 * 60 + 70, k // 40 * 50), (k % 40 * 60 + 70, k // 40 * 50 + 60), (k % 40 * 60, k // 40 * 50 + 60)]} for k in range(1200)]
    rng, all_of, met = np.random.default_rng(6), M.sector_at, []
    monkeypatch.setattr(M, "sector_at", lambda some, x, y: (met.append(len(some)), all_of(some, x, y))[1])
    world = M.WorldMap(sectors=sectors)
    for x, y in rng.uniform(-100, 2600, (500, 2)).round().tolist():
        thing, changed = world.observe(x, y, "cat", 0.5, 0)
        assert thing["sector"] == all_of(sectors, thing["x"], thing["y"])
    world.replace_sectors(sectors[::2])
    assert all(t["sector"] == all_of(sectors[::2], t["x"], t["y"]) for t in world.things)
    assert max(met) < 20 and len(met) > 500
