"""Queries without SQL against plain loops over the rows that the tables have."""

import math

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from sightline import plans
from sightline.functions import kernels as K
from sightline.plans import floor, imaging, machines
from sightline.sources import views as V


def rows(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    return sorted((tuple(r) for r in df.collect()), key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def luma(sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    out = {}
    for i, v in zip(t["vec_id"], t["embedding"], strict=True):
        out[i] = np.clip(np.floor((np.array(v, np.float32).astype(float) + 0.6) * 212 + 0.5), 0, 255).reshape(-1, 8)
    return dict(sorted(out.items()))


def before(frames):
    """Each frame's number, the frame before it of its camera, and itself."""
    last = {}
    for i, v in frames.items():
        if i % 2 in last:
            yield i, last[i % 2], v
        last[i % 2] = v


@pytest.mark.parametrize("name", sorted(imaging.FILTERS))
def test_filters(spark, sf_dir, name):
    out = {i: imaging.FILTERS[name](v) for i, v in luma(sf_dir).items()}
    close(rows(spark, sf_dir, f"kernel_{name}"), [(i, round(float(o.mean()), 6), round(float(o.min()), 6), round(float(o.max()), 6)) for i, o in out.items()])


def test_blur_and_laplacian_by_loops(spark, sf_dir):
    """The two kernels that others build on, pixel by pixel."""
    got = {r[0]: r for r in rows(spark, sf_dir, "kernel_laplacian")}
    for i, v in list(luma(sf_dir).items())[:20]:
        h, w = v.shape
        at = lambda y, x: v[-y if y < 0 else 2 * h - 2 - y if y >= h else y, -x if x < 0 else 2 * w - 2 - x if x >= w else x]  # noqa: B023, E731
        edge = lambda y, x: v[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]  # noqa: B023, E731
        each = [[[f(y - 1, x) + f(y + 1, x) + f(y, x - 1) + f(y, x + 1) - 4 * v[y, x] for y in range(h) for x in range(w)] for f in (at, edge)]]
        assert any(got[i][2] == pytest.approx(min(o)) and got[i][3] == pytest.approx(max(o)) for o in each[0])


def test_mixture(spark, sf_dir):
    models, want = {}, []
    for i, v in luma(sf_dir).items():
        want.append((i, round(float(models.setdefault(i % 2, K.Mixture((8, 8))).apply(v).mean()), 6)))
    close(rows(spark, sf_dir, "kernel_mixture"), want)


def test_flow(spark, sf_dir):
    want = []
    for i, a, b in before(luma(sf_dir)):
        far = np.hypot(*np.moveaxis(K.flow(a, b), -1, 0))
        want.append((i, round(float(far.mean()), 4), int((far > 1.5).sum())))
    close(rows(spark, sf_dir, "kernel_flow"), want)


def test_keypoints_and_acuity(spark, sf_dir):
    found = {i: K.keypoints(v, patch=2) for i, v in luma(sf_dir).items()}
    close(rows(spark, sf_dir, "kernel_keypoints"), [(i, len(p), d[0].tobytes().hex() if len(d) else "") for i, (p, d) in found.items()])
    for i, sigma in rows(spark, sf_dir, "acuity_match")[:10]:
        v = luma(sf_dir)[i]
        aim = K.laplacian(v).var() / 2
        assert sigma >= 0 and abs(K.laplacian(K.gaussian(v, sigma)).var() - aim) <= 0.2 * aim


@pytest.fixture(scope="module")
def detections(sf_dir):
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    got = db.sql(f"WITH {V.DETECTIONS} SELECT det_id, camera_id, user_id, cls, confidence, evidence, x, y, w, h, epoch(ts) AS t, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS pass_no, date_trunc('day', ts) AS day FROM detections ORDER BY t, det_id")
    names = got.columns
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def shared(a, b):
    wide, high = (min(a[k] + a[s], b[k] + b[s]) - max(a[k], b[k]) for k, s in (("x", "w"), ("y", "h")))
    both = max(0, wide) * max(0, high)
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both)


def test_greedy_suppression(spark, sf_dir, detections):
    want, groups = [], {}
    for d in detections:
        groups.setdefault((d["user_id"], d["day"]), []).append(d)
    for group in groups.values():
        kept = []
        for d in sorted(group, key=lambda d: (-d["confidence"], d["det_id"])):
            if all(shared(d, k) <= 0.45 for k in kept):
                kept.append(d)
        want += [(d["det_id"], n + 1) for n, d in enumerate(kept)]
    close(rows(spark, sf_dir, "greedy_suppression"), want)


def slow_tracks(detections):
    """State of all tracks after each pass of a camera, every pair measured."""
    out = []
    for camera in sorted({d["camera_id"] for d in detections}):
        own, tracks, made = [d for d in detections if d["camera_id"] == camera], [], 0
        for number in sorted({d["pass_no"] for d in own}):
            free, born = set(range(len(tracks))), []
            for d in sorted((d for d in own if d["pass_no"] == number), key=lambda d: d["det_id"]):
                at = d["x"] + d["w"] // 2, d["y"] + d["h"] // 2
                far = [(math.dist(at, (tracks[k]["x"] + tracks[k]["w"] // 2, tracks[k]["y"] + tracks[k]["h"] // 2)), k) for k in free if tracks[k]["cls"] == d["cls"]]
                box = {k: d[k] for k in ("cls", "confidence", "x", "y", "w", "h")}
                if far and min(far)[0] < 181:
                    k = min(far)[1]
                    free.discard(k)
                    e = tracks[k]["evidence"] * 0.85 + d["confidence"]
                    tracks[k] |= box | {"evidence": e, "misses": 0, "state": "present", "promoted": e >= 0.35}
                else:
                    made += 1
                    born.append(box | {"id": made, "evidence": d["confidence"], "misses": 0, "state": "new", "promoted": False})
            for k in free:
                t = tracks[k]
                e = t["evidence"] * 0.85
                t |= {"evidence": e, "misses": t["misses"] + 1, "state": "departed" if t["misses"] >= 5 else "missing", "promoted": e >= 0.35}
            tracks += born
            out += [(camera, number, t["id"], t["cls"], t["confidence"], t["x"], t["y"], t["w"], t["h"], t["state"], t["misses"], round(t["evidence"], 9), t["promoted"]) for t in tracks]
            tracks = [t for t in tracks if t["state"] != "departed"]
    return out


def test_tracker_and_gate(spark, sf_dir, detections):
    want = slow_tracks(detections)
    close(rows(spark, sf_dir, "tracker_full"), want)
    gate = {}
    for camera, _, _, _, confidence, _, y, _, h, state, _, evidence, _ in want:
        n = gate.setdefault(camera, [0] * 5)
        weight = (-0.006470588235294124 * (y + h) + 1) * -1
        if state == "departed":
            n[0] += 1
        elif evidence < 0.30:
            n[1] += 1
        elif weight <= 1e-9:
            n[2] += 1
        else:
            n[3] += 1
            n[4] += confidence < 0.25
    close(rows(spark, sf_dir, "track_gate"), [(c, *n) for c, n in gate.items()])
    assert sum(n[0] for n in gate.values()) > 0


def slow_map(seen, sectors):
    """``seen``: dicts in order; every thing measured against every sighting."""
    made, out, things, revision = {}, [], {}, {}
    for s in seen:
        key = s["camera_id"], s["kind"]
        own = things.setdefault(key, [])
        far = [(math.dist((s["fx"], s["fy"]), (t["x"], t["y"])), n) for n, t in enumerate(own)]
        near = min(far, default=(60.0, 0))
        holds = [x for x in sectors if x["x0"] <= s["fx"] < x["x0"] + 70 and x["y0"] <= s["fy"] < x["y0"] + 60]
        sector = max(holds, key=lambda x: (x["height"], -x["id"]))["id"] if holds else None
        if near[0] < 60:
            t = own[near[1]]
            t["seen"] += 1
            changed = near[0] > 8
            if changed:
                t |= {"x": s["fx"], "y": s["fy"], "sector": sector}
        else:
            made[key] = made.get(key, 0) + 1
            t, changed = {"id": f"{s['kind']}-{made[key]}", "x": s["fx"], "y": s["fy"], "sector": sector, "seen": 1}, True
            own.append(t)
        revision[key] = revision.get(key, 0) + changed
        out.append((s["camera_id"], s["det_id"], t["id"], s["kind"], t["x"], t["y"], t["sector"], t["seen"], changed, revision[key]))
    return out


@pytest.fixture(scope="module")
def sectors(sf_dir):
    n = pq.read_table(f"{sf_dir}/nation.parquet", columns=["n_nationkey", "n_regionkey"]).to_pylist()
    return [{"id": r["n_nationkey"], "x0": r["n_nationkey"] % 5 * 60, "y0": r["n_nationkey"] // 5 * 50, "height": r["n_regionkey"] * 15} for r in n]


def test_world_map_and_log(spark, sf_dir, sectors):
    seen = [r.asDict() for r in floor.observed(spark, sf_dir).orderBy("ts", "det_id").collect()]
    want = slow_map(seen, sectors)
    close(rows(spark, sf_dir, "world_map_full"), want)
    count, log = {}, []
    for camera, det, thing, kind, _, _, sector, _, changed, _ in sorted(want, key=lambda r: r[1]):
        if changed:
            count[camera] = count.get(camera, 0) + 1
            log.append((camera, det, thing, kind, sector, count[camera]))
    close(rows(spark, sf_dir, "world_log"), log)


def test_tracked_world(spark, sf_dir, sectors, detections):
    """From tracker to map: what tracks of a pass put on the plan, departed and
    missing ones not."""
    placed = [r.asDict() for r in machines.tracked(spark, sf_dir).orderBy("pass_no", "det_id").collect()]
    tracks = [t for t in slow_tracks(detections) if t[9] in ("new", "present") and t[11] >= 0.30 and (-0.006470588235294124 * (t[6] + t[8]) + 1) * -1 > 1e-9]
    assert sorted((r["camera_id"], r["pass_no"], r["track_id"]) for r in placed) == sorted(t[:3] for t in tracks)
    things = {}
    for camera, det, thing, kind, _, _, sector, seen, changed, _ in slow_map(placed, sectors):
        t = things.setdefault((camera, thing, kind), [0, 0, None])
        t[0], t[1], t[2] = max(t[0], seen), t[1] + changed, sector
    close(rows(spark, sf_dir, "tracked_world"), [(*k, *v) for k, v in things.items()])


def test_entity_store(spark, sf_dir, detections):
    want, stores = [], {}
    for d in detections:
        own = stores.setdefault(d["camera_id"], [])
        share = [(shared(e["box"], d), -n) for n, e in enumerate(own)]
        best = max(share, default=(0.0, 0))
        if best[0] >= 0.30 and best[0] > 0:
            e = own[-best[1]]
        else:
            own.append(e := {"id": len(own) + 1, "all": [], "klass": None, "sure": 0.0, "last": 0.0, "first": d["t"]})
        e["box"], e["last"] = d, max(e["last"], d["t"])
        e["all"].append((d["x"] + d["w"] / 2, d["y"] + d["h"] / 2))
        sure = d["confidence"] if d["confidence"] >= 0.25 else 0.0
        if sure > e["sure"]:
            e["klass"], e["sure"] = d["cls"], sure
        n = len(e["all"])
        state = "persistent" if n >= 50 and e["last"] - e["first"] >= 600 else "recurring" if n >= 5 else "transient"
        if n >= 5:
            spread = [round(math.sqrt(max(0.0, sum(v * v for v in c) / n - (sum(c) / n) ** 2)), 1) for c in zip(*e["all"], strict=True)]
            e["kind"] = "static" if math.hypot(*spread) <= 12 else "object"
        want.append((d["camera_id"], d["det_id"], e["id"], n, state, e.get("kind", "unknown"), e["klass"]))
    close(rows(spark, sf_dir, "entity_store_full"), want)


def test_accumulation_windows(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    state, want = {}, []
    for i, v in sorted(zip(t["vec_id"], t["embedding"], strict=True)):
        now, crop = i / 8, np.floor((np.array(v, np.float32).astype(float) + 0.6) * 2) if i % 9 else None
        s = state.setdefault(i % 2, {"done": -1e9, "since": None, "kept": []})
        due = now - s["done"] >= 1 / 1.5
        if crop is None:
            s |= {"since": None, "kept": []}
            if due:
                s["done"] = now
                want.append((i % 2, i, "full", None))
            continue
        if s["since"] is None and not due:
            continue
        if s["since"] is None:
            s |= {"since": now, "kept": []}
        if not s["kept"] or np.abs(crop - s["kept"][-1]).mean() <= 6:
            s["kept"].append(crop)
        if len(s["kept"]) == 4 or now - s["since"] >= 2 / 1.5:
            want.append((i % 2, i, "crop", [float(x) for x in np.trunc(np.mean(s["kept"], axis=0))]))
            s |= {"since": None, "kept": [], "done": now}
    got = [(*r[:3], list(r[3]) if r[3] is not None else None) for r in rows(spark, sf_dir, "accumulation_windows")]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", ["motion_detector", "floor_by_stability", "propose_world", "artifact_marks"])
def test_the_rest_returns_rows_that_repeat(spark, sf_dir, name):
    """Their kernels and parts have tests of their own."""
    got = rows(spark, sf_dir, name)
    assert got and got == rows(spark, sf_dir, name)
