"""Rows in and out of the machines, for batch scans and for streams alike.

An adapter has ``update(row)`` and ``finish()`` that return rows to emit, and
``dump`` and ``load`` for a state store. A pass of the tracker is complete when a
row of a later pass arrives; in a stream the last pass waits in the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ordered_scan
from .machines import Accumulator, EntityStore, Tracker, WorldMap, take_nearest

TRACKS = "camera_id long, pass_no long, track_id long, cls string, confidence double, x int, y int, w int, h int, state string, misses int, evidence double, promoted boolean"
WORLD = "camera_id long, det_id long, thing_id string, kind string, x double, y double, sector_id int, seen long, changed boolean, revision long"
ENTITIES = "camera_id long, det_id long, entity_id long, n long, state string, kind string, machine_class string"
WINDOWS = "camera_id long, frame_id long, action string, mean array<double>"


class TrackScan:
    def __init__(self, **settings):
        self.tracker, self.pass_no, self.pending, self.camera = Tracker(**settings), None, [], None

    def update(self, row) -> list[tuple]:
        out = []
        if self.pass_no is not None and row.pass_no != self.pass_no:
            out = self.finish()
        self.camera, self.pass_no = int(row.camera_id), int(row.pass_no)
        if not pd.isna(row.cls):
            self.pending.append({"cls": row.cls, "confidence": float(row.confidence), "box": [int(row.x), int(row.y), int(row.w), int(row.h)]})
        return out

    def finish(self) -> list[tuple]:
        if self.pass_no is None:
            return []
        got = self.tracker.observe(self.pending, float(self.pass_no))
        self.pending = []
        return [(self.camera, self.pass_no, t["id"], t["cls"], t["confidence"], *t["box"], t["state"], t["misses"], round(t["evidence"], 9), t["promoted"]) for t in got]

    def dump(self) -> str:
        return json.dumps([self.tracker.dump(), self.pass_no, self.pending, self.camera])

    def load(self, text: str) -> None:
        tracker, self.pass_no, self.pending, self.camera = json.loads(text)
        self.tracker = Tracker.load(tracker)


class TrackTable:
    """The tracker over whole passes of one camera, with a column for each property
    of its tracks: rows come out as those of ``TrackScan``."""

    STATES = np.array(["new", "present", "missing", "departed"], object)

    def __init__(self, **settings):
        self.rule, self.classes, self.tracks = Tracker(**settings), {}, None

    def observe(self, rows: pd.DataFrame) -> pd.DataFrame:
        """``rows``: one pass of the camera, ordered by ``det_id``."""
        rule, camera, pass_no = self.rule, int(rows["camera_id"].iloc[0]), int(rows["pass_no"].iloc[0])
        rows = rows[rows["cls"].notna()]
        code, names = pd.factorize(rows["cls"])
        code = np.array([self.classes.setdefault(c, len(self.classes)) for c in names], int)[code]
        n, confidence = len(rows), rows["confidence"].to_numpy(float)
        seen = {"cls": code, "confidence": confidence, **{c: rows[c].to_numpy().astype("int64") for c in "xywh"}, "state": np.zeros(n, int), "misses": np.zeros(n, int), "evidence": confidence, "promoted": np.zeros(n, bool)}
        t = self.tracks or {"id": np.zeros(0, int), **{k: v[:0] for k, v in seen.items()}}
        taken = np.full(n, -1)
        for c in np.unique(code):
            own, others = np.flatnonzero(code == c), np.flatnonzero(t["cls"] == c)
            if len(others):
                found = np.array(take_nearest(*((v[a] + v[b] // 2)[k] for v, k in ((seen, own), (t, others)) for a, b in ("xw", "yh")), rule.reach + 1))
                taken[own[found >= 0]] = others[found[found >= 0]]
        born, again = np.flatnonzero(taken < 0), np.flatnonzero(taken >= 0)
        at, missed = taken[again], np.ones(len(t["id"]), bool)
        missed[at] = False
        for c in ("confidence", *"xywh"):
            t[c][at] = seen[c][again]
        t["evidence"] *= rule.decay
        t["evidence"][at] += confidence[again] * (1 + rule.foreground * 1.0 + rule.scene * 1.0)
        t["misses"] = np.where(missed, t["misses"] + 1, 0)
        t["state"] = np.where(~missed, 1, np.where(t["misses"] > rule.most_misses, 3, 2))
        t["promoted"] = t["evidence"] >= rule.threshold
        new = {"id": rule.next_id + np.arange(len(born)), **{k: v[born] for k, v in seen.items()}}
        rule.next_id += len(born)
        t = {k: np.concatenate([t[k], new[k]]) for k in t}
        self.tracks = {k: v[t["state"] < 3] for k, v in t.items()}
        kinds = np.array(list(self.classes), object)
        out = {"camera_id": camera, "pass_no": pass_no, "track_id": t["id"], "cls": kinds[t["cls"]], **{c: t[c] for c in ("confidence", *"xywh")}}
        return pd.DataFrame(out | {"state": self.STATES[t["state"]], "misses": t["misses"], "evidence": [round(v, 9) for v in t["evidence"].tolist()], "promoted": t["promoted"]})


def track_passes(batches: Iterator[pd.DataFrame], **settings) -> Iterator[pd.DataFrame]:
    """Frames sorted by camera, pass and detection through a ``TrackTable`` a camera;
    one pass is held at a time."""
    held, last, camera, table = [], None, None, None

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal camera, table
        if table is None or rows["camera_id"].iloc[0] != camera:
            camera, table = rows["camera_id"].iloc[0], TrackTable(**settings)
        return table.observe(rows)

    for b in batches:
        if not len(b):
            continue
        at = b[["camera_id", "pass_no"]].to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and tuple(at[i]) != last:
                out.append(whole(pd.concat(held)))
                held = []
            held.append(b[i:j])
            last = tuple(at[i])
        if out:
            yield pd.concat(out)
    if held:
        yield whole(pd.concat(held))


#: Partitions for keys that are few and each a long serial history: so many that two
#: seldom share one.
DEALT = 200


def tracks(df: DataFrame) -> DataFrame:
    """Passes through the tracker, one camera's in order; equal to ``batch`` with
    ``TrackScan``, a pass at a time instead of a row."""
    return df.repartition(DEALT, "camera_id").sortWithinPartitions("camera_id", "pass_no", "det_id").mapInPandas(track_passes, TRACKS)


class WorldScan:
    def __init__(self, sectors: list[dict]):
        self.world = WorldMap(sectors=sectors)

    def update(self, row) -> list[tuple]:
        thing, changed = self.world.observe(float(row.fx), float(row.fy), row.kind, float(row.confidence), pd.Timestamp(row.ts).timestamp())
        return [(int(row.camera_id), int(row.det_id), thing["id"], thing["kind"], thing["x"], thing["y"], thing["sector"], thing["seen"], changed, self.world.revision)]

    def finish(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return self.world.dump()

    def load(self, text: str) -> None:
        self.world = WorldMap.load(text)


class EntityScan:
    def __init__(self, **settings):
        self.store = EntityStore(**settings)

    def update(self, row) -> list[tuple]:
        klass = None if pd.isna(row.klass) else row.klass
        e = self.store.observe("image", (int(row.x), int(row.y), int(row.w), int(row.h)), pd.Timestamp(row.ts).timestamp(), float(row.objectness), klass, float(row.klass_confidence))
        return [(int(row.camera_id), int(row.det_id), e["id"], e["n"], e["state"], e["kind"], e["klass"])]

    def finish(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return self.store.dump()

    def load(self, text: str) -> None:
        self.store = EntityStore.load(text)


class WindowScan:
    def __init__(self, **settings):
        self.window = Accumulator(**settings)

    def update(self, row) -> list[tuple]:
        action, mean = self.window.tick(float(row.t), None if row.sample is None else [float(v) for v in row.sample])
        return [] if action == "wait" else [(int(row.camera_id), int(row.frame_id), action, mean)]

    def finish(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return self.window.dump()

    def load(self, text: str) -> None:
        self.window = Accumulator.load(text)


class MapProcessor(StatefulProcessor):
    """The map as a streaming operator whose state is one entry a grid cell.

    A sighting reads the cells that its radius touches and writes the cell of its
    thing, and the one that the thing left; other things stay in the state store,
    however many there are. Numbers of things made and of changes are an entry of
    their own. Rows come out as those of ``WorldScan``.
    """

    NUMBERS = "numbers"

    def __init__(self, sectors: list[dict], order: list[str], **settings):
        self.sectors, self.order, self.settings = sectors, order, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("cells", "cell STRING", "things STRING")

    def _read(self, name: str, default):
        return json.loads(self.kept.getValue((name,))[0]) if self.kept.containsKey((name,)) else default

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        world = WorldMap(sectors=self.sectors, **self.settings)
        world.made, world.revision, serial = self._read(self.NUMBERS, [0, 0, 0])
        cells: dict[str, list[dict]] = {}
        before: dict[str, str] = {}
        out = []
        for row in pd.concat(list(rows)).sort_values(self.order).itertuples(index=False):
            x, y = float(row.fx), float(row.fy)
            at = world.grid.cell_names(x - world.near, y - world.near, x + world.near, y + world.near)
            for name in at:
                if name not in cells:
                    cells[name] = self._read(name, [])
                    before[name] = json.dumps(cells[name])
            # Things nearby in the order in which they were made.
            world.things = sorted((t for name in at for t in cells[name]), key=lambda t: t["serial"])
            world._index()
            known = len(world.things)
            places = [world.grid.cell_name(t["x"], t["y"]) for t in world.things]
            thing, changed = world.observe(x, y, row.kind, float(row.confidence), pd.Timestamp(row.ts).timestamp())
            if len(world.things) > known:
                serial += 1
                thing["serial"] = serial
            else:
                cells[places[next(k for k, t in enumerate(world.things) if t is thing)]].remove(thing)
            cells[world.grid.cell_name(thing["x"], thing["y"])].append(thing)
            out.append((int(row.camera_id), int(row.det_id), thing["id"], thing["kind"], thing["x"], thing["y"], thing["sector"], thing["seen"], changed, world.revision))
        for name, things in cells.items():
            if (now := json.dumps(things)) != before[name]:
                self.kept.updateValue((name,), (now,))
        self.kept.updateValue((self.NUMBERS,), (json.dumps([world.made, world.revision, serial]),))
        yield pd.DataFrame.from_records(out, columns=[f.split()[0] for f in WORLD.split(", ")])

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def batch(df: DataFrame, adapter: Callable, order: list[str], schema: str, keys: tuple[str, ...] = ("camera_id",), dealt: int | None = None) -> DataFrame:
    """A bounded table through an adapter, one state a key."""
    return ordered_scan(df, list(keys), order, adapter, schema, dealt)


class Processor(StatefulProcessor):
    """The adapter as a streaming operator. A micro-batch's rows of a key are sorted
    before they are fed; rows that come later than newer ones are fed as they come."""

    def __init__(self, adapter: Callable, order: list[str], schema: str):
        self.adapter, self.order, self.names = adapter, order, [f.split()[0] for f in schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("machine", "state STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scan = self.adapter()
        if self.kept.exists():
            scan.load(self.kept.get()[0])
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values(self.order).itertuples(index=False):
            out += scan.update(row)
        self.kept.update((scan.dump(),))
        yield pd.DataFrame.from_records(out, columns=self.names)

    def close(self) -> None:
        pass


def stream(df: DataFrame, adapter: Callable, order: list[str], schema: str, keys: tuple[str, ...] = ("camera_id",)) -> DataFrame:
    """An unbounded table through an adapter; the state never expires. The session's
    state store must be RocksDB, which the operator needs."""
    return _with_state(df, keys, Processor(adapter, order, schema), schema)


def world_stream(df: DataFrame, sectors: list[dict], order: list[str], keys: tuple[str, ...] = ("camera_id", "kind"), **settings) -> DataFrame:
    """Sightings ``(camera_id, kind, det_id, ts, fx, fy, confidence)`` to the map, with
    state by grid cell."""
    return _with_state(df, keys, MapProcessor(sectors, order, **settings), WORLD)


def _with_state(df: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor, schema: str) -> DataFrame:
    if not df.sparkSession.conf.get(STATE_STORE, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {STATE_STORE} to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "None")
