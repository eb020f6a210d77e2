"""Spatial joins as equi-joins on grid cells, whatever the size of either side.

Each box goes to the cells that it touches and each point to its own cell; rows
that share a cell are compared exactly. Nothing is broadcast by hint: the engine
does so where statistics show a small side, and else shuffles on the cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def _span(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def to_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> DataFrame:
    """A row for each cell that the rectangle touches; NULL bounds: none."""
    known = df.where(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull() & (x1 >= x0) & (y1 >= y0))
    return known.withColumn("_cx", F.explode(_span(x0, x1, cell))).withColumn("_cy", F.explode(_span(y0, y1, cell)))


def at_cell(df: DataFrame, x: Column, y: Column, cell: float) -> DataFrame:
    """The cell of each point; NULL places: none."""
    return df.where(x.isNotNull() & y.isNotNull()).withColumns({"_cx": F.floor(x / cell), "_cy": F.floor(y / cell)})


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, polygon: str = "polygon", cell: float = 50.0) -> DataFrame:
    """Inner join of points and the polygons that hold them; a pair once."""
    xs, ys = F.transform(polygon, lambda v: v["x"]), F.transform(polygon, lambda v: v["y"])
    bounds = polygons.withColumns({"_x0": F.array_min(xs), "_y0": F.array_min(ys), "_x1": F.array_max(xs), "_y1": F.array_max(ys)})
    cells = to_cells(bounds, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), cell)
    near = at_cell(points, F.col(x), F.col(y), cell).join(cells, ["_cx", "_cy"])
    # The bounds are compiled code; the polygon's rule runs for what is left.
    within = F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1"))
    return near.where(within & G.inside(F.col(x), F.col(y), F.col(polygon))).drop("_cx", "_cy", "_x0", "_y0", "_x1", "_y1")


def with_sector(points: DataFrame, sectors: DataFrame, x: str, y: str, cell: float = 50.0) -> DataFrame:
    """``points`` with ``sector_id`` and ``floor_height`` of the highest sector that
    holds the point, of equal ones the first; both null where none does.

    A cell has an array of the few sectors that touch it, so that each point meets
    one row: one equi-join, and neither an aggregate nor a join back.
    """
    xs, ys = F.transform("polygon", lambda v: v["x"]), F.transform("polygon", lambda v: v["y"])
    bounds = sectors.select("sector_id", "floor_height", "polygon", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    cells = to_cells(bounds, *map(F.col, ("x0", "y0", "x1", "y1")), cell)
    listed = F.struct("floor_height", (-F.col("sector_id")).alias("turn"), "sector_id", "polygon", "x0", "y0", "x1", "y1")
    by_cell = cells.groupBy("_cx", "_cy").agg(F.collect_list(listed).alias("_near"))
    px, py = F.col(x), F.col(y)
    # The bounds go before the polygon's rule, which takes longer.
    held = F.filter("_near", lambda s: px.between(s["x0"], s["x1"]) & py.between(s["y0"], s["y1"]) & G.inside(px, py, s["polygon"]))
    best = F.array_max(F.transform(held, lambda s: F.struct(s["floor_height"].alias("floor_height"), s["turn"].alias("turn"), s["sector_id"].alias("sector_id"))))
    met = points.withColumns({"_cx": F.floor(px / cell), "_cy": F.floor(py / cell)}).join(by_cell, ["_cx", "_cy"], "left").withColumn("_s", best)
    return met.select(*[F.col(c) for c in points.columns], "_s.sector_id", "_s.floor_height")


def highest_sector(points: DataFrame, sectors: DataFrame, key: str, x: str, y: str, cell: float = 50.0) -> DataFrame:
    """``(key, sector_id, floor_height)`` of the points that some sector holds."""
    return with_sector(points.select(key, x, y), sectors, x, y, cell).where("sector_id IS NOT NULL").select(key, "sector_id", "floor_height")


def overlapping(left: DataFrame, right: DataFrame, a: tuple[str, str, str, str], b: tuple[str, str, str, str], on: list[str] | None = None, cell: float = 200.0) -> DataFrame:
    """Inner join of boxes that share some area, equal in the columns ``on``; a
    pair once: it is kept in the first cell that both touch."""
    ax, ay, aw, ah = map(F.col, a)
    bx, by, bw, bh = map(F.col, b)
    l = to_cells(left, ax, ay, ax + aw, ay + ah, cell)
    r = to_cells(right, bx, by, bx + bw, by + bh, cell)
    first = (F.col("_cx") == F.greatest(F.floor(ax / cell), F.floor(bx / cell))) & (F.col("_cy") == F.greatest(F.floor(ay / cell), F.floor(by / cell)))
    return l.join(r, [*(on or []), "_cx", "_cy"]).where(first & (G.overlap(ax, ay, aw, ah, bx, by, bw, bh) > 0)).drop("_cx", "_cy")


#: Places in a cell beyond which a narrower radius is searched first.
CROWD = 16


def _nearest(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``a`` the index of the nearest of ``b`` closer than
    ``radius``, of equal distances the least index, else -1; and the distance.

    Narrow radii come first, so that crowded places meet few others; what they leave
    open is measured again with wider ones.
    """
    at, far = np.full(len(a), -1), np.full(len(a), np.inf)
    low = np.floor(np.minimum(a.min(axis=0), b.min(axis=0)) - radius)
    reach = radius
    while reach > radius / 1024 and np.unique(np.floor((b - low) / reach), axis=0, return_counts=True)[1].max() > CROWD:
        reach /= 4
    open_ = np.arange(len(a))
    while len(open_):
        reach = min(reach, radius)
        cb = np.floor((b - low) / reach).astype(np.int64)
        width = int(max(cb[:, 1].max(), ((a[open_, 1] - low[1]) / reach).max())) + 3
        name = cb[:, 0] * width + cb[:, 1]
        by = np.argsort(name, kind="stable")
        name = name[by]
        for part in np.array_split(open_, max(1, len(open_) // 4096)):
            ca = np.floor((a[part] - low) / reach).astype(np.int64)
            for dx in (-1, 0, 1):
                row = (ca[:, 0] + dx) * width + ca[:, 1]
                lo, hi = np.searchsorted(name, row - 1), np.searchsorted(name, row + 1, side="right")
                for some in _runs(hi - lo):
                    n, first = (hi - lo)[some], lo[some]
                    own = np.repeat(np.arange(len(n)), n)
                    k = by[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
                    d = np.sqrt(((a[part[some]][own] - b[k]) ** 2).sum(axis=1))
                    start = (np.cumsum(n) - n)[n > 0]
                    if not len(start):
                        continue
                    mine = part[some][n > 0]
                    least = np.minimum.reduceat(d, start)
                    one = np.minimum.reduceat(np.where(d == np.repeat(least, n[n > 0]), k, len(b)), start)
                    better = (least < far[mine]) | ((least == far[mine]) & (one < at[mine]))
                    far[mine[better]], at[mine[better]] = least[better], one[better]
        # Nearest for certain: closer than the radius that was searched whole.
        if reach >= radius:
            break
        open_ = open_[far[open_] >= reach]
        reach *= 4
    at[far >= radius] = -1
    return at, far


def _runs(n: np.ndarray, most: int = 1 << 20):
    """Slices of consecutive rows whose counts sum to about ``most`` at the most."""
    part = (np.cumsum(n) - n) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
    return [slice(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


def nearest_within(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], radius: float, on: list[str], order: str) -> DataFrame:
    """For each left row the nearest right row with equal ``on`` closer than
    ``radius``; of equal distances the least ``order``. Rows without one are absent.

    Places are dealt to square tiles, the right ones also to tiles that they are
    within ``radius`` of; no pair is a row. Of right rows at one place, the least
    ``order`` stands for all.
    """
    ax, ay, bx, by = F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])
    side = 4.0 * radius
    rest = [c for c in right.columns if c not in (*on, *b, order)]
    # NULLs of ``on`` are equal to nothing, as in a join.
    known = right.dropna(subset=[*on, *b, order]).groupBy(*on, *b)
    places = known.agg(F.min(F.struct(order, *rest)).alias("_r")).select(*on, *b, "_r.*") if rest else known.agg(F.min(order).alias(order))
    r = to_cells(places, bx - radius, by - radius, bx + radius, by + radius, side)
    l = at_cell(left.select(key, *on, *a).dropna(subset=[key, *on]), ax, ay, side)
    names = [key, *[c for c in right.columns if c not in on], "distance"]
    types = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]} | {"distance": "double"}

    def meet(those: pd.DataFrame, things: pd.DataFrame) -> pd.DataFrame:
        if not len(those) or not len(things):
            return pd.DataFrame({c: [] for c in names})
        things = things.sort_values(order, ignore_index=True)
        at, far = _nearest(those[list(a)].to_numpy(float), things[list(b)].to_numpy(float), radius)
        found = at >= 0
        out = things.iloc[at[found]].reset_index(drop=True)
        out[key], out["distance"] = those[key].to_numpy()[found], far[found]
        return out[names]

    met = l.groupBy(*on, "_cx", "_cy").cogroup(r.groupBy(*on, "_cx", "_cy")).applyInPandas(meet, ", ".join(f"`{c}` {types[c]}" for c in names))
    chosen = F.struct(*names[1:])
    return met.groupBy(key).agg(F.min_by(chosen, F.struct("distance", order)).alias("_n")).select(key, "_n.*")
