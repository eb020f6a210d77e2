"""Geometry as column expressions: boxes, polygons, projective maps.

Boxes are columns ``x, y, w, h`` or structs of them, polygons arrays of structs
``(x, y)``. Missing knowledge is NULL: a point above the horizon has no place on
the floor.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]
HORIZON = 1e-9


def number(x: float) -> Column:
    return F.lit(float(x))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = (ax - bx).cast("double"), (ay - by).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def _corners(polygon: Column) -> Column:
    """Indices of the vertices, none for a polygon of fewer than three."""
    return F.when(F.size(polygon) >= 3, F.sequence(F.lit(0), F.size(polygon) - 1)).otherwise(F.array().cast("array<int>"))


def _vertex(polygon: Column, i: Column) -> Column:
    return F.get(polygon, F.pmod(i, F.size(polygon)))


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule with half-open edges, so a point on a shared edge is in one of
    two neighbours; fewer than three vertices: outside."""

    def crossed(i: Column) -> Column:
        a, b = _vertex(polygon, i), _vertex(polygon, i - 1)
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])
        return spans & F.coalesce(x < at, F.lit(False))

    return F.aggregate(_corners(polygon), F.lit(False), lambda odd, i: odd != crossed(i))


def area(polygon: Column) -> Column:
    """Shoelace area; fewer than three vertices: 0."""

    def cross(i: Column) -> Column:
        a, b = _vertex(polygon, i), _vertex(polygon, i + 1)
        return a["x"] * b["y"] - b["x"] * a["y"]

    return F.abs(F.aggregate(_corners(polygon), F.lit(0.0), lambda total, i: total + cross(i))) / 2


def convex(polygon: Column) -> Column:
    """All turns that aren't straight have one sign, and there is such a turn."""

    def turn(i: Column) -> Column:
        a, b, c = _vertex(polygon, i), _vertex(polygon, i + 1), _vertex(polygon, i + 2)
        return F.signum((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))

    return F.size(F.array_distinct(F.filter(F.transform(_corners(polygon), turn), lambda s: s != 0))) == 1


def box_polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def lower_edge(polygon: Column, keep: float = 0.35) -> Column:
    """Vertices in the lowest ``keep`` of the height, if three or more are."""
    ys = F.transform(polygon, lambda v: v["y"])
    bound = F.array_max(ys) - (F.array_max(ys) - F.array_min(ys)) * number(keep)
    low = F.filter(polygon, lambda v: v["y"] >= bound)
    return F.when(F.size(low) >= 3, low).otherwise(polygon)


def overlap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Area that two boxes share."""
    wide = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    high = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return (F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))).cast("double")


def box_area(w: Column, h: Column) -> Column:
    return (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("double")


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union; 0 where they share nothing."""
    shared = overlap(ax, ay, aw, ah, bx, by, bw, bh)
    union = box_area(aw, ah) + box_area(bw, bh) - shared
    return F.when((shared > 0) & (union > 0), F.try_divide(shared, union)).otherwise(number(0))


def depth(m: Matrix, x: Column, y: Column) -> Column:
    """The third homogeneous coordinate of a projected point."""
    return x * m[2][0] + y * m[2][1] + m[2][2]


def project(m: Matrix, x: Column, y: Column) -> Column:
    """The point under a 3x3 map; NULL where it has no finite image."""
    w = depth(m, x, y)
    return point(F.try_divide(x * m[0][0] + y * m[0][1] + m[0][2], w), F.try_divide(x * m[1][0] + y * m[1][1] + m[1][2], w))


def below_horizon(m: Matrix, sign: float, x: Column, y: Column) -> Column:
    return depth(m, x, y) * float(sign) > HORIZON


def raised(at: Column, height: Column, camera_height: float | None, camera: tuple[float, float] | None) -> Column:
    """A point seen on a surface ``height`` above the floor, moved towards the
    camera by (C - h) / C; unchanged at or above the camera or without one."""
    if not camera_height or camera is None:
        return at
    share = (number(camera_height) - height) / number(camera_height)
    cx, cy = number(camera[0]), number(camera[1])
    moved = point(cx + (at["x"] - cx) * share, cy + (at["y"] - cy) * share)
    return F.when(height.isNull() | (height <= 0) | (height >= camera_height), at).otherwise(moved)


def contact(m: Matrix, sign: float, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Where the middle of a box's lower side touches the floor; NULL above the horizon."""
    px, py = x + w / number(2), (y + h).cast("double")
    return F.when(below_horizon(m, sign, px, py), project(m, px, py))


def warp_box(m: Matrix, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Box around the four projected corners, rounded half to even."""
    ends = [project(m, a.cast("double"), b.cast("double")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    x0, x1 = (f(*[e["x"] for e in ends]) for f in (F.least, F.greatest))
    y0, y1 = (f(*[e["y"] for e in ends]) for f in (F.least, F.greatest))
    return F.struct(*[F.bround(v, 0).cast("int").alias(n) for n, v in (("x", x0), ("y", y0), ("w", x1 - x0), ("h", y1 - y0))])


def solve(image: Sequence[tuple[float, float]], plan: Sequence[tuple[float, float]]) -> np.ndarray:
    """The map that takes image points to plan points: exact for four, least
    squares (after rescaling) for more. Fewer or unequal numbers: ValueError."""
    if len(image) < 4 or len(image) != len(plan):
        raise ValueError("needs as many image points as plan points, four at least")

    def scaled(points):
        p = np.asarray(points, float)
        mid = p.mean(axis=0)
        s = np.sqrt(2) / max(np.sqrt(((p - mid) ** 2).sum(axis=1)).mean(), 1e-12)
        t = np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])
        return (p - mid) * s, t

    (a, ta), (b, tb) = scaled(image), scaled(plan)
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def solve_robust(image, plan, within: float = 5.0, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """RANSAC (Fischler and Bolles) with a fixed seed: the map and the inliers."""
    src, dst = np.asarray(image, float), np.asarray(plan, float)
    if len(src) == 4:
        return solve(src, dst), np.ones(4, bool)
    random, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    for _ in range(rounds):
        pick = random.choice(len(src), 4, replace=False)
        try:
            near = errors(solve(src[pick], dst[pick]), src, dst) <= within
        except np.linalg.LinAlgError:
            continue
        if near.sum() > best.sum():
            best = near
    return (solve(src[best], dst[best]) if best.sum() >= 4 else solve(src, dst)), best


def errors(m: np.ndarray, src, dst) -> np.ndarray:
    p = np.c_[np.asarray(src, float), np.ones(len(src))] @ np.asarray(m).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(((p[:, :2] / p[:, 2:] - np.asarray(dst, float)) ** 2).sum(axis=1)), nan=np.inf)


def depth_sign(m: np.ndarray, image) -> float:
    """Sign of the mean depth over the calibration points; 0 counts as plus."""
    w = np.c_[np.asarray(image, float), np.ones(len(image))] @ np.asarray(m)[2]
    return -1.0 if w.mean() < 0 else 1.0


def register_sql(spark) -> None:
    """SQL functions of the same meaning, for queries written in SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION box_iou(ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by DOUBLE, bw DOUBLE, bh DOUBLE) RETURNS DOUBLE RETURN CASE WHEN least(ax+aw, bx+bw) > greatest(ax, bx) AND least(ay+ah, by+bh) > greatest(ay, by) THEN (least(ax+aw, bx+bw) - greatest(ax, bx)) * (least(ay+ah, by+bh) - greatest(ay, by)) / (greatest(aw,0)*greatest(ah,0) + greatest(bw,0)*greatest(bh,0) - (least(ax+aw, bx+bw) - greatest(ax, bx)) * (least(ay+ah, by+bh) - greatest(ay, by))) ELSE 0.0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION point_distance(ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE) RETURNS DOUBLE RETURN sqrt((ax-bx)*(ax-bx) + (ay-by)*(ay-by))")
