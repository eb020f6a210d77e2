"""Goldens and properties of the geometry."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.streaming import machines as M

# A calibrated quadrilateral and its floor plan.
IMAGE = [(240, 700), (1040, 700), (820, 400), (460, 400)]
PLAN = [(0, 0), (300, 0), (300, 250), (0, 250)]
COUCH = [(60, 90), (230, 90), (230, 190), (60, 190)]


@pytest.fixture(scope="module")
def floor():
    m = G.solve(IMAGE, PLAN)
    return m, G.depth_sign(m, IMAGE)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def num(x):
    return F.lit(float(x))


def poly(points):
    return F.array(*[G.point(num(x), num(y)) for x, y in points])


def test_solve_is_exact_and_signed(floor):
    m, sign = floor
    assert G.errors(m, IMAGE, PLAN).max() < 1e-6
    assert sign == -1.0
    with pytest.raises(ValueError):
        G.solve(IMAGE[:3], PLAN[:3])
    with pytest.raises(ValueError):
        G.solve(IMAGE, PLAN[:3])


def test_robust_fit_leaves_outliers_out(floor):
    rng = np.random.default_rng(0)
    src = rng.uniform([240, 400], [1040, 700], (60, 2))
    p = np.c_[src, np.ones(60)] @ floor[0].T
    dst = p[:, :2] / p[:, 2:]
    dst[:15] += rng.uniform(80, 200, (15, 2))
    m, near = G.solve_robust(src, dst)
    assert not near[:15].any() and near[15:].all()
    assert np.allclose(m, floor[0], atol=1e-3 * np.abs(floor[0]).max())


def test_projection_goes_there_and_back(spark, floor):
    m = floor[0].tolist()
    back = np.linalg.inv(floor[0]).tolist()
    for (x, y), (u, v) in zip(IMAGE, PLAN, strict=True):
        there = G.project(m, num(x), num(y))
        again = G.project(back, there["x"], there["y"])
        got = one(spark, there, again)
        assert got["c0"]["x"] == pytest.approx(u, abs=1e-3) and got["c0"]["y"] == pytest.approx(v, abs=1e-3)
        assert got["c1"]["x"] == pytest.approx(x, abs=1e-3) and got["c1"]["y"] == pytest.approx(y, abs=1e-3)


def test_contact_above_the_horizon_is_unknown(spark, floor):
    m, sign = floor
    box = lambda *b: [F.lit(v) for v in b]
    got = one(spark, G.contact(m.tolist(), sign, *box(600, 100, 40, 40)), G.contact(m.tolist(), sign, *box(600, 690, 60, 30)))
    assert got["c0"] is None and got["c1"] is not None


def test_raised_contact_is_nearer_by_the_height(spark, floor):
    m, sign = floor
    flat = G.contact(m.tolist(), sign, F.lit(600), F.lit(690), F.lit(60), F.lit(30))
    up = G.raised(flat, num(40), 75.0, (150.0, -60.0))
    got = one(spark, flat, up, G.raised(flat, num(40), 75.0, None), G.raised(flat, num(75), 75.0, (150.0, -60.0)))
    far = [np.hypot(got[c]["x"] - 150, got[c]["y"] + 60) for c in ("c0", "c1")]
    assert far[1] / far[0] == pytest.approx(35 / 75, abs=1e-6)
    assert got["c2"] == got["c0"] == got["c3"]


def test_polygons(spark):
    got = one(spark, G.area(poly(COUCH)), G.convex(poly(COUCH)), G.convex(poly([(0, 0), (4, 0), (1, 1), (0, 4)])), G.area(poly(COUCH[:2])), G.convex(poly([(0, 0), (1, 1), (2, 2)])), F.size(G.lower_edge(poly([(0, 0), (9, 0), (9, 10), (5, 9), (0, 10)]))))
    assert list(got) == [17000.0, True, False, 0.0, False, 3]


def test_inside_equals_the_plain_rule(spark):
    rng = random.Random(1)
    cases = [([(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 7))], rng.randint(0, 9), rng.randint(0, 9)) for _ in range(150)]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p], float(a), float(b)) for i, (p, a, b) in enumerate(cases)], "i int, polygon array<struct<x double, y double>>, x double, y double")
    got = {r["i"]: r["in"] for r in df.select("i", G.inside(F.col("x"), F.col("y"), F.col("polygon")).alias("in")).collect()}
    assert got == {i: M.inside(a, b, p) for i, (p, a, b) in enumerate(cases)}


def test_shared_edges_belong_to_one_polygon(spark):
    left, right = [(0, 0), (5, 0), (5, 5), (0, 5)], [(5, 0), (9, 0), (9, 5), (5, 5)]
    got = one(spark, G.inside(num(5), num(2), poly(left)), G.inside(num(5), num(2), poly(right)))
    assert sorted(got) == [False, True]


def test_iou_is_symmetric_and_bounded(spark):
    rng = random.Random(2)
    rows = [tuple(rng.randint(0, 20) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int, g int, h int")
    cols = [F.col(c) for c in "abcdefgh"]
    for r in df.select(*cols, G.iou(*cols).alias("there"), G.iou(*cols[4:], *cols[:4]).alias("back")).collect():
        assert r["there"] == pytest.approx(r["back"]) and 0 <= r["there"] <= 1
        assert r["there"] == pytest.approx(M.box_iou(r[:4], r[4:8]))


def test_sql_functions(spark):
    G.register_sql(spark)
    got = spark.sql("SELECT box_iou(0, 0, 2, 2, 1, 1, 2, 2) AS a, point_distance(0, 0, 3, 4) AS b").first()
    assert got["a"] == pytest.approx(1 / 7) and got["b"] == 5.0
