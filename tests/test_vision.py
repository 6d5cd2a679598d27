"""Robust fits and hulls against planted truths and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickframe.operators import homography, hulls

MATRICES = {"a": [1.02, 0.05, 12.0, -0.03, 0.97, 4.0, 1e-4, -5e-5, 1.0], "b": [0.4, -0.9, 700.0, 0.8, 0.5, -80.0, -2e-4, 1e-4, 1.0], None: [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]}


def image(h, x, y):
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def planted(n, wrong, noise=0.0, seed=1):
    rnd = random.Random(seed)
    rows = []
    for key, h in MATRICES.items():
        for i in range(n):
            x, y = rnd.uniform(0, 960), rnd.uniform(0, 540)
            u, v = image(h, x, y)
            if rnd.random() < wrong:
                u, v = u + rnd.choice([-1, 1]) * rnd.uniform(30, 400), v + rnd.uniform(30, 300)
            rows.append((key, i, x, y, u + rnd.gauss(0, noise), v + rnd.gauss(0, noise)))
    return rows


DDL = "k string, id int, x double, y double, u double, v double"


def test_planted_matrices_are_recovered_among_wrong_points(spark):
    rows = planted(400, 0.3) + [("a", 900 + i, None, 1.0, 1.0, 1.0) for i in range(5)]
    found = {r["k"]: r for r in homography.fit(spark.createDataFrame(rows, DDL).repartition(5), ["k"], "id").collect()}
    assert set(found) == {"a", "b"}
    for key, row in found.items():
        own = [r for r in rows if r[0] == key and r[2] is not None]
        good = sum(math.dist(image(MATRICES[key], r[2], r[3]), r[4:]) < 5 for r in own)
        assert (row["n"], row["inliers"]) == (400, good)
        assert np.allclose(row["h"], MATRICES[key], rtol=1e-6, atol=1e-9)


def test_noise_is_averaged_out(spark):
    rows = planted(2000, 0.3, noise=1.0)
    for row in homography.fit(spark.createDataFrame(rows, DDL), ["k"], "id").collect():
        for x, y in ((100, 100), (800, 100), (480, 400)):
            assert math.dist(image(row["h"], x, y), image(MATRICES[row["k"]], x, y)) < 0.5


def test_too_few_points_and_points_on_a_line_have_no_matrix(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    rows = [("three", i, float(x), float(y), float(x), float(y)) for i, (x, y) in enumerate(square[:3])]
    rows += [("line", i, float(i), 2.0 * i, float(i), 1.0) for i in range(9)]
    rows += [("same", i, 1.0, 1.0, 2.0, 2.0) for i in range(9)]
    rows += [("four", i, float(x), float(y), 2.0 * x + 1, float(y)) for i, (x, y) in enumerate(square)]
    rows += [("none", 1, None, None, None, None)]
    found = {r["k"]: (r["n"], r["inliers"], r["h"]) for r in homography.fit(spark.createDataFrame(rows, DDL), ["k"], "id").collect()}
    assert found["three"] == (3, 0, None) and found["line"] == (9, 0, None) and found["same"] == (9, 0, None) and found["none"] == (0, 0, None)
    assert found["four"][:2] == (4, 4) and np.allclose(found["four"][2], [2, 0, 1, 0, 1, 0, 0, 0, 1], atol=1e-9)
    assert homography.fit(spark.createDataFrame([], DDL), ["k"], "id").collect() == []


def plain_hull(points):
    """Points that lie on no line with, and in no triangle of, others; by edges that have all points on their left."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    after = {}
    for a in points:
        for b in points:
            if a != b and all(side(a, b, p) > 0 or side(a, b, p) == 0 and min(a, b) <= p <= max(a, b) for p in points):
                after[a] = b
    out = [points[0]]
    while after[out[-1]] != points[0]:
        out.append(after[out[-1]])
    return out


def test_hull_of_points_dealt_over_tasks_is_the_plain_hull(spark):
    rnd = random.Random(4)
    groups = {"few": [(rnd.randrange(6), rnd.randrange(6)) for _ in range(40)], "many": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)], "one": [(3, 3)] * 5, "two": [(1, 1), (2, 5)], "line": [(i, 2 * i) for i in range(30)], None: [(0, 0), (4, 0), (0, 4), (1, 1)]}
    rows = [(k, float(x), float(y)) for k, ps in groups.items() for x, y in ps] + [("few", None, 1.0), ("few", float("nan"), 1.0), ("gone", float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    got = {r["k"]: [(p["x"], p["y"]) for p in r["hull"]] for r in hulls.convex_hull(df, ["k"], spread=4).collect()}
    assert got == {k: [(float(x), float(y)) for x, y in plain_hull(ps)] for k, ps in groups.items()}


def plain_outline(poly, yaw, pitch, fov, size, view, samples):
    """As specified: edges the shorter way around, directions turned by yaw and then by minus pitch, projected."""
    w, h = size
    out = []
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1], strict=True):
        if abs(x2 - x1) > w / 2:
            x2 += -w if x2 > x1 else w
        for i in range(samples):
            lon, lat = (((x1 + i / samples * (x2 - x1)) % w) / w - 0.5) * 2 * math.pi, (0.5 - (y1 + i / samples * (y2 - y1)) / h) * math.pi
            v = np.array([math.cos(lat) * math.sin(lon), math.sin(lat), math.cos(lat) * math.cos(lon)])
            a, b = math.radians(yaw), math.radians(-pitch)
            v = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]]) @ v
            v = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]]) @ v
            if v[2] > 1e-6:
                f = view[0] / 2 / math.tan(math.radians(fov / 2))
                out.append((f * v[0] / v[2] + view[0] / 2, -f * v[1] / v[2] + view[1] / 2))
    return out


@pytest.mark.parametrize("centre", [1440, 10])
def test_outline_of_a_polygon_in_a_view(spark, centre):
    poly = [((centre + dx) % 2880, 800 + dy) for dx, dy in ((-300, 0), (-100, -60), (200, -40), (350, 90), (20, 160))]
    yaw = 20.0 if centre == 1440 else 170.0
    df = spark.createDataFrame(
        [(1, [{"x": float(x), "y": float(y)} for x, y in poly]), (3, [])], "k int, poly array<struct<x:double,y:double>>"
    )
    got = {r["k"]: r["outline"] for r in hulls.visible_outline(df, ["k"], "poly", yaw, 15.0, 90.0).collect()}
    points = plain_outline(poly, yaw, 15.0, 90.0, (2880, 1440), (960, 540), 50)
    assert got[3] is None
    if len(points) < 3:
        assert got[1] is None
        return
    want = [(int(x), int(y)) for x, y in hulls.hull_of(np.array(points)).tolist()]
    assert len(points) > 100
    assert max(min(math.dist((p["x"], p["y"]), q) for q in want) for p in got[1]) <= 1.5
    assert max(min(math.dist((p["x"], p["y"]), q) for p in got[1]) for q in want) <= 1.5


def test_densified_edges_cross_the_seam(spark):
    df = spark.range(1).select(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((95, 0), (5, 10), (50, 10))]).alias("p"))
    got = df.select(hulls.densify(F.col("p"), 100.0, 2).alias("d")).first()["d"]
    assert [(p["x"], p["y"]) for p in got] == [(95.0, 0.0), (0.0, 5.0), (5.0, 10.0), (27.5, 10.0), (50.0, 10.0), (72.5, 5.0)]
