"""Interpolation outside of the knots, dragged handles and full sweeps against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from kickframe.operators import cluster, series


def test_interpolation_outside_of_the_knots(spark):
    knots = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 3.0, 2.0), ("one", 1.0, 5.0)], "k string, t double, y double")
    samples = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 0.5), ("a", 3.0), ("a", 9.0), ("one", 1.0), ("none", 1.0), ("a", 9.0)], "k string, x double")
    at = lambda outside: sorted(map(tuple, series.pchip_at(samples, knots, ["k"], "x", "t", "y", "v", outside).collect()), key=repr)
    inner = {r[1]: r[2] for r in at("drop")}
    assert set(inner) == {0.0, 0.5, 3.0} and inner[0.0] == 1.0 and inner[3.0] == 2.0
    want = lambda low, high: sorted([("a", -1.0, low), ("a", 0.0, 1.0), ("a", 0.5, inner[0.5]), ("a", 3.0, 2.0), ("a", 9.0, high), ("a", 9.0, high), ("one", 1.0, None), ("none", 1.0, None)], key=repr)
    assert at("clamp") == want(1.0, 2.0) and at("null") == want(None, None)
    with pytest.raises(ValueError, match="drop, clamp or null"):
        at("other")


def dragged(handle, raw, c, t, s, e):
    if handle == "context":
        c = min(raw, t)
    if handle == "at":
        t, c, s = raw, min(c, raw), max(s, raw)
    if handle == "shown":
        s = max(raw, t)
    if handle == "end":
        e = max(raw, s)
    s = max(s, t)
    return c, t, s, max(e, s)


def test_dragged_handles_keep_their_order(spark):
    rnd = random.Random(2)
    rows = [(float(rnd.randrange(20)), *sorted(float(rnd.randrange(20)) for _ in range(4))) for _ in range(60)]
    df = spark.createDataFrame(rows, "raw double, c double, t double, s double, e double")
    for handle in ("context", "at", "shown", "end"):
        got = df.select("*", *[v.alias(f"n{i}") for i, v in enumerate(series.moved_handle(handle, *[F.col(n) for n in ("raw", "c", "t", "s", "e")]))]).collect()
        for r in got:
            assert tuple(r)[5:] == dragged(handle, *tuple(r)[:5])
            assert list(tuple(r)[5:]) == sorted(tuple(r)[5:])


def test_a_full_sweep_is_the_best_of_each_eps(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.uniform(0, 90), rnd.uniform(1, 5)) for k in ("a", "b") for i in range(25)]
    df = spark.createDataFrame(rows, "k string, id int, x double, h double")
    wide = {r["k"]: r for r in cluster.sweep(df, ["k"], "x", "h", "id", [2, 5.5], "by_height", 2, full=True).collect()}
    for eps in (2, 5.5):
        for r in cluster.best(cluster.dbscan_pairs(df, ["k"], "x", ["id"], float(eps)), ["k"], "x", "h", "id", "by_height", 2).collect():
            assert tuple(wide[r["k"]][f"{n}_eps{eps:g}"] for n in ("centre", "size", "mean_size", "n_clusters")) == (r["centre"], r["size"], r["mean_size"], r["n_clusters"])
