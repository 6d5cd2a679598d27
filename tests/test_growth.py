"""Queries whose work has to grow no faster than their tables."""

import math
import random

import pytest

from kickframe.operators import boxes, cluster, relational, tracking
from kickframe.plans import catalog

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_improved_needs_no_join_and_keeps_the_first_of_equals(spark):
    nan = float("nan")
    rows = [
        ("equal", True, 0.2, 0.1, 0.0, 0), ("equal", False, 0.9, 0.5, 0.0, 2), ("equal", False, 0.9, 0.5, 0.0, 1),
        ("fine", True, 0.2, 0.5, 0.0, 0), ("fine", False, 0.9, 0.5, 0.0, 1),
        ("alone", True, 0.2, 0.1, 0.0, 7), ("blind", True, 0.2, 0.1, 0.0, 0), ("blind", False, None, 0.5, 0.0, 1),
        ("nan", True, 0.2, 0.1, 0.0, 0), ("nan", False, 0.9, 0.5, 0.0, 1), ("nan", False, nan, 0.5, 0.0, 3), ("nan", False, nan, 0.5, 0.0, 2),
        ("absent", False, 0.9, 0.5, 0.0, 1),
    ]
    tried = spark.createDataFrame(rows, "k string, now boolean, score double, cov double, off double, view int")
    found = relational.improved(tried, ["k"], "now", "score", "cov", "off", ["view"], ["view"])
    assert {r["k"]: r["view"] for r in found.collect()} == {"equal": 1, "fine": 0, "alone": 7, "blind": 0, "nan": 2}
    assert "Join" not in plan_of(found)


def plain_line(points, eps, least):
    """Clusters of (x, id) by the definition."""
    points = sorted(points)
    cores = [p for p in points if sum(abs(p[0] - q[0]) <= eps for q in points) >= least]
    number, last = {}, None
    for x, i in cores:
        number[x, i] = (number[last] + (x - last[0] > eps)) if last else 0
        last = (x, i)
    near = {i: min(((abs(x - c[0]), c[0], number[c]) for c in cores), default=(eps + 1, 0, -1)) for x, i in points}
    return {i: n if d <= eps else -1 for i, (d, _, n) in near.items()}


@pytest.mark.parametrize("least", [1, 2, 4])
def test_line_clusters_by_frames_that_only_grow(spark, least):
    rnd = random.Random(least)
    rows = [(k, 100 * k + i, float(rnd.randrange(60 * (k + 1)))) for k in range(6) for i in range(40)]
    nulls = [(k, 10000 + 10 * k + i, None) for k in range(6) for i in range(5)]
    placed = cluster.dbscan_line(spark.createDataFrame(rows + nulls, "k int, id int, x double"), ["k"], "x", ["id"], 3.0, least)
    want = {n[1]: -1 for n in nulls}
    for k in range(6):
        want |= plain_line([(x, i) for g, i, x in rows if g == k], 3.0, least)
    assert {r["id"]: r["cluster"] for r in placed.collect()} == want
    # frames by range, and those to the end of a group, are gone through again for each row
    plan = plan_of(placed).lower()
    assert "rangeframe" not in plan.replace(" ", "") and "unboundedfollowing" not in plan


def test_pictures_of_a_small_file_are_made_by_all_tasks_a_line_at_a_time(spark):
    plan = plan_of(catalog.QUERIES["sliced_boxes"](spark, SF))
    assert "Repartition" in plan and "5183" not in plan


def test_scans_are_dealt_by_key_before_they_are_sorted_for_grouping(spark):
    scans = spark.createDataFrame([(1, 0, 700.0, 0.9, 4, 640.0), (1, 10, 640.0, 0.9, 5, None), (2, 20, None, 0.9, 4, 640.0)], "k int, yaw int, bx double, conf double, n int, cx double")
    found = relational.warm_start(scans, ["k"], "yaw", ("bx", "conf"), "n", "cx", 100.0, 1280.0)
    got = {r["k"]: round(r["start"], 3) for r in found.collect()}
    assert got == {1: round(math.degrees(math.atan(60 / 640 * math.tan(math.radians(50)))), 3), 2: 20.0}
    assert "RepartitionByExpression" in plan_of(found)


def test_pairs_of_a_frame_need_no_join(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double,conf:double,id:bigint>"
    places = [(1, 0, 0, 2, 2), (1, 1, 0, 3, 2), (1, 5, 5, 6, 6), (1, 2, 0, 2, 9), (None, 0, 0, 2, 2), (None, 0, 0, 2, 2), (1, 2, 0, 4, 2)]
    rows = [(f, i, (float(a), float(b), float(c), float(d), 0.5, i)) for i, (f, a, b, c, d) in enumerate(places)]
    found = boxes.pairs_iou(spark.createDataFrame(rows, f"f int, id long, box {box}"), "f", "box", "id")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1, 2 / 6), (1, 1, 6, 2 / 6)]
    assert "Join" not in plan_of(found)


@pytest.mark.parametrize(("forget", "reuse_new"), [(10, True), (1, False)])
def test_boxes_of_a_clip_meet_the_tracks_at_once(monkeypatch, forget, reuse_new):
    held, calls, iou = {}, [], tracking._iou
    monkeypatch.setattr(tracking, "ordered_fold", lambda df, keys, order, init, step, ddl, steps: held.update(init=init, step=step, steps=steps))
    monkeypatch.setattr(tracking, "_iou", lambda a, b: calls.append(1) or iou(a, b))
    tracking.track(None, ["k"], "t", ["i"], vote="v", forget=forget, reuse_new=reuse_new, min_votes=2)
    rnd, odd = random.Random(forget), [float("nan"), float("inf"), -float("inf"), 1e300, 2**60, 2**60 + 30]
    for strange in (0.0, 0.2):
        rows = []
        for i in range(900):
            x, y = rnd.randrange(300), rnd.randrange(200)
            box = [float(x), float(y), float(x + rnd.randrange(0, 200)), float(y + rnd.randrange(0, 300))]
            if rnd.random() < strange:
                box[rnd.randrange(4)] = rnd.choice(odd)
            rows.append({"t": i // 60, "v": rnd.choice([None, "a", "b"])} | dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)))
        state, one = held["init"](), held["init"]()
        want = [held["step"](one, r) for r in rows]
        by_row, lists, got, at = len(calls), {c: [r[c] for r in rows] for c in rows[0]}, [], 0
        calls.clear()
        while at < len(rows):
            end = min(len(rows), at + rnd.randrange(1, 500))
            got, at = got + held["steps"](state, lists, at, end), end
        assert got == want
        assert strange or len(calls) * 4 < by_row
        calls.clear()


def test_overlaps_of_plain_boxes_are_made_once_with_the_numbers_of_a_step(monkeypatch):
    held, calls, iou = {}, [], tracking._iou
    monkeypatch.setattr(tracking, "ordered_fold", lambda df, keys, order, init, step, ddl, steps: held.update(init=init, step=step, steps=steps))
    monkeypatch.setattr(tracking, "_iou", lambda a, b: calls.append(1) or iou(a, b))
    tracking.track(None, ["k"], "t", ["i"], vote="v", forget=2, reuse_new=False, min_votes=2, least_iou=1 / 3)
    rnd = random.Random(5)
    # few places and sizes, so many overlaps are equal, and equal to the least
    corners = [(rnd.randrange(6), rnd.randrange(6)) for _ in range(600)]
    rows = [{"t": i // 30, "v": rnd.choice([None, "a", "b"]), "x1": float(x), "y1": float(y), "x2": x + 2.0, "y2": y + rnd.choice([1.0, 2.0])} for i, (x, y) in enumerate(corners)]
    one = held["init"]()
    want = [held["step"](one, r) for r in rows]
    calls.clear()
    assert held["steps"](held["init"](), {c: [r[c] for r in rows] for c in rows[0]}, 0, len(rows)) == want
    assert not calls


def test_suppression_knows_areas_beforehand_and_keeps_what_the_definition_keeps(spark):
    from pyspark.sql import functions as F

    from kickframe.functions.geometry import iou

    rnd, odd = random.Random(9), [float("nan"), float("inf"), -float("inf"), 1e300, -1e300, None]
    rows = []
    for frame in range(120):
        for i in range(rnd.randrange(0, 9)):
            x, y = rnd.randrange(12), rnd.randrange(12)
            box = [float(x), float(y), x + float(rnd.randrange(-1, 12)), y + float(rnd.randrange(-1, 12)), rnd.choice([0.2, 0.5, None, float("nan")])]
            if frame % 2 and rnd.random() < 0.3:
                box[rnd.randrange(4)] = rnd.choice(odd)
            rows.append((frame, None if rnd.random() < 0.05 else (*box, i)))
    df = spark.createDataFrame(rows, "frame int, box struct<x1:double,y1:double,x2:double,y2:double,conf:double,id:bigint>")
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,conf:double,id:bigint>>"
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("box")["conf"]).alias("c"), F.col("box")["id"].alias("i"), F.col("box").alias("b")))), lambda s: s["b"])

    def plain(least, share):
        hit = lambda k, b: (iou(k, b) >= least) | (boxes._close(k, b, share) if share else F.lit(False))
        fold = F.aggregate("boxes", F.array().cast(kind), lambda acc, b: F.when(F.exists(acc, lambda k: hit(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
        return df.groupBy("frame").agg(order.alias("boxes")).select("frame", fold.alias("kept"))

    for least, share in ((0.55, 0.35), (0.5, None), (0.0, None)):
        want = plain(least, share)
        got = boxes.suppress(df, "frame", "box", least, share)
        assert "area" in plan_of(got)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
