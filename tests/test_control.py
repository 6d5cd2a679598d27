"""Filters and choices by numbers worked out by hand, and trackers against plain ones."""

import random

import pytest

from kickframe.operators import control, tracking


def run(spark, rows, names, fn):
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], f"k int, t int, {names}")
    return [r.asDict() for r in fn(df).orderBy("t").collect()]


def kalman(spark, values):
    rows = [(float(v) if v is not None else None, v is not None) for v in values]
    return run(spark, rows, "x double, seen boolean", lambda df: control.kalman(df, ["k"], ["t"], ["x"], seen="seen"))


def test_a_far_measurement_right_after_another_is_ignored(spark):
    got = kalman(spark, [0, 500, 500])
    assert [(r["est_0"], r["vel_0"], r["missed"]) for r in got] == [(0.0, 0.0, 0)] * 3


def test_after_a_miss_a_very_far_measurement_starts_anew(spark):
    got = kalman(spark, [0, None, 500])
    assert (got[1]["est_0"], got[1]["missed"]) == (0.0, 1) and (got[2]["est_0"], got[2]["vel_0"], got[2]["missed"]) == (500.0, 0.0, 0)
    # one between the two limits is taken in after a miss
    assert 0 < kalman(spark, [0, None, 300])[2]["est_0"] < 300


def test_first_update_and_prediction_before_decay(spark):
    got = kalman(spark, [0, 100, None, None])
    # covariance 500, 0, 500 becomes 1012.5, 525, 550; gains 1012.5/1237.5 and 525/1237.5
    x, v = 100 * 1012.5 / 1237.5, 100 * 525 / 1237.5
    assert got[1]["est_0"] == pytest.approx(x) and got[1]["vel_0"] == pytest.approx(v)
    assert got[2]["est_0"] == pytest.approx(x + v) and got[2]["vel_0"] == pytest.approx(v * 0.92)
    assert got[3]["est_0"] == pytest.approx(x + v + v * 0.92) and got[3]["vel_0"] == pytest.approx(v * 0.92 * 0.92**2)


def test_rows_before_the_first_measurement_have_no_track(spark):
    assert [r["est_0"] for r in kalman(spark, [None, None, 7])] == [None, None, 7.0]


def cascade(spark, rows):
    names = "bx double, by double, conf double, n int, cx double, cy double, gx double, gy double"
    return run(spark, rows, names, lambda df: control.choose_kalman(df, ["k"], ["t"], ("bx", "by"), "conf", "n", ("cx", "cy"), ("gx", "gy"), fresh=2, old=5))


def test_the_cascade_rule_by_rule(spark):
    none = (None, None, None)
    rows = [
        (*none, 0, None, None, None, None),  # nobody
        (*none, 1, None, None, 100.0, 200.0),  # one player
        (*none, 2, None, None, 1270.0, 360.0),  # two at the edge
        (*none, 2, None, None, 700.0, 360.0),  # two in the middle
        (*none, 3, 1250.0, 300.0, 1200.0, 300.0),  # a cluster at the edge
        (400.0, 300.0, 0.9, 0, None, None, None, None),  # a sure ball
        (900.0, 300.0, 0.9, 0, None, None, None, None),  # too far from the track
        (*none, 0, None, None, None, None),  # lost one row ago
        (*none, 0, None, None, None, None),  # two rows ago
        (*none, 3, 800.0, 300.0, None, None),  # three rows ago, with a cluster
    ]
    got = [(r["mode"], round(r["target_x"], 3)) for r in cascade(spark, rows)]
    assert got == [
        ("centre", 640.0), ("single_player", 0.05 * 100 + 0.95 * 640), ("few_players", 0.2 * 1270 + 0.8 * 640), ("hold", 640.0), ("players", 1250.0),
        ("ball_highconf", 400.0), ("ball", 400.0), ("ball", 400.0), ("kalman", 400.0), ("kalman_blend", 0.85 * 400 + 0.15 * 800),
    ]


def test_online_centres_abstain(spark):
    rows = [([1.0, 0.0],), ([0.70710678, 0.70710678],), ([10.0, 0.0],), ([0.0, 1.0],)]
    got = run(spark, rows, "f array<double>", lambda df: control.online_centres(df, ["k"], ["t"], "f", [[1.0, 0.0], [0.0, 1.0]]))
    assert [r["assigned"] for r in got] == [0, None, None, 1]


def plain_tracks(boxes, forget, reuse_new, least=0.3):
    """Greedy assignment in order, all tracks compared with every box."""

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    tracks, out, number = {}, [], 0
    for frame in sorted({f for f, *_ in boxes}):
        tracks = {k: t for k, t in tracks.items() if frame - t[1] <= forget + 1}
        used = set()
        for f, det, *b in boxes:
            if f != frame:
                continue
            scored = [(iou(t[0], b), -k) for k, t in tracks.items() if k not in used and iou(t[0], b) >= least]
            if scored:
                k = -max(scored)[1]
                used.add(k)
            else:
                number += 1
                k = number
                if not reuse_new:
                    used.add(k)
            tracks[k] = (b, frame)
            out.append((frame, det, k))
    return out


@pytest.mark.parametrize(("forget", "reuse_new"), [(10, True), (2, False)])
def test_tracks_are_those_of_a_plain_tracker(spark, forget, reuse_new):
    rng = random.Random(forget)
    boxes = []
    for f in range(12):
        for d in range(15):
            x, y = rng.randrange(0, 120), rng.randrange(0, 80)
            boxes.append((f * rng.choice((1, 1)), d, float(x), float(y), float(x + rng.randrange(20, 60)), float(y + rng.randrange(20, 60))))
    df = spark.createDataFrame([("c", *b) for b in boxes], "clip string, t int, det int, x1 double, y1 double, x2 double, y2 double").withColumn("v", __import__("pyspark").sql.functions.lit("a"))
    got = tracking.track(df, ["clip"], "t", ["det"], vote="v", forget=forget, reuse_new=reuse_new).select("t", "det", "track_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain_tracks(boxes, forget, reuse_new))
