"""Readers and writers over small files of every format."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kickframe.sources import readers, writers

PROJECT = """<?xml version="1.0"?><project><schemes><scheme id="Project1"><timeline><recording><keyframes>
<keyframe id="a" time="2000" pan="1.5707963267948966" tilt="0" fov="1.0"/><keyframe id="b" time="1000" pan="0"/>
</keyframes></recording></timeline></scheme><scheme id="backup"><timeline><recording><keyframes></keyframes></recording></timeline></scheme></schemes></project>"""


def test_keyframes(spark, tmp_path):
    (tmp_path / "c1.insprj").write_text(PROJECT)
    for rows in (readers.keyframes(spark, str(tmp_path)), readers.all_keyframes(spark, str(tmp_path))):
        got = rows.orderBy("time_s").collect()
        assert [(r.kf_id, r.time_s, round(r.pan_deg, 6), r.tilt_deg) for r in got] == [("b", 1.0, 0.0, 0.0), ("a", 2.0, 90.0, 0.0)]
    assert {r.scheme_id for r in readers.keyframes(spark, str(tmp_path)).collect()} == {"Project1"}


def test_pan_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 1.25, "ball", 0.75), (1.0, -3.5, "hold", None)], "timestamp_s double, predicted_pan_deg double, mode string, ball_conf double")
    writers.pan_log(df, str(tmp_path / "log"))
    back = readers.pan_log(spark, str(tmp_path / "log")).orderBy("timestamp_s").collect()
    assert [tuple(r) for r in back] == [(0.5, 1.25, "ball", 0.75), (1.0, -3.5, "hold", None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="predicted_pan_deg, timestamp_s"):
        readers.pan_log(spark, str(tmp_path / "bad.csv"))


def test_manifest_and_existence(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"insv": "a", "project": "b", "calib": "c"}, {"insv": "x", "project": "b", "calib": "c"}]))
    there = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert readers.manifest(spark, str(tmp_path / "m.json")).count() == 2
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.json"), there).collect()] == [("a", "b", "c")]


@pytest.mark.parametrize(
    ("doc", "layout", "first"),
    [
        ({"pitch_polygon": [[1, 2], [3, 4], [5, 6]]}, "pixels", (1.0, 2.0, 2880, 1440)),
        ({"auto_polygon": [{"x": 0.5, "y": 0.25}, {"x": 0.1, "y": 0.2}, {"x": 1, "y": 1}], "pixel_polygon": [[9, 9]]}, "auto", (1440.0, 360.0, 2880, 1440)),
        ({"equirect_size": [100, 50], "pitch_polygon_equirect": [[1, 2], [3, 4], [3, 4]]}, "equirect", (1.0, 2.0, 100, 50)),
        ({"w": 10, "h": 20, "polygon_points": [[1, 2], [3, 4], [5, 6]]}, "mask", (1.0, 2.0, 10, 20)),
        ({"equirect": {"in_w": 8, "in_h": 4}, "pitch_polygon_360": [[1, 2], [3, 4], [5, 6]]}, "360", (1.0, 2.0, 8, 4)),
        ({"pitch_polygon": [[1, 2], [3, 4]]}, None, None),
    ],
)
def test_polygons(spark, tmp_path, doc, layout, first):
    (tmp_path / "p.json").write_text(json.dumps(doc))
    rows = readers.polygons(spark, str(tmp_path)).orderBy("idx").collect()
    if layout is None:
        assert rows == []
    else:
        assert (rows[0].layout, (rows[0].x, rows[0].y, rows[0].frame_w, rows[0].frame_h), len(rows)) == (layout, first, 3)


def test_summary_round_trip(spark, tmp_path):
    doc = {"approach": "a", "clips": {"001": {"segments": [{"t0": 1.0, "rmse": 3.0, "mae": 2.0, "n": 60}, {"t0": 9.0, "rmse": 4.0, "mae": 3.0, "n": 50}], "overall_rmse": 3.5355339, "overall_mae": 2.5}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_summary.json").write_text(json.dumps(doc, indent=2))
    clips = readers.summaries(spark, str(tmp_path / "in"))
    row = clips.select(F.sqrt(F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["rmse"] * x["rmse"]) / F.size("segments")).alias("o"), "overall_rmse").first()
    assert row.o == pytest.approx(row.overall_rmse)
    writers.summary_json(clips, str(tmp_path / "out"))
    assert readers.summaries(spark, str(tmp_path / "out")).collect() == clips.collect()


def test_labels(spark, tmp_path):
    d = tmp_path / "train" / "labels"
    d.mkdir(parents=True)
    (d / "x.txt").write_text("0 0.1 0.2 0.3 0.4\n1 0.1 0.2 0.3 0.4 0.5 0.6\n2 0.1\n")
    (d / "empty.txt").write_text("")
    rows = readers.labels(spark, str(d)).orderBy("obj_idx").collect()
    assert [(r.split, r.stem, r.cls, len(r.coords)) for r in rows] == [("train", "x", 0, 4), ("train", "x", 1, 6)]
    assert [(r.stem, r.cls) for r in readers.first_labels(readers.labels(spark, str(d))).collect()] == [("x", 0)]


def test_crop_labels_skip_bad_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"crop_file":"a","label":"team0"}\n{bad\n{"crop_file":"b","label":"nobody"}\n')
    assert [r.crop_file for r in readers.crop_labels(spark, str(tmp_path / "c.jsonl")).collect()] == ["a"]


def test_footage_and_frames(spark, tmp_path):
    for name in ("VID_1_001.insv", "VID_1_002.INSV", "LRV_1_001.insv", ".x_003.insv", "notes.txt"):
        (tmp_path / name).write_bytes(b"12345678901234")
    assert {r.name for r in readers.footage(spark, str(tmp_path)).collect()} == {"VID_1_001.insv", "VID_1_002.INSV"}
    frames = readers.raw_frames(spark, str(tmp_path / "VID_1_001.insv"), 2, 1).orderBy("frame_idx").collect()
    assert [bytes(r.pixels) for r in frames] == [b"123456", b"789012"]

    def model():
        return lambda batch: pd.DataFrame({"frame_idx": batch.frame_idx, "n": [len(p) for p in batch.pixels]})

    found = readers.detect(readers.raw_frames(spark, str(tmp_path / "VID_1_001.insv"), 2, 1), model, "frame_idx int, n int")
    assert sorted(map(tuple, found.collect())) == [(0, 6), (1, 6)]


def test_times_and_lists(spark):
    t = [r.t for r in readers.stratified_times(spark, 10, 110, 5, 3).orderBy("i").collect()]
    assert all(10 + 20 * i <= x <= 26 + 20 * i for i, x in enumerate(t))
    s = [r.t0 for r in readers.random_starts(spark, 600, 45, 8, 1).collect()]
    assert s == sorted(s) and min(s) >= 10 and max(s) <= 550
    assert spark.range(1).select(readers.number_list(F.lit("100, 250")).alias("a")).first().a == [100.0, 250.0]


def test_calibration_document(spark):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.4, 2.0), (3.0, 4.6), (5.0, 6.0))])
    row = spark.range(1).select(writers.calibration(pts).alias("c"), writers.normalised(pts, 10, 20).alias("n"), writers.normalised(F.slice(pts, 1, 2), 10, 20).alias("few")).first()
    assert json.loads(row.c) == {"pitch_polygon": [[1, 2], [3, 5], [5, 6]]}
    assert tuple(row.n[0]) == (0.14, 0.1) and row.few is None


def test_volumes_and_image_sets(spark, tmp_path):
    from kickframe.sources import readers

    for name in ("CARD/DCIM/b/x.insv", "CARD/DCIM/a/y.insv", "OTHER/z.INSV", ".hidden/w.insv", "EMPTY/readme.txt", "top.insv"):
        path = tmp_path / "volumes" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    root = str(tmp_path / "volumes")
    got = sorted((r["volume"], r["path"].rsplit("/volumes", 1)[1], r["mount"]) for r in readers.volumes(spark, root).collect())
    assert got == [("CARD", "/CARD/DCIM/a", f"{root}/CARD"), ("OTHER", "/OTHER", f"{root}/OTHER")]
    for name in ("train/images/VID_2.jpg", "train/images/VID_1.jpg", "train/images/other.jpg", "valid/images/VID_3.jpg", "spare/images/VID_4.jpg", "train/labels/VID_1.txt"):
        path = tmp_path / "set" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = [(r["split"], r["name"], r["label"].rsplit("/set/", 1)[1]) for r in readers.image_sets(spark, str(tmp_path / "set")).collect()]
    assert got == [("train", "VID_1.jpg", "train/labels/VID_1.txt"), ("train", "VID_2.jpg", "train/labels/VID_2.txt"), ("valid", "VID_3.jpg", "valid/labels/VID_3.txt")]


def test_times_resume_and_errors(spark):
    import pytest

    from kickframe.operators import relational, series
    from kickframe.sources import readers

    times = [r["t"] for r in readers.interval_times(spark, 10.0, 41.0, 5.0, 3).collect()]
    assert len(times) == 6 and all(10 + 5 * i <= t <= 14 + 5 * i for i, t in enumerate(times))
    assert [r["t0"] for r in readers.listed_starts(spark, [30, 10.5]).collect()] == [10.5, 30.0]
    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, s string")
    assert sorted(map(tuple, readers.resume(items, items.where("i = 1"), ["i"]).collect())) == [(2, "b"), (2, "b")]
    assert readers.resume(items, items.limit(0), ["i"]).count() == 3
    with pytest.raises(ValueError, match="no keyframes"):
        readers.some(items.limit(0), "keyframes")
    assert readers.some(items, "keyframes").count() == 3
    # an empty left side falls back to the right one
    right = spark.createDataFrame([("u", "coach"), ("v", None)], "k string, role string")
    assert sorted(map(tuple, relational.left_or_only(right.select("k").limit(0), right, "k", "role").collect())) == [("u", "coach"), ("v", None)]
    assert sorted(map(tuple, relational.left_or_only(spark.createDataFrame([("u",), ("w",)], "k string"), right, "k", "role").collect())) == [("u", "coach"), ("w", None)]
    # repeated rows stay repeated
    left = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0)], "k string, t double")
    near = series.nearest_within(left, spark.createDataFrame([("a", 1.4), ("a", 0.8)], "k string, t double"), ["k"], "t", "t", 0.5)
    assert sorted(map(tuple, near.collect())) == [("a", 1.0), ("a", 1.0)]
