"""Tiles, the second pass and drawn centres against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kickframe.operators import cluster, masks, sliced

W, H = 200, 120


def plain_grid(w, h, tile_w, tile_h, overlap=0.2, least=64):
    tile_w, tile_h = max(least, min(tile_w, w)), max(least, min(tile_h, h))
    step_x, step_y = max(32, tile_w - int(tile_w * overlap)), max(32, tile_h - int(tile_h * overlap))
    out, y = [], 0
    while True:
        bottom, x = min(h, y + tile_h), 0
        while True:
            right = min(w, x + tile_w)
            out.append((max(0, right - tile_w), max(0, bottom - tile_h), right, bottom))
            if right >= w:
                break
            x += step_x
        if bottom >= h:
            return out
        y += step_y


@pytest.mark.parametrize("tile", [(960, 540), (70, 50), (64, 64), (100, 200)])
def test_tile_grid(spark, tile):
    sizes = [(200, 120), (64, 64), (30, 700), (1920, 594), (65, 129)]
    df = spark.createDataFrame(sizes, "w int, h int")
    for row in df.select("w", "h", sliced.tile_grid(F.col("w"), F.col("h"), tile).alias("t")).collect():
        assert [tuple(t) for t in row["t"]] == plain_grid(row["w"], row["h"], *tile)


def scene(things):
    picture = np.zeros((H, W), np.uint8)
    for value, x, y, w, h in things:
        picture[y : y + h, x : x + w] = value
    return picture.tobytes()


@pytest.fixture
def stub():
    def stub():
        """The box of each grey value, the surer the larger it is; what a tile cuts is a smaller, less sure box."""

        def find(batch):
            out = []
            for tile, data, w, h in zip(batch["tile"], batch["pixels"], batch["width"], batch["height"], strict=True):
                picture = np.frombuffer(data, np.uint8).reshape(h, w)
                for value in np.unique(picture[picture > 0]).tolist():
                    ys, xs = np.nonzero(picture == value)
                    out.append((tile, float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1), len(xs) / 1000))
            return pd.DataFrame(out, columns=["tile", "x1", "y1", "x2", "y2", "conf"])

        return find

    return stub


FAR = [(10 * i + 5, 9 + 19 * i, 6 + 3 * i, 4, 7) for i in range(9)]
NEAR = [(200, 60, 90, 30, 25)]


def frames(spark):
    rows = [("m", 0, scene(FAR)), ("m", 1, scene(FAR + NEAR)), ("m", 2, scene(NEAR)), ("m", 3, scene([])), ("n", 4, None), (None, 5, scene(NEAR))]
    return spark.createDataFrame([(k, i, p, W, H) for k, i, p in rows], "clip string, i int, pixels binary, w int, h int")


def test_tiles_find_what_the_whole_frame_shows(spark, stub):
    got = sliced.sliced(frames(spark).where("clip = 'm' AND i IN (0, 3)"), ["clip", "i"], "pixels", "w", "h", stub, (80, 80), channels=1).collect()
    want = {("m", i, *map(float, (x, y, x + w, y + h))) for i, things in enumerate([FAR]) for _, x, y, w, h in things}
    assert {tuple(r)[:6] for r in got} == want and len(got) == len(want)


def whole(things):
    return sorted((float(x), float(y), float(x + w), float(y + h)) for _, x, y, w, h in things)


def test_second_pass_only_where_it_is_called_for(spark, stub):
    calls = spark.sparkContext.accumulator(0)

    def counted():
        real = stub()

        def find(batch):
            calls.add(len(batch))
            return real(batch)

        return find

    df = frames(spark).where("clip = 'm'")
    got = sliced.two_passes(df, ["clip", "i"], "i", "pixels", "w", "h", counted, tile=(80, 80), every=2, few=2, channels=1).collect()
    by = {i: sorted(tuple(r)[2:6] for r in got if r["i"] == i) for i in range(4)}
    assert by == {0: whole(FAR), 1: whole(FAR + NEAR), 2: whole(NEAR), 3: []}
    # whole frames, then frame 0 (small boxes, band of 66 rows) and frame 2 (few boxes, 84 rows); 1 and 3 are not divisible
    tiles = len(plain_grid(W, round(H * 0.55), 80, 80)) + len(plain_grid(W, round(H * 0.7), 80, 80))
    assert calls.value % (4 + tiles) == 0 or calls.value >= 4 + tiles


def test_tiles_off_the_mask_are_passed_over(spark):
    df = frames(spark).where("clip = 'm' AND i = 2")
    seen = lambda poly: sliced.two_passes(df, ["clip", "i"], "i", "pixels", "w", "h", mark, masks=masks.mask_runs(poly, ["clip", "i"], "poly", W, H), tile=(80, 80), few=2, channels=1).count()

    def mark():
        """One box for each tile, all apart."""

        def find(batch):
            return pd.DataFrame([(t, 0.0, 0.0, 2.0, 2.0, 0.5) for t in batch["tile"]], columns=["tile", "x1", "y1", "x2", "y2", "conf"])

        return find

    corners = lambda *ps: spark.createDataFrame([("m", 2, [{"x": x, "y": y} for x, y in ps])], "clip string, i int, poly array<struct<x:int,y:int>>")
    every = len({t[:2] for t in plain_grid(W, 84, 80, 80)})
    assert seen(corners((0, 0), (W, 0), (W, H), (0, H))) == every
    # only the left column of tiles sees this; its first tile and the whole frame share a box
    left = len({t[:2] for t in plain_grid(W, 84, 80, 80) if t[0] < 40})
    assert seen(corners((0, 0), (39, 0), (39, H), (0, H))) == left < every


def test_drawn_centres_are_those_of_the_race(spark):
    rng = np.random.default_rng(2)
    points = {i: rng.normal(size=3).tolist() for i in range(200)} | {900: [50.0, 0.0, 0.0], 901: [50.0, 0.0, 0.0]}
    df = spark.createDataFrame([(i, p) for i, p in points.items()] + [(990, None)], "id long, f array<double>")
    hashes = df.select("id", *[F.xxhash64(F.lit(3), F.lit(t), F.col("id")).alias(f"h{t}") for t in range(4)]).collect()
    want = []
    for t in range(4):
        best = None
        for r in hashes:
            p = points.get(r["id"])
            if p is None:
                continue
            weight = min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in want), default=1.0)
            if weight > 0:
                time = -math.log((((r[f"h{t}"] % (1 << 64)) >> 11) + 0.5) / (1 << 53)) / weight
                best = min(best or (math.inf, 0), (time, r["id"]))
        want.append(points[best[1]])
    for parts in (1, 5):
        assert cluster.seed_centres(df.repartition(parts), "id", "f", 4, seed=3) == want
    assert [50.0, 0.0, 0.0] in want, "a far point is drawn"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, f array<double>")
    assert cluster.seed_centres(same, "id", "f", 3) == [[1.0, 2.0]]
    assert cluster.seed_centres(same.limit(0), "id", "f", 3) == []


def test_an_empty_cluster_keeps_its_centre(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6])], "id long, f array<double>")
    centres = cluster.lloyd(df, "f", [[1.0, 0.0], [0.0, -1.0]])
    assert centres[1] == [0.0, -1.0] and abs(centres[0][0] ** 2 + centres[0][1] ** 2 - 1) < 1e-12
