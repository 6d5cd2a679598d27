"""Masks, strips and kit features against plain versions, pixel by pixel."""

import colorsys
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickframe.operators import masks, pictures


def plain_set(poly, px, py):
    inside = False
    for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1], strict=True):
        if (x1 - x0) * (py - y0) == (y1 - y0) * (px - x0) and min(x0, x1) <= px <= max(x0, x1) and min(y0, y1) <= py <= max(y0, y1):
            return True
        if (y0 <= py) != (y1 <= py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0):
            inside = not inside
    return inside


POLYS = {"square": [(2, 2), (9, 2), (9, 7), (2, 7)], "flat": [(1, 4), (8, 4), (3, 4)], "star": [(0, 0), (19, 11), (-4, 6), (17, -3), (6, 14)], "beyond": [(-9, -9), (40, -9), (40, 30), (-9, 30)], "slim": [(3, 1), (4, 11), (5, 1)]}


def polygons(spark):
    rows = [(k, [{"x": x, "y": y} for x, y in p]) for k, p in POLYS.items()] + [("two", [{"x": 1, "y": 1}, {"x": 2, "y": 2}]), ("null", None)]
    return spark.createDataFrame(rows, "k string, poly array<struct<x:int,y:int>>")


def test_runs_are_the_set_pixels(spark):
    runs = masks.mask_runs(polygons(spark), ["k"], "poly", 20, 12).collect()
    got = {}
    for r in sorted(runs):
        row = got.setdefault(r["k"], {}).setdefault(r["y"], [])
        assert not row or r["a"] > row[-1][1] + 1, "runs of a row lie apart"
        row.append((r["a"], r["b"]))
    for k, poly in POLYS.items():
        want = {(x, y) for x in range(20) for y in range(12) if plain_set(poly, x, y)}
        assert {(x, y) for y, row in got[k].items() for a, b in row for x in range(a, b + 1)} == want, k
    assert set(got) == set(POLYS)


@pytest.mark.parametrize("rounded", [True, False])
def test_points_in_masks(spark, rounded):
    rnd = random.Random(3)
    points = [(k, i, rnd.choice([rnd.uniform(-5, 25), rnd.randrange(20) + 0.5]), rnd.uniform(-5, 17)) for k in [*POLYS, "two", "other", None] for i in range(80)]
    points += points[:3] + [("square", 99, None, 3.0)]
    df = spark.createDataFrame(points, "k string, i int, x double, y double")
    runs = masks.mask_runs(polygons(spark), ["k"], "poly", 20, 12)
    got = masks.keep_in_mask(df, runs, ["k"], "x", "y", 20, 12, rounded).collect()

    def keeps(k, x, y):
        if k not in POLYS:
            return True
        whole = round if rounded else int
        return x is not None and plain_set(POLYS[k], min(max(whole(x), 0), 19), min(max(whole(y), 0), 11))

    assert sorted(map(tuple, got), key=repr) == sorted((p for p in points if keeps(p[0], *p[2:])), key=repr)


def test_views_and_tiles(spark):
    runs = masks.mask_runs(polygons(spark), ["k"], "poly", 20, 12)
    view = {r["k"]: r for r in masks.mask_view(runs, ["k"], 20, 12, least=40).collect()}
    for k, poly in POLYS.items():
        pixels = np.array([(x, y) for x in range(20) for y in range(12) if plain_set(poly, x, y)])
        assert view[k]["coverage"] == len(pixels) / 240
        offset = 0.5 * (abs(pixels[:, 0].mean() - 10) / 10 + abs(pixels[:, 1].mean() - 6) / 6) if len(pixels) >= 40 else 1.0
        assert abs(view[k]["offset"] - offset) < 1e-12
        assert abs(view[k]["score"] - (0.45 * len(pixels) / 240 + 0.55 * max(0, 1 - offset) if len(pixels) >= 40 else 0)) < 1e-12
    tiles = spark.createDataFrame([(k, x, y, x + 10, y + 6) for k in [*POLYS, "null"] for x in (0, 5, 10) for y in (0, 6)], "k string, x1 int, y1 int, x2 int, y2 int")
    for r in masks.tile_coverage(tiles, runs, ["k"]).collect():
        want = None if r["k"] == "null" else sum(plain_set(POLYS[r["k"]], x, y) for x in range(r["x1"], r["x2"]) for y in range(r["y1"], r["y2"])) / 60
        assert r["coverage"] == want


def test_row_statistics_are_numpys(spark):
    rng = np.random.default_rng(5)
    picture = rng.integers(0, 256, (9, 13), dtype=np.uint8)
    rows = [(1, picture.tobytes() + b"xx", 13), (2, None, 13), (3, b"", 13), (4, b"abc", 0), (5, bytes([7]) * 13, 13)]
    df = spark.createDataFrame(rows, "k int, pixels binary, width int")
    got = {(r["k"], r["y"]): tuple(r)[2:] for r in pictures.row_statistics(df, ["k"], "pixels", "width", 2, 12, 1, 8).collect()}
    assert set(got) == {(1, y) for y in range(1, 8)}
    for (_, y), (n, *found) in got.items():
        strip = picture[y, 2:12]
        assert n == 10 and np.allclose(found, [strip.mean(), strip.var(), np.median(strip), np.percentile(strip, 75)])


def test_patches_and_halves(spark):
    rng = np.random.default_rng(6)
    picture = rng.integers(0, 256, (30, 40, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, picture.tobytes(), 40, 20, 10), (2, picture.tobytes(), 40, 0, 0), (3, picture.tobytes(), 40, 90, 90), (4, None, 40, 1, 1)], "k int, p binary, w int, x int, y int")
    got = {r["k"]: tuple(r)[1:] for r in pictures.patch_colour(df, ["k"], "p", "w", "x", "y", 5).collect()}
    for k, patch in ((1, picture[5:15, 15:25]), (2, picture[:5, :5])):
        assert got[k] == (int(np.median(patch[..., 0])), int(np.median(patch[..., 1])), int(np.percentile(patch[..., 2], 75)))
    assert got[3] == got[4] == (None, None, None)
    sky, grass = [(90, 120, 200)] * 8, [(40, 160, 30)] * 8
    halves = [(1, sky + grass), (2, grass + sky), (3, sky + sky), (4, None)]
    df = spark.createDataFrame([(k, None if p is None else bytes(c for px in p for c in px), 4) for k, p in halves], "k int, p binary, w int")
    assert {r["k"]: r["green_below"] for r in pictures.green_below(df, ["k"], "p", "w").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_colours_are_those_of_the_standard_library():
    rng = np.random.default_rng(7)
    colours = np.concatenate([rng.integers(0, 256, (500, 3)), [[0, 0, 0], [255, 255, 255], [9, 9, 9], [255, 0, 0], [0, 255, 0], [0, 0, 255]]]).astype(np.uint8)
    for rgb, (h, s, v) in zip(colours.tolist(), pictures.rgb_to_hsv(colours).tolist(), strict=True):
        hue, saturation, value = colorsys.rgb_to_hsv(*[c / 255 for c in rgb])
        assert abs((h - hue * 180 + 90) % 180 - 90) <= 0.51 and abs(s - saturation * 255) <= 0.51 and v == round(value * 255)
    # fixed values: known colours in 8-bit L*a*b*
    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (255, 0, 0): (136, 208, 195), (0, 255, 0): (224, 42, 211), (0, 0, 255): (82, 207, 20)}
    for rgb, lab in known.items():
        assert np.abs(pictures.rgb_to_lab(np.array([rgb], np.uint8))[0].astype(int) - lab).max() <= 1


def plain_feature(crop):
    """The same rules, pixel by pixel, without scaling."""
    kept = []
    for rgb in crop.reshape(-1, 3).tolist():
        h, s, v = pictures.rgb_to_hsv(np.array([rgb], np.uint8))[0].tolist()
        if not (35 <= h <= 95 and s >= 40 and v >= 15):
            kept.append((rgb, (h, s, v)))
    if crop.shape[0] * crop.shape[1] < 144 or len(kept) < 10 or len(kept) < 0.1 * crop.shape[0] * crop.shape[1]:
        return None
    lab = [pictures.rgb_to_lab(np.array([rgb], np.uint8))[0].tolist() for rgb, _ in kept]
    out = [sum(c) / len(lab) for c in zip(*lab, strict=True)]
    out += [(sum((v - m) ** 2 for v in c) / len(lab)) ** 0.5 for c, m in zip(zip(*lab, strict=True), out, strict=True)]
    for k, (bins, end) in enumerate(((18, 180), (6, 256), (6, 256))):
        counts = [0] * bins
        for _, hsv in kept:
            counts[min(int(hsv[k] * bins / end), bins - 1)] += 1
        out += [c / len(kept) / (end / bins) for c in counts]
    norm = sum(v * v for v in out) ** 0.5
    return [v / norm for v in out]


def test_kit_features_of_literal_crops(spark):
    rng = np.random.default_rng(8)
    shirt = np.full((60, 50, 3), (200, 30, 40), np.uint8)
    noisy = rng.integers(0, 256, (60, 50, 3), dtype=np.uint8)
    green = np.full((60, 50, 3), (40, 160, 30), np.uint8)
    half = green.copy()
    half[:, 20:30] = (20, 20, 220)
    tiny = shirt[:4, :4]
    rows = [(n, p.tobytes(), p.shape[1], 0.0, 0.0, float(p.shape[1]), float(p.shape[0])) for n, p in (("shirt", shirt), ("noisy", noisy), ("green", green), ("half", half), ("tiny", tiny))]
    rows += [("null", None, 50, 0.0, 0.0, 1.0, 1.0), ("empty", shirt.tobytes(), 50, 10.0, 10.0, 10.0, 10.0), ("outside", shirt.tobytes(), 50, 500.0, 500.0, 600.0, 600.0)]
    df = spark.createDataFrame(rows, "k string, p binary, w int, x1 double, y1 double, x2 double, y2 double")
    got = {r["k"]: r["feature"] for r in pictures.kit_features(df, ["k"], "p", "w", side=0).collect()}
    crops = {"shirt": shirt, "noisy": noisy, "green": green, "half": half, "tiny": tiny}
    for k, p in crops.items():
        h, w = p.shape[:2]
        left, right, top, bottom = int(0.2 * (w - 1)), (w - 1) - int(0.2 * (w - 1)), int(0.08 * (h - 1)), int(0.48 * (h - 1))
        want = plain_feature(p[top:bottom, left:right]) if bottom > top and right > left else None
        assert (got[k] is None) == (want is None), k
        assert want is None or np.allclose(got[k], want), k
    assert got["green"] is None and got["tiny"] is None and got["null"] is None and got["empty"] is None and got["outside"] is None
    scaled = {r["k"]: r["feature"] for r in pictures.kit_features(df, ["k"], "p", "w").collect()}
    assert np.allclose(scaled["shirt"], got["shirt"]) and abs(np.linalg.norm(scaled["noisy"]) - 1) < 1e-6


def test_colour_columns_are_the_arrays(spark):
    rng = np.random.default_rng(9)
    colours = rng.integers(0, 256, (200, 3)).tolist() + [[0, 0, 0], [7, 7, 7]]
    df = spark.createDataFrame([tuple(c) for c in colours], "r int, g int, b int")
    h, s, v = pictures.hue_saturation_value(F.col("r"), F.col("g"), F.col("b"))
    for row in df.select("r", "g", "b", h, s, v).collect():
        assert tuple(row)[3:] == tuple(pictures.rgb_to_hsv(np.array([row[:3]], np.uint8))[0].tolist())
