"""Raster masks as runs of set pixels: made from polygons, looked up and measured without a pixel being listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUNS = "array<struct<a:int,b:int>>"


def row_runs(poly: Column, y: Column, width: int) -> Column:
    """The pixel runs (array of struct(a, b), both ends included, in order and apart) that a polygon sets in row ``y``.

    ``poly`` is an array of struct(x, y) of whole numbers. A pixel is set if its centre is inside by the even-odd
    rule, or on the outline. Crossings are whole numbers or quotients of such, so their rounding is exact.
    """
    turned = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))
    edges = F.zip_with(poly, turned, lambda p, q: F.struct(p["x"].cast("double").alias("x0"), p["y"].alias("y0"), q["x"].cast("double").alias("x1"), q["y"].alias("y1")))
    across = F.filter(edges, lambda e: (e["y0"] <= y) != (e["y1"] <= y))
    at = F.array_sort(F.transform(across, lambda e: e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.when(e["y1"] == e["y0"], F.lit(None)).otherwise(e["y1"] - e["y0"])))

    def pairs(xs: Column) -> Column:
        run = lambda i: F.struct(F.ceil(F.get(xs, 2 * i)).cast("int").alias("a"), F.floor(F.get(xs, 2 * i + 1)).cast("int").alias("b"))
        return F.when(F.size(xs) > 1, F.transform(F.sequence(F.lit(0), (F.size(xs) / 2).cast("int") - 1), run)).otherwise(F.array().cast(_RUNS))

    inner = F.element_at(F.transform(F.array(at), pairs), 1)
    # what only touches the row: corners, level edges, and where edges cross it at a whole number
    touching = F.filter(edges, lambda e: (F.least(e["y0"], e["y1"]) <= y) & (y <= F.greatest(e["y0"], e["y1"])))

    def touch(e: Column) -> Column:
        x = e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.when(e["y1"] == e["y0"], F.lit(None)).otherwise(e["y1"] - e["y0"])
        a, b = F.coalesce(x, F.least(e["x0"], e["x1"])), F.coalesce(x, F.greatest(e["x0"], e["x1"]))
        return F.struct(F.ceil(a).cast("int").alias("a"), F.floor(b).cast("int").alias("b"))

    clipped = lambda r: F.struct(F.greatest(r["a"], F.lit(0)).alias("a"), F.least(r["b"], F.lit(width - 1)).alias("b"))
    found = F.concat(inner, F.transform(touching, touch))
    runs = F.array_sort(F.filter(F.transform(found, clipped), lambda r: r["a"] <= r["b"]))

    def join_up(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))
        apart = (F.size(acc) == 0) | (r["a"] > last["b"] + 1)
        return F.when(apart, F.concat(acc, F.array(r))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(runs, F.array().cast(_RUNS), join_up)


def mask_runs(polygons: DataFrame, keys: list[str], poly: str, width: int, height: int) -> DataFrame:
    """(keys, y, a, b): the runs of each polygon's mask; a null polygon, or one of fewer than three corners, has no mask and no rows."""
    corners = F.transform(poly, lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    rows = polygons.where(F.size(poly) >= 3).select(*keys, corners.alias("__poly"))
    low, high = F.array_min(F.transform("__poly", lambda p: p["y"])), F.array_max(F.transform("__poly", lambda p: p["y"]))
    first, last = F.greatest(low, F.lit(0)), F.least(high, F.lit(height - 1))
    rows = rows.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    return rows.select(*keys, "y", F.explode(row_runs(F.col("__poly"), F.col("y"), width)).alias("r")).select(*keys, "y", "r.a", "r.b")


def pixel_of(v: Column, size: int, rounded: bool = True) -> Column:
    """The pixel of a coordinate: the nearest (halves to even) or the one it lies in, kept within the picture."""
    whole = F.bround(v) if rounded else v
    return F.least(F.greatest(whole, F.lit(0)), F.lit(size - 1)).cast("int")


def keep_in_mask(points: DataFrame, masks: DataFrame, keys: list[str], x: str, y: str, width: int, height: int, rounded: bool = True) -> DataFrame:
    """The rows of ``points`` whose pixel is set in the mask of their keys; where a key has no mask all rows stay.

    ``masks`` are runs. A point meets the few runs of its own row, so points of one key are dealt by row. A null
    coordinate is in no mask; null keys have none.
    """
    runs = masks.select(*keys, F.col("y").alias("__y"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    placed = points.withColumns({"__py": pixel_of(F.col(y), height, rounded), "__px": pixel_of(F.col(x), width, rounded)})
    own = [placed[k] == runs[k] for k in keys]
    hit = placed.join(runs, [*own, placed["__py"] == runs["__y"], placed["__px"] >= runs["__a"], placed["__px"] <= runs["__b"]], "left_semi")
    free = placed.join(masks.select(*keys).distinct(), keys, "left_anti")
    return hit.unionByName(free.select(hit.columns)).drop("__py", "__px")


def mask_view(masks: DataFrame, keys: list[str], width: int, height: int, least: int = 50, coverage_weight: float = 0.45, center_weight: float = 0.55) -> DataFrame:
    """(keys, coverage, offset, score): the share of set pixels, how far their mean lies from the middle (0 to about 1, the mean of
    both axes) and a score of both; fewer than ``least`` pixels give offset 1 and score 0."""
    n = F.col("b") - F.col("a") + 1
    sums = masks.groupBy(*keys).agg(F.sum(n).alias("__n"), F.sum((F.col("a") + F.col("b")) * n / 2).alias("__sx"), F.sum(F.col("y") * n).alias("__sy"))
    off = lambda s, size: F.abs(F.col(s) / F.col("__n") - size / 2) / (size / 2)
    seen = F.col("__n") >= least
    coverage, offset = F.col("__n") / float(width * height), F.when(seen, 0.5 * (off("__sx", width) + off("__sy", height))).otherwise(F.lit(1.0))
    score = F.when(seen, coverage_weight * coverage + center_weight * F.greatest(F.lit(0.0), 1 - offset)).otherwise(F.lit(0.0))
    return sums.select(*keys, coverage.alias("coverage"), offset.alias("offset"), score.alias("score"))


def tile_coverage(tiles: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """``tiles`` (keys, x1, y1, x2, y2, ends not included) with the share of their pixels that is set; null where a key has no mask."""
    runs = masks.select(*keys, F.col("y").alias("__y"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    rows = tiles.withColumn("__y", F.explode(F.sequence("y1", F.col("y2") - 1)))
    inside = F.greatest(F.lit(0), F.least(F.col("x2") - 1, F.col("__b")) - F.greatest(F.col("x1"), F.col("__a")) + 1)
    box = [*keys, "x1", "y1", "x2", "y2"]
    counts = rows.join(runs, [*keys, "__y"]).groupBy(*box).agg(F.sum(inside).alias("__n"))
    known = masks.select(*keys).distinct().withColumn("__masked", F.lit(True))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    found = tiles.join(known, keys, "left").join(counts, box, "left")
    return found.withColumn("coverage", F.when(F.col("__masked"), F.coalesce("__n", F.lit(0)) / area)).drop("__n", "__masked")
