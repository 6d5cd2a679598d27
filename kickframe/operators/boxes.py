"""Boxes of a frame: filters, suppression, tiles and the two-pass plan. Boxes are structs (x1, y1, x2, y2, conf, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.geometry import box_area, iou

#: Boxes in order of confidence, flat, for lambdas are interpreted and pay for each level; of a null box ``some`` is false.
_HELD = "array<struct<c:double,i:bigint,some:boolean,x1:double,y1:double,x2:double,y2:double,area:double>>"


def with_derived(df: DataFrame) -> DataFrame:
    """cx, cy, foot_y, w, h and area of boxes given by columns x1, y1, x2, y2."""
    w, h = (F.greatest(F.lit(0.0), F.col(b) - F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2")))
    return df.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "foot_y": F.col("y2"), "w": w, "h": h, "area": w * h})


def large_enough(area: Column, cy: Column, width: float, height: float, far: float = 8e-5, near: float = 5e-4, power: float = 2.0) -> Column:
    """Whether a box's share of the view reaches a limit that grows towards the bottom."""
    depth = F.pow(F.least(F.greatest(cy / height, F.lit(0.0)), F.lit(1.0)), power)
    return area / (width * height) >= far + (near - far) * depth


def small_enough(area: Column, width: float, height: float, share: float = 0.02) -> Column:
    return area <= width * height * share


def foot_at_bottom(area: Column, cy: Column, width: float, height: float) -> Column:
    """A large box at the very bottom."""
    return (cy > 0.9 * height) & (area > 0.001 * width * height)


def pairs_iou(df: DataFrame, frame: str, box: str, id_col: str) -> DataFrame:
    """(frame, a, b, iou) of the pairs of a frame that overlap, a < b.

    A frame's boxes are gathered once and each meets those after it; memory goes by the boxes of a frame, not by its pairs.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(box).alias("b"))))
    whole = [F.col(box)[c].isNotNull() for c in ("x1", "y1", "x2", "y2")]
    by = df.where(reduce(Column.__and__, whole, F.col(frame).isNotNull() & F.col(id_col).isNotNull())).groupBy(frame).agg(listed.alias("__all"))
    first = by.select(frame, "__all", F.posexplode("__all").alias("__at", "__a"))
    both = first.select(frame, "__a", F.explode(F.slice("__all", F.col("__at") + 2, F.size("__all"))).alias("__b"))
    p, q = F.col("__a.b"), F.col("__b.b")
    pairs = both.where(_meet(p, q) & (F.col("__a.id") < F.col("__b.id")))
    return pairs.select(frame, F.col("__a.id").alias("a"), F.col("__b.id").alias("b"), _iou_met(p, q).alias("iou"))


def _shared(a: Column, b: Column, axis: str) -> Column:
    return F.least(a[f"{axis}2"], b[f"{axis}2"]) - F.greatest(a[f"{axis}1"], b[f"{axis}1"])


def _meet(a: Column, b: Column) -> Column:
    w, h = _shared(a, b, "x"), _shared(a, b, "y")
    return (w > 0) & (h > 0) & (w * h > 0)


def _iou_met(a: Column, b: Column) -> Column:
    """``iou`` of boxes that meet: a few operations, where the general one is too long a method to be compiled."""
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    both = _shared(a, b, "x") * _shared(a, b, "y")
    return both / (area(a) + area(b) - both)


def _close(a: Column, b: Column, share: float) -> Column:
    """Centres nearer than a share of the smaller height, which counts as one pixel at least."""
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    low = F.greatest(F.lit(1.0), F.least(a["y2"] - a["y1"], b["y2"] - b["y1"]))
    return F.sqrt(dx * dx + dy * dy) <= share * low


def _overlap(k: Column, s: Column, least: float) -> Column:
    """``iou`` of two held boxes of at least ``least``. A test by areas known before spares most pairs the division."""
    exact = iou(k, s) >= least
    if least <= 0:
        return exact
    w, h = (F.greatest(F.lit(0.0), _shared(k, s, c)) for c in "xy")
    # both / (sum - both) >= least; a difference, for NaN has to go on to the exact test
    return (w * h - (k["area"] + s["area"]) * (least / (1 + least) * (1 - 1e-9)) >= 0) & exact


def suppress(df: DataFrame, frame: str, box: str, least_iou: float = 0.55, centre_share: float | None = None) -> DataFrame:
    """(frame, kept): a frame's boxes that no kept box of higher confidence overlaps, or is too close to.

    Equal confidence goes by id. A fold over the frame's own boxes, all in Catalyst.
    """
    b, sides = F.col(box), ("x1", "y1", "x2", "y2")
    held = F.struct((-b["conf"]).alias("c"), b["id"].alias("i"), b.isNotNull().alias("some"), *(b[c] for c in sides), box_area(b).alias("area"))
    boxes = df.groupBy(frame).agg(F.sort_array(F.collect_list(held)).alias("boxes"))
    hit = lambda k, s: _overlap(k, s, least_iou) | (_close(k, s, centre_share) if centre_share is not None else F.lit(False))
    whole = lambda s: F.when(s["some"], F.struct(*(s[c].alias(c) for c in sides), (-s["c"]).alias("conf"), s["i"].alias("id")))
    kept = F.aggregate("boxes", F.array().cast(_HELD), lambda acc, s: F.when(F.exists(acc, lambda k: hit(k, s)), acc).otherwise(F.concat(acc, F.array(s))), lambda acc: F.transform(acc, whole))
    return boxes.select(frame, kept.alias("kept"))


def tile_starts(length: Column, tile: Column, overlap: float = 0.2, least_step: int = 32) -> Column:
    """Where tiles of a length begin so that they cover it, the last flush with the end."""
    step = F.greatest(F.lit(least_step), F.floor(tile * (1 - overlap)).cast("int"))
    last = F.greatest(F.lit(0), length - tile)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, step), F.array(last)))


def needs_second_pass(df: DataFrame, frame: str, area: str, width: float, height: float, few: int = 10, small: float = 0.0025) -> DataFrame:
    """(frame, second): whether a frame has few boxes or small ones in the median."""
    by = df.groupBy(frame).agg(F.count("*").alias("n"), F.percentile(area, F.lit(0.5)).alias("median"))
    return by.select(frame, ((F.col("n") < few) | (F.col("median") / (width * height) < small)).alias("second"))


__all__ = ["box_area", "foot_at_bottom", "large_enough", "needs_second_pass", "pairs_iou", "small_enough", "suppress", "tile_starts", "with_derived"]
