"""Annotation shapes: sizes by depth, edits, ends of clips, and shapes that refer to others."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _between(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def depth(y: Column, far: Column | None = None, near: Column | None = None) -> Column:
    """0 at the far side to 1 at the near one: of a calibrated pitch between ``far`` and ``near``, a half if that is flat; else of the frame."""
    if far is None or near is None:
        return _between(y, 0.0, 1.0)
    return F.coalesce(F.when(near > far, _between((y - far) / (near - far), 0.0, 1.0)), F.lit(0.5))


def perspective_radius(t: Column) -> tuple[Column, Column]:
    """Radii of a highlight by depth. 0.016 to 0.042 across, 0.032 to 0.068 down."""
    return F.lit(0.016) + (0.042 - 0.016) * t, F.lit(0.032) + (0.068 - 0.032) * t


def curve_control(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    return (ax + bx) / 2, (ay + by) / 2


def cone(ax: Column, ay: Column, bx: Column, by: Column, width: Column) -> tuple[Column, Column, Column]:
    """(angle, length, width) of a cone drawn from a to b: at least 0.03 long, 0.15 to 0.9 pi wide."""
    return F.atan2(by - ay, bx - ax), F.greatest(F.hypot(bx - ax, by - ay), F.lit(0.03)), _between(width, 0.15, 0.9 * math.pi)


def radius(r: Column) -> Column:
    return F.greatest(r, F.lit(0.015))


def moved(points: Column, dx: Column, dy: Column) -> Column:
    """An array of structs (x, y) with an offset added to each."""
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def quick_end(now: Column, mark_in: Column) -> Column:
    """The end of a clip marked by hand: now, if more than a second has passed, else null."""
    return F.when(now > mark_in + 1, now)


def recorder_end(mark_in: Column, elapsed: Column, offset: Column) -> Column:
    return F.greatest(mark_in + 1, mark_in + elapsed + offset)


def clip_defaults(mark_in: Column, context: Column, removed: Column, end: Column) -> tuple[Column, Column, Column]:
    """Context start, end of the annotation and end of the clip, where they were not given."""
    return F.coalesce(context, F.greatest(mark_in - 2, F.lit(0))), F.coalesce(removed, mark_in + 1.5), F.coalesce(end, mark_in + 5)


def connected(shapes: DataFrame, key: list[str], shape_id: str = "id", kind: str = "type", from_id: str = "from_id", to_id: str = "to_id", place: str = "pos") -> DataFrame:
    """(key, id, start, end) of each connector whose two highlights exist."""
    ends = shapes.where(F.col(kind) == "highlight")
    side = lambda ref, name: ends.select(*key, F.col(shape_id).alias(ref), F.col(place).alias(name))
    links = shapes.where(F.col(kind) == "connector").select(*key, shape_id, from_id, to_id)
    return links.join(side(from_id, "start"), [*key, from_id]).join(side(to_id, "end"), [*key, to_id]).select(*key, shape_id, "start", "end")


def nearest_in_reach(clicks: DataFrame, shapes: DataFrame, key: list[str], click_id: str, shape_id: str, width: float, height: float) -> DataFrame:
    """(key, click, shape, distance): for each click (x, y) the nearest highlight (x, y, rx, ry) of its frame that reaches it.

    A highlight reaches 1.8 times its greater radius and 20 pixels; of equal ones, to a billionth of a pixel,
    the first id is taken. Clicks without one are left out. A frame's clicks meet its own highlights only.
    """
    c = clicks.select(*key, click_id, (F.col("x") * width).alias("__cx"), (F.col("y") * height).alias("__cy"))
    reach = F.greatest(F.col("rx") * width, F.col("ry") * height) * 1.8 + 20
    s = shapes.select(*key, shape_id, (F.col("x") * width).alias("__sx"), (F.col("y") * height).alias("__sy"), reach.alias("__reach"))
    met = c.join(s, key).withColumn("distance", F.round(F.hypot(F.col("__sx") - F.col("__cx"), F.col("__sy") - F.col("__cy")), 9)).where("distance <= __reach")
    best = F.min(F.struct("distance", shape_id)).alias("b")
    return met.groupBy(*key, click_id).agg(best).select(*key, click_id, F.col(f"b.{shape_id}").alias(shape_id), F.col("b.distance").alias("distance"))


def topmost(hits: Column) -> Column:
    """The id of the last of an array of struct(id, hit) that is hit, which is drawn above the others; null if none is."""
    return F.try_element_at(F.filter(hits, lambda h: h["hit"]), F.lit(-1))["id"]
