"""Geometry as column expressions: views, angles, boxes, polygons, curves."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def clamp_around(x: Column, centre: Column, most: float) -> Column:
    """``x`` kept within ``most`` of a centre."""
    return clamp(x, centre - most, centre + most)


def soft_step(now: Column, target: Column, most: float) -> Column:
    """Move towards the target by at most ``most``."""
    return now + clamp(target - now, -most, most)


def pixel_to_lon(px: Column, width: float, yaw: Column, fov_deg: float) -> Column:
    """Longitude in degrees of a pixel column of a flat view."""
    n = (px - width / 2) / (width / 2)
    return F.degrees(F.atan(n * F.tan(F.radians(F.lit(fov_deg / 2))))) + yaw


def pixel_to_lat(py: Column, width: float, height: float, pitch: Column, fov_deg: float) -> Column:
    """Latitude in degrees, the half angle scaled by the aspect before its tangent."""
    n = (py - height / 2) / (height / 2)
    return F.degrees(F.atan(n * F.tan(F.radians(F.lit(fov_deg / 2)) * (height / width)))) + pitch


def eq_pan_tilt(px: Column, py: Column, width: float, height: float, pan: Column, tilt: Column, fov_deg: float) -> tuple[Column, Column]:
    """Pan and tilt in degrees of a pixel, the vertical tangent being the horizontal one divided by the aspect."""
    t = F.tan(F.radians(F.lit(fov_deg / 2)))
    nx, ny = (px / width - 0.5) * 2, (py / height - 0.5) * 2
    return pan + F.degrees(F.atan(nx * t)), tilt - F.degrees(F.atan(ny * t * (height / width)))


def angular_size(w: Column, width: float, fov_deg: float) -> Column:
    """Degrees that ``w`` pixels in the middle of the view span."""
    return 2 * F.degrees(F.atan(w / width * F.tan(F.radians(F.lit(fov_deg / 2)))))


def unit_vector(lon: Column, lat: Column) -> Column:
    """struct(x, y, z) of angles in degrees; z points at (0, 0), x right, y up."""
    a, b = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(b) * F.sin(a)).alias("x"), F.sin(b).alias("y"), (F.cos(b) * F.cos(a)).alias("z"))


def project(v: Column, yaw: float, pitch: float, fov_deg: float, width: float, height: float) -> tuple[Column, Column]:
    """Pixel of a unit vector in a view, nulls behind it."""
    cy, sy = F.cos(F.radians(F.lit(yaw))), F.sin(F.radians(F.lit(yaw)))
    cp, sp = F.cos(F.radians(F.lit(pitch))), F.sin(F.radians(F.lit(pitch)))
    x, z1 = v["x"] * cy - v["z"] * sy, v["x"] * sy + v["z"] * cy
    y, z = v["y"] * cp - z1 * sp, v["y"] * sp + z1 * cp
    f = (width / 2) / F.tan(F.radians(F.lit(fov_deg / 2)))
    ahead = z > 1e-6
    return F.when(ahead, width / 2 + f * x / z), F.when(ahead, height / 2 - f * y / z)


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def point_in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Ray casting; lower edges count as inside, upper ones do not."""
    turned = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))
    crossed = F.zip_with(
        poly,
        turned,
        lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(None)).otherwise(b["y"] - a["y"]) + a["x"]),
    )
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def in_or_on_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Whether a point is inside a polygon or on its outline."""
    turned = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))

    def on(a: Column, b: Column) -> Column:
        level = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return level & (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))

    return F.exists(F.zip_with(poly, turned, on), lambda hit: hit) | point_in_polygon(x, y, poly)


def studio_to_view(pan: Column, tilt: Column, fov: Column, tilt_scale: float = 1.20, fov_scale: float = 1.85) -> tuple[Column, Column, Column]:
    """Pan, tilt and field of view of a flat view for those of a studio project, whose pan runs the other way."""
    return -pan, tilt * tilt_scale, fov * fov_scale


def half_ellipses(far: Column, left: Column, right: Column, near: Column, width: int, height: int, n_far: int = 7, n_near: int = 11, droop: float = 0.068, scale: float = 1.0) -> Column:
    """The pitch as array of struct(x, y) in whole pixels, within the picture: a far line that droops at its ends and a near one
    that bends, both half ellipses over the same axis. ``n_far`` points from left to right, then the near ones from right to
    left without its ends."""
    middle, a = F.floor((left + right) / 2), (right - left) / 2 * scale
    low, high = a * droop, (near - far) * scale
    angle = lambda k, n: k.cast("double") * math.pi / (n - 1)
    within = lambda v, n: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(n - 1))
    point = lambda x, y: F.struct(within(x, width).alias("x"), within(y, height).alias("y"))
    top = F.transform(F.sequence(F.lit(0), F.lit(n_far - 1)), lambda k: point(middle - a * F.cos(angle(k, n_far)), far + low * F.cos(angle(k, n_far)) * F.cos(angle(k, n_far))))
    bottom = F.transform(F.sequence(F.lit(1), F.lit(n_near - 2)), lambda k: point(middle + a * F.cos(angle(k, n_near)), far + high * F.sin(angle(k, n_near))))
    return F.concat(top, bottom)


def in_circle(px: Column, py: Column, cx: Column, cy: Column, radius: float) -> Column:
    return (px - cx) * (px - cx) + (py - cy) * (py - cy) <= radius * radius


def near_bezier(px: Column, py: Column, p0: Column, c: Column, p1: Column, reach: float, steps: int = 20) -> Column:
    """Whether one of ``steps`` + 1 points along a quadratic curve, given by structs (x, y), is within ``reach``."""
    at = lambda k: k.cast("double") / steps
    off = lambda k: (F.pow(bezier(p0["x"], c["x"], p1["x"], at(k)) - px, 2) + F.pow(bezier(p0["y"], c["y"], p1["y"], at(k)) - py, 2))
    return F.exists(F.sequence(F.lit(0), F.lit(steps)), lambda k: off(k) <= reach * reach)


def homography(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """A point through a row-major 3x3 matrix; null on the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) < 1e-12, F.lit(None)).otherwise(w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def iou_floored(a: Column, b: Column, least_area: float, more: float = 0.0) -> Column:
    """Intersection over union of boxes whose areas count as ``least_area`` at least, with ``more`` added to the union; 0 without an intersection.

    Trackers take boxes of one pixel at least (1.0), suppression adds 1e-9 to the union, votes do both with 1e-9.
    """
    both = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda c: F.greatest(F.lit(float(least_area)), (c["x2"] - c["x1"]) * (c["y2"] - c["y1"]))
    union = area(a) + area(b) - both + more
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2), 0 when both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = w * h
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def bezier(p0: Column, c: Column, p1: Column, t: Column) -> Column:
    """One coordinate of a quadratic curve."""
    return (1 - t) * (1 - t) * p0 + 2 * (1 - t) * t * c + t * t * p1


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    d2 = dx * dx + dy * dy
    t = F.when(d2 == 0, F.lit(0.0)).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / F.when(d2 == 0, F.lit(1.0)).otherwise(d2), 0, 1))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def in_ellipse(px: Column, py: Column, cx: Column, cy: Column, rx: float, ry: float) -> Column:
    nx, ny = (px - cx) / rx, (py - cy) / ry
    return nx * nx + ny * ny <= 1


def in_cone(px: Column, py: Column, cx: Column, cy: Column, angle: float, length: float, width: float) -> Column:
    """Within ``length`` and half of ``width`` radians of the direction ``angle``."""
    dx, dy = px - cx, py - cy
    turn = F.atan2(dy, dx) - angle
    wrapped = F.atan2(F.sin(turn), F.cos(turn))
    return (F.sqrt(dx * dx + dy * dy) <= length) & (F.abs(wrapped) <= width / 2)


def edge_distance(x: Column, width: float) -> Column:
    """0 in the middle, 1 at the edge."""
    return F.abs(x - width / 2) / (width / 2)


def polygon_view(ys: Column, height: float, studio: float = 1.2, wide: float = 1.85) -> tuple[Column, Column]:
    """(tilt, field of view) from the polygon's heights: the first seven are the far line, the rest the near one."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    tilt = lambda v: (0.5 - v / height) * 180
    far, near = tilt(mean(F.slice(ys, 1, 7))), tilt(mean(F.slice(ys, 8, F.size(ys))))
    return (far + near) / 2 * studio, clamp(F.abs(far - near) * wide, 100, 130)


def depth_share(y: Column, low: Column, high: Column) -> Column:
    """Place of ``y`` between two bounds, a half if they are equal."""
    return F.when(high == low, F.lit(0.5)).otherwise(clamp((y - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low), 0, 1))


def scale_between(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear scale, clamped on both sides."""
    return clamp(to_low + (x - low) / (high - low) * (to_high - to_low), min(to_low, to_high), max(to_low, to_high))
