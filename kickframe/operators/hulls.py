"""Convex hulls as a mergeable aggregate, and polygons of the whole sphere as seen in a flat view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kickframe.functions.geometry import project, unit_vector

#: Tasks over which the partial hulls of one group are dealt before they meet.
SPREAD = 32


def _corners(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The hull of distinct points in order."""
    if len(rows) < 3:
        return rows

    def chain(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return chain(rows)[:-1] + chain(rows[::-1])[:-1]


def hull_of(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of (x, y) rows, counter-clockwise in axes with y up, from the least x, y on; no point between two others on a line."""
    return np.array(_corners(list(map(tuple, np.unique(points, axis=0).tolist()))))


def _partial(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hull points of each run of equal keys, batch by batch; hulls of hulls are hulls."""
    arrow = to_arrow_schema(rows.schema)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for k in range(len(keys)):
                column = pc.dictionary_encode(batch.column(k), null_encoding="encode")
                codes = np.unique(codes * (len(column.dictionary) + 1) + column.indices.to_numpy(), return_inverse=True)[1]
            x, y = (batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.lexsort((y, x, codes))
            codes, x, y = codes[order], x[order], y[order]
            fresh = np.r_[True, (codes[1:] != codes[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            order, codes, points = order[fresh], codes[fresh], list(zip(x[fresh].tolist(), y[fresh].tolist(), strict=True))
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist()
            which, found = [], []
            for a, b in zip(starts, [*starts[1:], len(points)], strict=True):
                hull = _corners(points[a:b])
                which += [order[a]] * len(hull)
                found += hull
            owners = pa.array(which, pa.int64())
            columns = [c.take(owners) for c in batch.columns[: len(keys)]] + [pa.array(v, pa.float64()) for v in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(reduce, rows.schema)


def convex_hull(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", spread: int = SPREAD) -> DataFrame:
    """(keys, hull array of struct(x, y)): the corners of each group's convex hull in counter-clockwise order (y up), from the least x, y on.

    Each task reduces what it reads to hulls, these are dealt over ``spread`` tasks a group and reduced again, and
    only what is left of them meets, so a group may be of any size. Points with a null or non-finite coordinate do
    not count, repeated ones once; groups without points are left out, one or two points are their own hull.
    Null keys are a group of their own.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = points.where(finite(x) & finite(y)).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    dealt = _partial(rows, keys).repartition(*keys, F.pmod(F.xxhash64("__x", "__y"), F.lit(spread)))
    met = _partial(dealt, keys).groupBy(*keys).agg(F.collect_list(F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"))).alias("hull"))
    schema = StructType([*[met.schema[k] for k in keys], *StructType.fromDDL("hull array<struct<x:double,y:double>>").fields])
    arrow = to_arrow_schema(schema)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            x, y = (c.to_pylist() for c in lists.flatten().flatten())
            ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
            hulls = [_corners(sorted(set(zip(x[a:b], y[a:b], strict=True)))) for a, b in zip([0, *ends], ends, strict=False)]
            corners = pa.StructArray.from_arrays([pa.array([p[i] for h in hulls for p in h], pa.float64()) for i in (0, 1)], ["x", "y"])
            offsets = pa.array(np.cumsum([0, *map(len, hulls)]), pa.int32())
            columns = [*batch.columns[: len(keys)], pa.ListArray.from_arrays(offsets, corners)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return met.mapInArrow(close, schema)


def densify(poly: Column, width: float, samples: int = 50) -> Column:
    """Points along the edges of a closed polygon (array of struct(x, y)) on a picture that joins at its sides, ``samples`` to an
    edge and each edge the shorter way around; x within the width."""
    turned = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))

    def edge(a: Column, b: Column) -> Column:
        dx = b["x"] - a["x"]
        to = F.when(F.abs(dx) <= width / 2, b["x"]).when(dx > 0, b["x"] - width).otherwise(b["x"] + width)
        at = lambda k: F.struct(F.pmod(a["x"] + k / samples * (to - a["x"]), F.lit(width)).alias("x"), (a["y"] + k / samples * (b["y"] - a["y"])).alias("y"))
        return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: at(k.cast("double")))

    return F.when(F.size(poly) > 0, F.flatten(F.zip_with(poly, turned, edge))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def visible_outline(polygons: DataFrame, keys: list[str], poly: str, yaw: float, pitch: float, fov_deg: float, size: tuple[float, float] = (2880.0, 1440.0), view: tuple[float, float] = (960.0, 540.0), samples: int = 50) -> DataFrame:
    """(keys, outline array of struct(x, y)): the convex hull of what of a polygon's outline a flat view shows, in whole pixels.

    The polygon is given in pixels of a picture of the whole sphere; its edges are followed in ``samples`` steps,
    across the seam where that is shorter, and what lies behind the view is dropped. The scene is turned by the
    angles, so the view looks the other way. Fewer than three visible points give null.
    """
    width, height = size
    rows = polygons.select(*keys, F.explode_outer(densify(F.col(poly), width, samples)).alias("__p"))
    v = unit_vector((F.col("__p")["x"] / width - 0.5) * 360, (0.5 - F.col("__p")["y"] / height) * 180)
    sx, sy = project(v, -yaw, -pitch, fov_deg, *view)
    seen = rows.select(*keys, sx.alias("x"), sy.alias("y"))
    counts = seen.groupBy(*keys).agg(F.count("x").alias("__n"))
    corners = F.transform("hull", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    hulls = convex_hull(seen, keys).select(*keys, corners.alias("outline"))
    return counts.join(hulls, keys, "left").select(*keys, F.when(F.col("__n") >= 3, F.col("outline")).alias("outline"))
