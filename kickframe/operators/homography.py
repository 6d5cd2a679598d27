"""Robust homographies: minimal samples, consensus, and a least-squares fit to the points that agree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Points of a group from which samples are drawn, samples drawn at once, and those tried on the whole group.
POOL, TRIALS, FINALISTS = 48, 64, 16
#: Samples are drawn until all were wrong with so small a probability (its logarithm), but no more than so many.
LOG_MISSED, MOST = -30.0, 1 << 14
_MATRIX = "h array<double>"
#: Sums over the points that make the normal equations: products of (x, y, 1) with each of 1, u, v and u^2 + v^2.
_PRODUCTS = [(i, j) for i in range(3) for j in range(i, 3)]
_WEIGHTS = ("one", "u", "v", "uv")


def _normalised(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points around 0 at a mean distance of the root of 2, the matrices that make them so), for stacks of point sets."""
    centre = points.mean(axis=-2, keepdims=True)
    away = np.sqrt(((points - centre) ** 2).sum(axis=-1)).mean(axis=-1)
    scale = np.sqrt(2) / np.where(away > 0, away, 1.0)
    t = np.zeros((*scale.shape, 3, 3))
    t[..., 0, 0] = t[..., 1, 1] = scale
    t[..., 0, 2], t[..., 1, 2], t[..., 2, 2] = -scale * centre[..., 0, 0], -scale * centre[..., 0, 1], 1
    return (points - centre) * scale[..., None, None], t


def _flat(points: np.ndarray) -> np.ndarray:
    """Whether three of the four points of each set lie on a line."""
    out = np.zeros(len(points), bool)
    for i, j, k in combinations(range(4), 3):
        a, b = points[:, j] - points[:, i], points[:, k] - points[:, i]
        size = np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))
        out |= np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) <= 1e-6 * np.maximum(size, 1e-12)
    return out


def solve_samples(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The matrices, of last entry 1, that take each of the stacked sets of four points to its target; sets that have none are left out."""
    good = ~(_flat(source) | _flat(target))
    if not good.any():
        return np.zeros((0, 9))
    (a, ta), (b, tb) = _normalised(source[good]), _normalised(target[good])
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], -1), np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], -1)], -2)
    h = np.linalg.svd(rows.reshape(len(a), 8, 9))[2][:, -1].reshape(-1, 3, 3)
    h = (np.linalg.inv(tb) @ h @ ta).reshape(-1, 9)
    h = h[np.abs(h[:, 8]) > 1e-12 * np.abs(h).max(axis=1)]
    return h / h[:, 8:]


@lru_cache(maxsize=4096)
def _samples(n: int, trials: int, seed: int, turn: int) -> np.ndarray:
    """Which four of ``n`` points each sample of a turn takes."""
    return np.random.default_rng((seed, turn)).random((trials, n)).argpartition(3, axis=1)[:, :4]


def _agreeing(h: np.ndarray, points: np.ndarray, pixels: float) -> tuple[np.ndarray, np.ndarray]:
    """How many points each matrix takes to within ``pixels`` of their targets, and the summed error of these."""
    x, y, u, v = points.T
    part = lambda i: h[:, i, None] * x + h[:, i + 1, None] * y + h[:, i + 2, None]
    with np.errstate(all="ignore"):
        w = part(6)
        error = (part(0) / w - u) ** 2 + (part(3) / w - v) ** 2
        near = (np.abs(w) >= 1e-12) & (error <= pixels * pixels)
    return near.sum(axis=1), np.where(near, error, 0.0).sum(axis=1)


def _promising(points: np.ndarray, trials: int, pixels: float, seed: int) -> np.ndarray:
    """The matrices of samples on which most points of a pool agree, best first.

    Samples are drawn in turns of ``trials`` until one without a wrong point is all but certain, going by the share of
    the pool that agrees with the best so far: a pool with many wrong points gets more. Of few points all sets are taken.
    """
    n = len(points)
    sets = n * (n - 1) * (n - 2) * (n - 3) // 24
    best, drawn, turn = (np.zeros((0, 9)), np.zeros(0), np.zeros(0)), 0, 0
    while drawn < min(sets, MOST):
        picked = np.array(list(combinations(range(n), 4))) if sets <= trials else _samples(n, trials, seed, turn)
        h = solve_samples(points[picked][..., :2], points[picked][..., 2:])
        h = h[np.isfinite(h).all(axis=1)]
        drawn, turn = drawn + len(picked), turn + 1
        if len(h):
            both = [np.concatenate(c) for c in zip(best, (h, *_agreeing(h, points, pixels)), strict=True)]
            order = np.lexsort((both[2], -both[1]))[:FINALISTS]
            best = tuple(c[order] for c in both)
            right = min(1.0, (max(best[1][0], 4) / n) ** 4)
            if right == 1.0 or drawn * log1p(-right) <= LOG_MISSED:
                break
    return best[0]


def _hypotheses(pools: DataFrame, keys: list[str], trials: int, pixels: float, seed: int) -> DataFrame:
    """(keys, hs): the most promising matrices of each group's samples."""
    schema = StructType([*[pools.schema[k] for k in keys], *StructType.fromDDL("hs array<array<double>>").fields])
    arrow = to_arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for pool in batch.column(len(keys)).to_pylist():
                points = np.array([(p["x"], p["y"], p["u"], p["v"]) for p in pool])
                made.append(_promising(points, trials, pixels, seed).tolist() if len(points) > 3 else [])
            columns = [c.cast(f.type) for c, f in zip(batch.columns[: len(keys)], arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow.field("hs").type)], schema=arrow)

    return pools.select(*keys, "pool").mapInArrow(solve, schema)


def off_by(h: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    """Squared distance of the point's image from its target, infinite on the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    safe = F.when(F.abs(w) < 1e-12, F.lit(None)).otherwise(w)
    du, dv = (h[0] * x + h[1] * y + h[2]) / safe - u, (h[3] * x + h[4] * y + h[5]) / safe - v
    return F.coalesce(du * du + dv * dv, F.lit(float("inf")))


def _refit(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h): least squares from the normal equations of normalised points."""
    schema = StructType([*[sums.schema[k] for k in keys], *StructType.fromDDL(_MATRIX).fields])
    arrow = to_arrow_schema(schema)
    names = sums.columns[len(keys) :]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.select(names).to_pylist():
                block = {}
                for w in _WEIGHTS:
                    block[w] = np.zeros((3, 3))
                    for i, j in _PRODUCTS:
                        block[w][i, j] = block[w][j, i] = row[f"{w}_{i}{j}"]
                s, u, v, uv, o = block["one"], block["u"], block["v"], block["uv"], np.zeros((3, 3))
                normal = np.block([[s, o, -u], [o, s, -v], [-u, -v, uv]])
                h = np.linalg.eigh(normal)[1][:, 0].reshape(3, 3)
                t = lambda m: np.array([[m[2], 0, -m[2] * m[0]], [0, m[2], -m[2] * m[1]], [0, 0, 1]])
                h = np.linalg.inv(t([row["mu"], row["mv"], row["st"]])) @ h @ t([row["mx"], row["my"], row["ss"]])
                made.append((h / h[2, 2]).reshape(-1).tolist() if abs(h[2, 2]) > 1e-12 * np.abs(h).max() else None)
            columns = [c.cast(f.type) for c, f in zip(batch.columns[: len(keys)], arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow.field("h").type)], schema=arrow)

    return sums.mapInArrow(solve, schema)


def fit(points: DataFrame, keys: list[str], id_col: str, source: tuple[str, str] = ("x", "y"), target: tuple[str, str] = ("u", "v"), pixels: float = 5.0, trials: int = TRIALS, pool: int = POOL, seed: int = 7) -> DataFrame:
    """(keys, n, inliers, h): per group the homography from ``source`` to ``target`` on which most points agree.

    Samples of four are drawn from the ``pool`` points of least seeded hash, ``trials`` at a time, until one without
    a wrong point is all but certain (or MOST were drawn); the FINALISTS matrices that most of the pool agrees with are
    tried on *all* points of the group, and the one that takes most of them to within ``pixels`` wins (ties: the least
    summed error, then the better in the pool). ``h`` is the least-squares fit to these points, nine numbers in rows
    with the last 1. Trying and fitting are sums that Spark adds up before its shuffles, so a group may be of
    any size. Points with a null coordinate do not count; fewer than four points, or points on a line, give a
    null ``h`` and no inliers. Rows whose key is null belong to no group.
    """
    named = dict(zip(("x", "y", "u", "v"), (*source, *target), strict=True))
    rows = points.select(*keys, F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(n) for n, c in named.items()])
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    whole = rows.where("x IS NOT NULL AND y IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL")
    counts = rows.groupBy(*keys).agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull(), 1)).alias("n"))
    drawn = F.xxhash64(F.lit(seed), "__id")
    ranked = whole.withColumn("__h", drawn).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "x", "y", "u", "v"))).where(F.col("__r") <= pool)
    pools = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__r", "x", "y", "u", "v"))).alias("pool"))
    hypotheses = _hypotheses(pools, keys, trials, pixels, seed)
    tried = whole.join(hypotheses, keys).select(*keys, "x", "y", "u", "v", F.posexplode("hs").alias("trial", "h"))
    error = off_by(F.col("h"), *[F.col(c) for c in "xyuv"])
    near = error <= pixels * pixels
    scores = tried.groupBy(*keys, "trial").agg(F.sum(near.cast("long")).alias("inliers"), F.sum(F.when(near, error).otherwise(F.lit(0.0))).alias("error"))
    best = scores.groupBy(*keys).agg(F.max_by(F.struct("trial", "inliers"), F.struct("inliers", -F.col("error"), -F.col("trial"))).alias("b"))
    chosen = best.join(hypotheses, keys).select(*keys, F.col("b")["inliers"].alias("inliers"), F.element_at("hs", F.col("b")["trial"] + 1).alias("sample"))
    agreed = whole.join(chosen, keys).where(off_by(F.col("sample"), *[F.col(c) for c in "xyuv"]) <= pixels * pixels)
    spread = lambda a, b: F.sqrt(2 / F.greatest(F.var_pop(a) + F.var_pop(b), F.lit(1e-300)))
    norms = agreed.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), spread("x", "y").alias("ss"), spread("u", "v").alias("st"))
    scaled = agreed.select(*keys, "x", "y", "u", "v").join(norms, keys)
    p = [(F.col("x") - F.col("mx")) * F.col("ss"), (F.col("y") - F.col("my")) * F.col("ss"), F.lit(1.0)]
    u, v = (F.col("u") - F.col("mu")) * F.col("st"), (F.col("v") - F.col("mv")) * F.col("st")
    weights = dict(zip(_WEIGHTS, (F.lit(1.0), u, v, u * u + v * v), strict=True))
    sums = [F.sum(weights[w] * p[i] * p[j]).alias(f"{w}_{i}{j}") for w in _WEIGHTS for i, j in _PRODUCTS]
    normal = scaled.groupBy(*keys).agg(*sums, *[F.max(c).alias(c) for c in ("mx", "my", "mu", "mv", "ss", "st")])
    found = chosen.select(*keys, "inliers").join(_refit(normal, keys), keys)
    return counts.join(found, keys, "left").select(*keys, "n", F.coalesce("inliers", F.lit(0)).alias("inliers"), "h")
