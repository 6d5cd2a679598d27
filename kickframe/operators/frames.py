"""Detections of a frame: which to keep, which to take, and how many were left out for which reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discounted(conf: Column, x: Column, y: Column, at_x: Column, at_y: Column, reach: float = 150.0, factor: float = 0.3) -> Column:
    """``conf``, less where the place is farther than ``reach`` from the expected one; a null expectation changes nothing."""
    far = F.hypot(x - at_x, y - at_y) > reach
    return F.when(far, conf * factor).otherwise(conf)


def best_ball(df: DataFrame, frame: str, kind: str, conf: str, expected: tuple[str, str] | None = None, box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), first: str = "id", wanted: str = "ball", least: float = 0.0, width: float = 1280.0, height: float = 720.0, share: float = 0.02) -> DataFrame:
    """The rows of ``df`` that are the best ball of their frame, with the confidence they won by in ``score``.

    Only rows of the class ``wanted`` with ``least`` confidence that cover at most ``share`` of the picture count;
    confidence far from the ``expected`` place is discounted; of equal ones the first in ``first`` wins.
    """
    x1, y1, x2, y2 = (F.col(c) for c in box)
    rows = df.where((F.col(kind) == wanted) & (F.col(conf) >= least) & ((x2 - x1) * (y2 - y1) <= width * height * share))
    score = F.col(conf)
    if expected is not None:
        score = discounted(score, (x1 + x2) / 2, (y1 + y2) / 2, F.col(expected[0]), F.col(expected[1]))
    ranked = rows.withColumn("score", score)
    best = Window.partitionBy(frame).orderBy(F.desc("score"), first)
    return ranked.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def on_pitch(df: DataFrame, x: str, y: str, slack: float) -> DataFrame:
    """The rows on the unit pitch or up to ``slack`` beside it, the latter moved to its edge."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    near = F.col(x).between(-slack, 1 + slack) & F.col(y).between(-slack, 1 + slack)
    return df.where(near).withColumns({x: clip(x), y: clip(y)})


def skip_counts(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(reason, n): rows by the first reason that applies to them, ``kept`` for those without one."""
    reason = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in reasons.items()], F.lit("kept"))
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def sampled(index: Column, value: Column, every: int) -> Column:
    """``value`` on each row whose ``index`` is a multiple of ``every``, null between."""
    return F.when(F.pmod(index, F.lit(every)) == 0, value)


def thin_negatives(df: DataFrame, index: str, detected: str, every: int = 3) -> DataFrame:
    """All rows with a detection, and of the others those whose index is a multiple of ``every``."""
    return df.where(F.col(detected) | (F.pmod(F.col(index), F.lit(every)) == 0))


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """``df`` with columns rounded, exact halves to the even digit."""
    return df.withColumns({c: F.bround(F.col(c), n) for c, n in places.items()})


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """(rows a second, seconds left)."""
    rate = done / seconds
    return rate, F.when(rate > 0, (total - done) / rate)


def bootstrap_ready(df: DataFrame, key: list[str], order: list[str], features: str, frames: int = 250, least: int = 60) -> DataFrame:
    """ready: whether ``frames`` rows and ``least`` features have come so far."""
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("ready", (F.count("*").over(so_far) >= frames) & (F.sum(features).over(so_far) >= least))


def stem(path: Column) -> Column:
    """A path's last part without its last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def stem_join(left: DataFrame, right: DataFrame, left_path: str, right_path: str, how: str = "inner") -> DataFrame:
    """Rows of two sets of files that have one stem, in ``stem``."""
    return left.withColumn("stem", stem(F.col(left_path))).join(right.withColumn("stem", stem(F.col(right_path))), "stem", how)


def single(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key no other row has."""
    times = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("__times", times).where("__times = 1").drop("__times")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order; each task keeps its own ``n``, so nothing is sorted whole."""
    return df.orderBy(*order).limit(n)
