"""Errors of a predicted series, by segment and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error(predicted: str, truth: str, wrap: bool = False) -> Column:
    """The difference; with ``wrap``, of angles in degrees, within half a turn."""
    e = F.col(predicted) - F.col(truth)
    return F.pmod(e + 180.0, F.lit(360.0)) - 180.0 if wrap else e


def errors(df: DataFrame, keys: list[str], predicted: str, truth: str, wrap: bool = False) -> DataFrame:
    """n, rmse and mae by ``keys``."""
    e = error(predicted, truth, wrap)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def segment_errors(df: DataFrame, keys: list[str], segment: str, predicted: str, truth: str, least: int) -> DataFrame:
    """Segments of at least ``least`` rows with n, rmse and mae, and their key's overall error, by segment and by row."""
    by = errors(df, [*keys, segment], predicted, truth).where(F.col("n") >= least)
    w = Window.partitionBy(*keys)
    square = F.col("rmse") * F.col("rmse")
    return by.select(
        *keys,
        segment,
        "n",
        F.round("rmse", 6).alias("rmse"),
        F.round("mae", 6).alias("mae"),
        F.round(F.sqrt(F.avg(square).over(w)), 6).alias("overall_by_segment"),
        F.round(F.sqrt(F.sum(square * F.col("n")).over(w) / F.sum("n").over(w)), 6).alias("overall_by_row"),
    )


def within_share(value: Column, limits: list[float]) -> list[Column]:
    """Percentages of rows whose absolute value is below each limit."""
    return [(100 * F.avg((F.abs(value) < x).cast("double"))).alias(f"within_{x:g}") for x in limits]
