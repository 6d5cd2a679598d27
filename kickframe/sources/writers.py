"""Writers of the application's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str], append: bool = False) -> None:
    """Columns in a fixed order, with a header in each part."""
    df.select(*columns).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def pan_log(df: DataFrame, path: str) -> None:
    """Times and angles with four decimals, confidence with three, nulls as empty fields."""
    fixed = lambda c, n: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", c)).otherwise(F.lit("")).alias(c)
    out = df.select(fixed("timestamp_s", 4), fixed("predicted_pan_deg", 4), "mode", fixed("ball_conf", 3))
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def summary_json(clips: DataFrame, path: str) -> None:
    """One JSON object per approach with its clips by name, from (approach, clip, segments, overall_rmse, overall_mae)."""
    entry = F.struct("clip", F.struct("segments", "overall_rmse", "overall_mae"))
    whole = clips.groupBy("approach").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("clips"))
    whole.write.mode("overwrite").json(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def calibration(polygon: Column) -> Column:
    """A calibration document of a polygon of (x, y) points."""
    return F.to_json(F.struct(F.transform(polygon, lambda p: F.array(F.round(p["x"]).cast("int"), F.round(p["y"]).cast("int"))).alias("pitch_polygon")))


def normalised(polygon: Column, width: float, height: float) -> Column:
    """Points as shares of the frame with four decimals; null for fewer than three."""
    shares = F.transform(polygon, lambda p: F.struct(F.round(p["x"] / width, 4).alias("x"), F.round(p["y"] / height, 4).alias("y")))
    return F.when(F.size(polygon) >= 3, shares)


def in_pixels(polygon: Column, width: float, height: float) -> Column:
    """Shares of the frame as whole pixels; null for fewer than three points."""
    points = F.transform(polygon, lambda p: F.struct(F.round(p["x"] * width).cast("int").alias("x"), F.round(p["y"] * height).cast("int").alias("y")))
    return F.when(F.size(polygon) >= 3, points)
