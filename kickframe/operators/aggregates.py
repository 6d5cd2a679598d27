"""Grouped summaries: centroids, weighted means, histograms, picks, majority maps."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroid(df: DataFrame, key: list[str], x: str, y: str, keep: Column | None = None) -> DataFrame:
    """n, cx and cy of a group's points, of those with ``keep`` if given."""
    use = F.lit(True) if keep is None else keep
    return df.groupBy(*key).agg(F.count_if(use).alias("n"), F.avg(F.when(use, F.col(x))).alias("cx"), F.avg(F.when(use, F.col(y))).alias("cy"))


def trimmed_centroid(df: DataFrame, key: list[str], x: str, y: str, tie: list[str], vx: str, fast: float = 3.0) -> DataFrame:
    """The centroid of groups of more than three without the leftmost point, unless it moves left fast, nor the rightmost, unless it moves right fast."""
    w = Window.partitionBy(*key)
    ranked = df.withColumns({"__l": F.row_number().over(w.orderBy(x, *tie)), "__r": F.row_number().over(w.orderBy(F.desc(x), *[F.desc(t) for t in tie])), "__n": F.count("*").over(w)})
    cut = (F.col("__n") > 3) & (((F.col("__l") == 1) & (F.col(vx) >= -fast)) | ((F.col("__r") == 1) & (F.col(vx) <= fast)))
    return ranked.where(~cut).groupBy(*key).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def gaussian_centroid(df: DataFrame, key: list[str], x: str, y: str, sigma: float) -> DataFrame:
    """Means weighted by a Gaussian of the distance from the exact medians."""
    w = Window.partitionBy(*key)
    centred = df.withColumns({"__mx": F.percentile(x, F.lit(0.5)).over(w), "__my": F.percentile(y, F.lit(0.5)).over(w)})
    dx, dy = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    weighted = centred.withColumn("__w", F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)))
    total = F.sum("__w")
    return weighted.groupBy(*key).agg((F.sum(F.col("__w") * F.col(x)) / total).alias("cx"), (F.sum(F.col("__w") * F.col(y)) / total).alias("cy"))


def weighted_mean(df: DataFrame, key: list[str], weight: str, value: str) -> DataFrame:
    return df.groupBy(*key).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("weighted"))


def spread(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """n, mean, population deviation and greatest value."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("most"))


def share_below(df: DataFrame, key: list[str], value: str, limit: float) -> DataFrame:
    return df.groupBy(*key).agg(F.avg((F.col(value) < limit).cast("double")).alias("share"))


def size_gradient(df: DataFrame, key: list[str], place: str, size: str) -> DataFrame:
    """Mean size left of the mean place less that of the rest, 0 for an empty side."""
    placed = df.withColumn("__m", F.avg(place).over(Window.partitionBy(*key)))
    left = F.col(place) < F.col("__m")
    return placed.groupBy(*key).agg((F.coalesce(F.avg(F.when(left, F.col(size))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~left, F.col(size))), F.lit(0.0))).alias("gradient"))


def extreme_rows(df: DataFrame, key: list[str], by: str, tie: list[str], value: str, target: float) -> DataFrame:
    """The ``value`` of the row with the greatest ``by`` and that nearest to ``target``, the first in ``tie`` of equals."""
    order = F.struct(*[-F.col(t) for t in tie])
    nearest = F.struct(F.abs(F.col(value) - target).alias("d"), *tie)
    return df.groupBy(*key).agg(F.max_by(value, F.struct(by, order.alias("o"))).alias("largest"), F.min_by(value, nearest).alias("nearest"))


def thirds(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Counts in three equal bins between a group's least and greatest value; one bin if they are equal."""
    w = Window.partitionBy(*key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = df.withColumn("__s", (F.col(value) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))
    s = F.col("__s")
    return scaled.groupBy(*key).agg(F.count_if(s < 1 / 3).alias("left_third"), F.count_if((s >= 1 / 3) & (s < 2 / 3)).alias("mid_third"), F.count_if(s >= 2 / 3).alias("right_third"))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def top_std(df: DataFrame, key: list[str], order: list[Column], value: str, k: int) -> DataFrame:
    """Population deviation of ``value`` over a group's first ``k`` rows, 0 for one."""
    return top_k(df, key, order, k).groupBy(*key).agg(F.stddev_pop(value).alias("top_std"))


def histogram_density(df: DataFrame, key: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities of equal bins; the last includes its right edge, values outside are left out."""
    inside = df.where(F.col(value).between(low, high))
    bucket = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*key, bucket.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key))
    return counts.withColumn("density", F.col("n") / (total * ((high - low) / bins)))


def matrix(df: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """One row per ``row`` with a column for each of ``columns``, their mean and how many are there; NaN counts as missing."""
    clean = df.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    wide = clean.groupBy(row).pivot(column, columns).agg(F.first(value))
    cells = F.array(*[F.col(f"`{c}`") for c in columns])
    there = F.filter(cells, lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))
    return wide.withColumn("mean", mean).withColumn("valid", F.size(there).cast("bigint"))


def mapping_accuracy(df: DataFrame, predicted: str, gold: str, k: int) -> DataFrame:
    """The best share of rows that one-to-one renaming of ``k`` predicted classes gets right, and the first renaming that does."""
    counts = df.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    plans = [(i, p, g) for i, perm in enumerate(permutations(range(k))) for p, g in enumerate(perm)]
    table = df.sparkSession.createDataFrame(plans, "plan int, p int, g int")
    hits = F.broadcast(table).join(counts, (F.col("p") == F.col(predicted)) & (F.col("g") == F.col(gold)), "left")
    by_plan = hits.groupBy("plan").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    total = df.agg(F.count("*").alias("total"))
    best = by_plan.agg(F.max_by(F.struct("plan", "hits"), F.struct("hits", -F.col("plan"))).alias("b"))
    return best.join(total, how="cross").select(F.col("b.plan").alias("plan"), (F.col("b.hits") / F.col("total")).alias("accuracy"))


def recordings(df: DataFrame, key: Column, name: str, size: str, modified: str, least: float) -> DataFrame:
    """Files grouped by key: first change, total size, whether it is a test clip (less than ``least``) and the files by name."""
    grouped = df.withColumn("sequence", key).groupBy("sequence").agg(F.min(modified).alias("recorded_at"), F.sum(size).alias("total"), F.sort_array(F.collect_list(F.struct(name, size))).alias("files"))
    return grouped.withColumn("test_clip", F.col("total") < least)


def column_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: the correlation of each feature with the target."""
    return df.agg(*[F.corr(f, target).alias(f"corr_{f}") for f in features])
