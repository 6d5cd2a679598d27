"""Joins, set operations and row changes of the application tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_nested(left: DataFrame, right: DataFrame, on: Column, name: str, columns: list[str]) -> DataFrame:
    """``left`` with the right side's columns as a struct, null where nothing matches."""
    marked = right.withColumn("__there", F.lit(True))
    joined = left.join(marked, on, "left")
    return joined.select(*[left[c] for c in left.columns], F.when(F.col("__there"), F.struct(*[right[c] for c in columns])).alias(name))


def left_or_only(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): ``left`` with the right side's value; if ``left`` is empty, the right side as it is."""
    joined = left.select(key).join(right.select(key, value), key, "left")
    some = left.limit(1).select(F.lit(1).alias("__some"))
    alone = right.select(key, value).join(F.broadcast(some), F.lit(True), "left_anti")  # at most one row
    return joined.unionByName(alone)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows in the place of old ones with the same key; of several new ones the last by ``version`` counts."""
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("version")))).where("__n = 1").drop("__n", "version")
    return old.join(last, key, "left_anti").unionByName(last.select(old.columns))


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str], sets: str | None = None) -> DataFrame:
    """``old`` with the columns that a change of its key sets. A null in the change leaves the column, unless ``sets`` names
    an array column of the change with the columns it sets: these become what the change has, null included."""
    named = F.col(sets) if sets else F.lit(None).cast("array<string>")
    renamed = changes.select(F.col(key).alias("__key"), named.alias("__sets"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(renamed, old[key] == F.col("__key"), "left")
    new = lambda c: F.when(F.array_contains("__sets", c), F.col(f"__{c}")).otherwise(F.col(c) if sets else F.coalesce(f"__{c}", c))
    return joined.select(*[new(c).alias(c) if c in columns else F.col(c) for c in old.columns])


def insert_sorted(items: Column, item: Column, by: str) -> Column:
    """An array of structs, sorted by a field, with one more in its place: after those of an equal field; a null one is not put in."""
    placed = F.concat(F.filter(items, lambda x: x[by] <= item[by]), F.array(item), F.filter(items, lambda x: x[by] > item[by]))
    return F.when(item.isNull() | item[by].isNull(), items).otherwise(F.coalesce(placed, F.array(item)))


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def listed(rows: DataFrame, link: DataFrame, key: str, ids: str) -> DataFrame:
    """Rows that a link lists, or all of them if its list is empty or null."""
    some = link.where(F.size(F.coalesce(ids, F.array())) > 0)
    named = rows.join(some.select(F.explode(ids).alias(key)).distinct(), key, "left_semi")
    open_link = link.where(F.size(F.coalesce(ids, F.array())) == 0).limit(1)
    return named.unionByName(rows.join(F.broadcast(open_link.select(F.lit(1).alias("__all"))), F.lit(True), "left_semi")).distinct()


def visible(rows: DataFrame, roles: DataFrame, user: str, coach_only: Column) -> DataFrame:
    """Rows that may be seen: those for coaches only by users that are coach or admin."""
    staff = roles.where(F.col("role").isin("coach", "admin")).select(F.col(user).alias("__staff")).distinct()
    joined = rows.join(staff, rows[user] == F.col("__staff"), "left")
    return joined.where(~coach_only | F.col("__staff").isNotNull()).drop("__staff")


def unexpired(links: DataFrame, expires: str, now: Column) -> DataFrame:
    return links.where(F.coalesce(F.col(expires) >= now, F.lit(True)))


def cascade_delete(shapes: Column, gone: Column) -> Column:
    """An array of shapes without one and without the connectors that refer to it."""
    refers = lambda s: F.coalesce(s["fromId"] == gone, F.lit(False)) | F.coalesce(s["toId"] == gone, F.lit(False))
    return F.filter(shapes, lambda s: (s["id"] != gone) & ~refers(s))


def next_number(shapes: Column) -> Column:
    """One more than the greatest number among the shapes, 1 without any."""
    numbers = F.transform(F.filter(shapes, lambda s: s["type"] == "number"), lambda s: s["value"])
    return F.coalesce(F.array_max(numbers), F.lit(0)) + 1


def first_success(df: DataFrame, key: list[str], order: str, value: str, ok: Column, fallback: str) -> DataFrame:
    """The first candidate in order that is ``ok``, else the fallback, flagged."""
    picked = df.groupBy(*key).agg(F.min_by(F.when(ok, F.col(value)), F.when(ok, F.col(order))).alias("__v"))
    return picked.select(*key, F.coalesce("__v", F.lit(fallback)).alias("choice"), F.col("__v").isNull().alias("fallback"))


def best_of_grid(df: DataFrame, grid: DataFrame, key: list[str], score: Column, tie: list[str]) -> DataFrame:
    """For each key the grid row with the best score, the first in ``tie`` of equals; the grid is a small constant table."""
    scored = df.crossJoin(F.broadcast(grid)).withColumn("score", score)
    w = Window.partitionBy(*key).orderBy(F.desc("score"), *tie)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def warm_start(scans: DataFrame, key: list[str], yaw: str, ball: tuple[str, str], players: str, cluster_x: str, fov_deg: float, width: float, sure: float = 0.60, near: float = 0.4, least: int = 4) -> DataFrame:
    """(key, start): where to look first, by scans of several directions.

    The first direction (by ``yaw``) with a ball of confidence ``sure`` nearer to the middle than ``near`` of half the width
    gives the angle of that ball; else, of the directions with ``least`` players and a cluster, the one with the
    most players times the cluster's nearness to the middle gives the cluster's (ties: the greater angle); else 0.
    ``ball`` are the columns of its place and confidence; nulls are not seen.
    """
    half = width / 2
    angle = lambda x: F.col(yaw) + F.degrees(F.atan((x - half) / half * F.tan(F.radians(F.lit(fov_deg / 2)))))
    x, conf, cluster = F.col(ball[0]), F.col(ball[1]), F.col(cluster_x)
    seen = (conf >= sure) & (F.abs(x - half) / half < near)
    score = F.col(players) * (1 - F.abs(cluster - half) / half)
    crowd = (F.col(players) >= least) & cluster.isNotNull()
    # structs are grouped by sorting: in shuffle partitions of bounded size, not where a small file was exploded
    found = scans.repartition(*key).groupBy(*key).agg(
        F.min_by(F.when(seen, angle(x)), F.when(seen, F.col(yaw))).alias("__ball"),
        F.max(F.when(crowd, F.struct(score.alias("score"), angle(cluster).alias("at")))).alias("__crowd"),
    )
    return found.select(*key, F.coalesce("__ball", "__crowd.at", F.lit(0.0)).alias("start"))


def improved(tried: DataFrame, key: list[str], now: str, score: str, coverage: str, offset: str, choice: list[str], order: list[str], least_coverage: float = 0.18, most_offset: float = 0.22) -> DataFrame:
    """(key, choice): the view of each key, moved only where it is called for.

    ``tried`` has a row for the present view (``now`` true) and one for each other that was looked at. Where the present
    one covers less than ``least_coverage`` or is off by more than ``most_offset``, the best other view is taken if its
    score is greater, the first in ``order`` of equals; else the present one stays.
    """
    is_now, picked = F.col(now), F.struct(*choice)
    # greatest score first, NaN above all as Spark and SQL have it, then the order
    rank = F.struct(~F.isnan(score), -F.col(score), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    other = ~is_now & F.col(score).isNotNull()
    poor = (F.col(coverage) < least_coverage) | (F.col(offset) > most_offset)
    # one grouping without a join: a side's size, often made by explode, can't be told and would be broadcast
    seen = tried.repartition(*key).groupBy(*key).agg(
        F.max(F.when(is_now, F.struct(picked.alias("own"), F.col(score).alias("score"), poor.alias("poor")))).alias("__now"),
        F.max(F.when(other, F.col(score))).alias("__top"),
        F.min_by(F.when(other, picked), F.when(other, rank)).alias("__other"),
    )
    chosen = F.when(F.col("__now.poor") & (F.col("__top") > F.col("__now.score")), F.col("__other")).otherwise(F.col("__now.own"))
    return seen.where("__now IS NOT NULL").select(*key, chosen.alias("__c")).select(*key, "__c.*")
