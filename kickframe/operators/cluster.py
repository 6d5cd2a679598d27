"""Clusters on a line and nearest centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dbscan_pairs(df: DataFrame, key: list[str], x: str, order: list[str], eps: float | Column) -> DataFrame:
    """Density clusters with two points as the least: stretches without a gap above ``eps``; cluster is -1 for a point alone."""
    w = Window.partitionBy(*key).orderBy(x, *order)
    island = F.sum(F.coalesce((F.col(x) - F.lag(x).over(w) > eps).cast("bigint"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = df.withColumn("__i", island)
    alone = F.count("*").over(Window.partitionBy(*key, "__i")) == 1
    return placed.withColumn("cluster", F.when(alone, F.lit(-1)).otherwise(F.col("__i")).cast("bigint")).drop("__i")


def dbscan_line(df: DataFrame, key: list[str], x: str, order: list[str], eps: float, least: int) -> DataFrame:
    """Density clusters on a line: points with ``least`` within ``eps``, themselves included, are cores; cores without
    a gap above ``eps`` are a cluster, other points join the cluster of the nearest core within ``eps``, the lower of equals."""
    group = Window.partitionBy(*key)
    w, back = group.orderBy(x, *order), group.orderBy(F.desc(x), *[F.desc(o) for o in order])
    # a core has ``least`` neighbours in order that hold it and lie within eps; frames by range or to the end cost the square of a group
    held = [(F.lag(x, i).over(w) if i else F.col(x), F.lead(x, least - 1 - i).over(w) if i < least - 1 else F.col(x)) for i in range(least)]
    core = F.lit(least < 1)
    for low, high in held:
        core = core | ((low >= F.col(x) - eps) & (high <= F.col(x) + eps))
    cored = df.withColumn("__core", F.coalesce(core, F.lit(False)) & F.col(x).isNotNull())
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    cored = cored.withColumn("__before", F.last(F.when(F.col("__core"), F.col(x)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.col("__core") & (F.col("__before").isNull() | (F.col(x) - F.col("__before") > eps))
    cored = cored.withColumn("__c", F.sum(start.cast("bigint")).over(so_far))
    own = F.when(F.col("__core"), F.struct(F.col(x).alias("x"), F.col("__c").alias("c")))
    lower = F.last(own, ignorenulls=True).over(so_far)
    upper = F.last(own, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    placed = cored.withColumns({"__lo": lower, "__hi": upper})
    dl, dh = F.col(x) - F.col("__lo.x"), F.col("__hi.x") - F.col(x)
    far = F.lit(float("inf"))
    dl, dh = F.coalesce(dl, far), F.coalesce(dh, far)
    cluster = F.when((dl <= dh) & (dl <= eps), F.col("__lo.c")).when(dh <= eps, F.col("__hi.c")).otherwise(F.lit(0)) - 1
    return placed.withColumn("cluster", cluster.cast("bigint")).drop("__core", "__before", "__c", "__lo", "__hi")


def scores(df: DataFrame, key: list[str], x: str, size: str, order: str) -> DataFrame:
    """Per key and cluster: n, centre, mean size, first input row, and the scores by spread, by height and by count."""
    by = df.where("cluster >= 0").groupBy(*key, "cluster").agg(F.count("*").alias("n"), F.avg(x).alias("centre"), F.stddev_pop(x).alias("std"), F.avg(size).alias("mean_size"), F.sum(size).alias("total"), F.min(order).alias("first"))
    return by.withColumns({"by_spread": F.col("n") / (F.col("std") + 1), "by_height": F.col("total"), "by_count": F.col("n").cast("double")})


def best(df: DataFrame, key: list[str], x: str, size: str, order: str, score: str, least: int) -> DataFrame:
    """The best cluster of each key with ``least`` points, the earliest of equals; without one the mean of all, as a cluster of one."""
    scored = scores(df, key, x, size, order).where(F.col("n") >= least)
    w = Window.partitionBy(*key).orderBy(F.desc(score), "first")
    top = scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*key, F.col("centre").alias("__c"), F.col("n").alias("__k"), F.col("mean_size").alias("__h"))
    everyone = df.groupBy(*key).agg(F.avg(x).alias("__mx"), F.avg(size).alias("__mh"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"))
    joined = everyone.join(top, key, "left")
    return joined.select(*key, F.coalesce("__c", "__mx").alias("centre"), F.coalesce("__k", F.lit(1)).cast("bigint").alias("size"), F.coalesce("__h", "__mh").alias("mean_size"), "n_clusters")


def sweep(df: DataFrame, key: list[str], x: str, size: str, order: str, eps: list[float], score: str, least: int, full: bool = False) -> DataFrame:
    """``best`` for every eps, one row per key with a centre and a size for each; with ``full`` also the mean size of its members and the number of clusters."""
    tried = df.withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in eps])))
    found = best(dbscan_pairs(tried, [*key, "eps"], x, [order], F.col("eps")), [*key, "eps"], x, size, order, score, least)
    wide = found.groupBy(*key).pivot("eps", [float(e) for e in eps]).agg(F.first("centre").alias("c"), F.first("size").alias("s"), F.first("mean_size").alias("m"), F.first("n_clusters").alias("n"))
    parts = (("c", "centre"), ("s", "size"), ("m", "mean_size"), ("n", "n_clusters"))
    cols = [F.col(f"`{float(e)}_{p}`").alias(f"{n}_eps{e:g}") for e in eps for p, n in parts[: 4 if full else 2]]
    return wide.select(*key, *cols)


def replicate(df: DataFrame, key: list[str], weight: str, most: int = 3) -> DataFrame:
    """Each row as often as its weight's share of the group's greatest, times ``most``, rounded down, plus one."""
    top = F.max(weight).over(Window.partitionBy(*key))
    times = (F.floor(F.col(weight) / top * most) + 1).cast("int")
    return df.withColumn("__times", times).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest_centre(df: DataFrame, feature: str, centres: list[list[float]], most: float = 6.0, least_margin: float = 0.05) -> DataFrame:
    """label, d0 and margin to the second: the nearest of a few constant centres, null if too far or not clearly nearer."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    ranked = F.array_sort(F.transform(table, lambda c, i: F.struct(F.sqrt(squared_distance(F.col(feature), c)).alias("d"), i.alias("i"))))
    near = df.withColumn("__r", ranked)
    d0, margin = F.col("__r")[0]["d"], F.col("__r")[1]["d"] - F.col("__r")[0]["d"]
    return near.withColumns({"d0": d0, "margin": margin, "label": F.when((d0 <= most) & (margin >= least_margin), F.col("__r")[0]["i"])}).drop("__r")


def lloyd(df: DataFrame, feature: str, centres: list[list[float]], rounds: int = 35, tolerance: float = 1e-4) -> list[list[float]]:
    """Centres after Lloyd's rounds with unit-norm means from given ones; an empty cluster keeps its centre.

    Each round is one aggregation of sums per cluster and place; only the k centres come to the driver.
    """
    for _ in range(rounds):
        placed = nearest_centre(df, feature, centres, float("inf"), float("-inf")).select("label", F.posexplode(feature).alias("at", "v"))
        sums = placed.groupBy("label", "at").agg(F.avg("v").alias("v")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("m")).collect()
        new = [list(c) for c in centres]
        for row in sums:
            mean = [p["v"] for p in row["m"]]
            norm = sum(v * v for v in mean) ** 0.5 or 1.0
            new[row["label"]] = [v / norm for v in mean]
        moved = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for x, y in zip(new, centres, strict=True))
        centres = new
        if moved < tolerance:
            break
    return centres


def seed_centres(df: DataFrame, id_col: str, feature: str, k: int, seed: int = 0) -> list[list[float]]:
    """``k`` rows as first centres, each drawn with a probability proportional to its squared distance from those before.

    A draw is a race: a row's time is exponential with its weight as rate, made of the seed, the round and its id, and the
    first row wins (equal times: the smaller id). So each draw is one aggregation, the same however rows lie in tasks;
    only the winners come to the driver. Null features are not drawn; with fewer distinct rows than ``k`` there are fewer.
    """
    rows = df.where(F.col(feature).isNotNull())
    centres: list[list[float]] = []
    for turn in range(k):
        if centres:
            table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
            weight = F.array_min(F.transform(table, lambda c: squared_distance(F.col(feature), c)))
        else:
            weight = F.lit(1.0)
        uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), F.col(id_col)), 11) + 0.5) / float(1 << 53)
        race = rows.select(F.col(id_col).alias("id"), F.col(feature).alias("f"), weight.alias("w"), (-F.log(uniform)).alias("e")).where("w > 0")
        won = race.agg(F.min_by("f", F.struct(F.col("e") / F.col("w"), "id")).alias("f")).first()["f"]
        if won is None:
            break
        centres.append([float(v) for v in won])
    return centres
