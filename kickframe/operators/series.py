"""Ordered operators on time series, in window functions: each takes the key, the order and the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def gap_sessions(df: DataFrame, key: list[str], time: Column, order: list[str], gap: float) -> DataFrame:
    """Number the sessions of a key from 0: a new one begins where ``time`` grew by more than ``gap``; adds session, session_start."""
    w = _w(key, order)
    flagged = df.withColumn("__t", time).withColumn("__new", F.coalesce((F.col("__t") - F.lag("__t").over(w)) > gap, F.lit(False)).cast("bigint"))
    numbered = flagged.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("session_start", F.min("__t").over(Window.partitionBy(*key, "session"))).drop("__t", "__new")


def first_difference(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """prev (0 on the first row) and velocity, the change from it."""
    prev = F.lag(value, 1, 0.0).over(_w(key, order))
    return df.withColumn("prev", prev).withColumn("velocity", F.col(value) - prev)


def rows_since(df: DataFrame, key: list[str], order: list[str], hit: Column, never: int) -> DataFrame:
    """rows_since: rows since the last hit, 0 on a hit; before the first, ``never`` plus the rows so far."""
    w = _w(key, order)
    numbered = df.withColumn("__i", F.row_number().over(w))
    last = F.last(F.when(hit, F.col("__i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("rows_since", F.coalesce(F.col("__i") - last, F.lit(never) + F.col("__i")).cast("bigint")).drop("__i")


def hit_streak(df: DataFrame, key: list[str], order: list[str], hit: Column, confirm: int) -> DataFrame:
    """streak: hits in a row up to here, 0 on a miss; trusted: whether a streak of ``confirm`` has ever been reached."""
    w = _w(key, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = df.withColumn("__miss", F.sum((~hit).cast("int")).over(so_far))
    streak = F.sum(hit.cast("bigint")).over(Window.partitionBy(*key, "__miss").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("streak", streak).withColumn("trusted", F.max(F.col("streak") >= confirm).over(so_far)).drop("__miss")


def hold_last(df: DataFrame, key: list[str], order: list[str], value: Column, name: str = "held") -> DataFrame:
    """The last value that is not null, up to here."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def majority_of_last(df: DataFrame, key: list[str], order: list[str], vote: str, last: int, min_votes: int, ratio: float) -> DataFrame:
    """majority: the most frequent of the last ``last`` non-null votes, null unless it has enough; of equals the one that came first.

    The frame is bounded, so what a row gathers is too.
    """
    voted = df.where(F.col(vote).isNotNull())
    votes = F.collect_list(vote).over(_w(key, order).rowsBetween(-(last - 1), 0))
    counted = voted.withColumn("__votes", votes).withColumn(
        "__best",
        F.array_max(
            F.transform(
                F.array_distinct("__votes"),
                lambda v: F.struct(F.size(F.filter("__votes", lambda x: x == v)).alias("n"), (-F.array_position("__votes", v)).alias("first"), v.alias("vote")),
            )
        ),
    )
    best = F.col("__best")
    enough = (best["n"] >= min_votes) & (best["n"] >= ratio * F.size("__votes"))
    return counted.withColumn("votes", F.size("__votes").cast("bigint")).withColumn("majority", F.when(enough, best["vote"])).drop("__votes", "__best")


def moving_average(df: DataFrame, key: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """smooth: the sum over the ``k`` rows around each, ends padded with zeros, by k; for even k one more row before than after."""
    frame = _w(key, order).rowsBetween(-(k // 2), (k - 1) // 2)
    return df.withColumn("smooth", F.sum(value).over(frame) / k)


def first_below_after(df: DataFrame, key: list[str], order: str, value: str, share: float) -> DataFrame:
    """Per key the first ``order`` at which ``value`` falls below ``share`` of its peak after having reached it; null if it never does."""
    peaked = df.withColumn("__limit", share * F.max(value).over(Window.partitionBy(*key)))
    was = F.max(F.col(value) >= F.col("__limit")).over(_w(key, [order]).rowsBetween(Window.unboundedPreceding, 0))
    return peaked.withColumn("__was", was).groupBy(*key).agg(F.min(F.when(F.col("__was") & (F.col(value) < F.col("__limit")), F.col(order))).alias("first_below"))


def last_matching(df: DataFrame, key: list[str], order: str, condition: Column) -> DataFrame:
    """Per key the last ``order`` with a condition, or null."""
    return df.groupBy(*key).agg(F.max(F.when(condition, F.col(order))).alias("last_match"))


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], time: str, value: str, name: str = "asof") -> DataFrame:
    """``left`` with the value of the last row of ``right`` not after it, by key, or null.

    Both sides go through one shuffle and one running window; nothing is paired. Of equal times on the
    right the greatest value counts.
    """
    right = right.groupBy(*key, time).agg(F.max(value).alias(name))
    cols = [c for c in left.columns]
    a = left.select(*cols, F.lit(None).cast(right.schema[name].dataType).alias(name), F.lit(1).alias("__side"))
    b = right.select(*[F.col(c) if c in (*key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(name), F.lit(0).alias("__side"))
    w = Window.partitionBy(*key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(name, F.last(name, ignorenulls=True).over(w)).where("__side = 1").drop("__side")


def nearest_within(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """The rows of ``left`` with a row of ``right`` closer in time than ``tolerance``: an equi join on buckets of that width."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    near = left.withColumn("__b", bucket(left_time))
    # the right side stands in three buckets, so a left row has one and stays as often as it is there
    marks = right.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(right_time).alias("__t"), F.explode(F.array(bucket(right_time) - 1, bucket(right_time), bucket(right_time) + 1)).alias("__rb"))
    same = (F.col("__b") == F.col("__rb")) & (F.abs(F.col(left_time) - F.col("__t")) < tolerance)
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return near.join(marks, same, "left_semi").drop("__b")


def interval_join(points: DataFrame, spans: DataFrame, key: list[str], time: str, start: str, end: str, width: float, closed: bool = False, how: str = "inner") -> DataFrame:
    """Points within spans ``[start, end)`` (``[start, end]`` if closed) of the same key.

    Spans are cut into buckets of ``width``, so the join is an equi join whose groups do not grow with the
    series; each point is in one bucket and meets each span once.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = spans.withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end))))
    for k in key:
        cut = cut.withColumnRenamed(k, f"__{k}")
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end)))
    same = (bucket(time) == F.col("__b")) & inside
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return points.join(cut, same, how).drop("__b", *[f"__{k}" for k in key])


def first_span(points: DataFrame, spans: DataFrame, key: list[str], id_col: str, time: str, start: str, end: str, width: float) -> DataFrame:
    """For each point the earliest-starting span that holds it, ends included."""
    met = interval_join(points, spans, key, time, start, end, width, closed=True)
    w = Window.partitionBy(id_col).orderBy(start, end)
    return met.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def crossings(positions: DataFrame, marks: DataFrame, key: list[str], order: list[str], time: str, mark: str, most: float, width: float) -> DataFrame:
    """Marks passed between neighbouring positions, ``prev < mark <= now``, where the step is positive and below ``most``."""
    steps = positions.withColumn("prev", F.lag(time).over(_w(key, order))).where((F.col(time) - F.col("prev") > 0) & (F.col(time) - F.col("prev") < most))
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = steps.withColumn("__b", F.explode(F.sequence(bucket("prev"), bucket(time))))
    right = marks.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(mark).alias("mark"), bucket(mark).alias("__rb"))
    same = (F.col("__b") == F.col("__rb")) & (F.col("mark") > F.col("prev")) & (F.col("mark") <= F.col(time))
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return cut.join(right, same).drop("__b", "__rb", *[f"__{k}" for k in key])


def first_crossings(positions: DataFrame, marks: DataFrame, key: list[str], order: list[str], time: str, mark: str, id_col: str, most: float, width: float) -> DataFrame:
    """(key, mark id, mark, order, time): each mark once, where it is passed first, however often a position goes back and passes it again."""
    steps = positions.withColumn("prev", F.lag(time).over(_w(key, order))).where((F.col(time) - F.col("prev") > 0) & (F.col(time) - F.col("prev") < most))
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = steps.select(*key, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.col(time).alias("__time"), "prev", F.explode(F.sequence(bucket("prev"), bucket(time))).alias("__b"))
    right = marks.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(id_col), F.col(mark).alias("__mark"), bucket(mark).alias("__rb"))
    same = (F.col("__b") == F.col("__rb")) & (F.col("__mark") > F.col("prev")) & (F.col("__mark") <= F.col("__time"))
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    firsts = F.min(F.struct(*[f"__o{i}" for i in range(len(order))], "__time")).alias("f")
    found = cut.join(right, same).groupBy(*key, id_col, "__mark").agg(firsts)
    return found.select(*key, id_col, F.col("__mark").alias(mark), *[F.col("f")[f"__o{i}"].alias(f"passed_{o}") for i, o in enumerate(order)], F.col("f")["__time"].alias("passed_at"))


def pchip_slopes(knots: DataFrame, key: list[str], t: str, y: str) -> DataFrame:
    """Monotone cubic pieces between neighbouring knots: (key, t0, t1, y0, y1, d0, d1, last).

    Weighted harmonic means inside, three-point ends that keep the shape, a straight line through two
    knots. A single knot makes no piece. Times are distinct within a key.
    """
    w = _w(key, ["t"])
    k = knots.select(*key, F.col(t).alias("t"), F.col(y).alias("y"))
    k = k.withColumns({"h": F.lead("t").over(w) - F.col("t"), "m": (F.lead("y").over(w) - F.col("y")) / (F.lead("t").over(w) - F.col("t"))})
    k = k.withColumns({"hp": F.lag("h").over(w), "mp": F.lag("m").over(w), "hn": F.lead("h").over(w), "mn": F.lead("m").over(w), "hpp": F.lag("h", 2).over(w), "mpp": F.lag("m", 2).over(w)})
    h, m, hp, mp = F.col("h"), F.col("m"), F.col("hp"), F.col("mp")
    w1, w2 = 2 * h + hp, h + 2 * hp
    inner = F.when(mp * m <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / mp + w2 / m))

    def end(h0: Column, m0: Column, h1: Column, m1: Column) -> Column:
        d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        steep = (F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0))
        return F.when(h1.isNull(), m0).when(F.signum(d) != F.signum(m0), F.lit(0.0)).when(steep, 3 * m0).otherwise(d)

    d = F.when(mp.isNull(), end(h, m, F.col("hn"), F.col("mn"))).when(m.isNull(), end(hp, mp, F.col("hpp"), F.col("mpp"))).otherwise(inner)
    k = k.withColumn("d", d)
    pieces = k.select(*key, F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.col("y").alias("y0"), F.lead("y").over(w).alias("y1"), F.col("d").alias("d0"), F.lead("d").over(w).alias("d1"), F.lead("t", 2).over(w).isNull().alias("last"))
    return pieces.where("t1 IS NOT NULL")


def hermite(x: Column) -> Column:
    """The cubic piece (t0, t1, y0, y1, d0, d1) at ``x``."""
    h = F.col("t1") - F.col("t0")
    u = (x - F.col("t0")) / h
    u2, u3 = u * u, u * u * u
    return (2 * u3 - 3 * u2 + 1) * F.col("y0") + (u3 - 2 * u2 + u) * h * F.col("d0") + (3 * u2 - 2 * u3) * F.col("y1") + (u3 - u2) * h * F.col("d1")


def pchip_at(samples: DataFrame, knots: DataFrame, key: list[str], x: str, t: str, y: str, name: str = "truth", outside: str = "drop") -> DataFrame:
    """``samples`` with the value interpolated between their key's knots.

    Samples outside of the knots are dropped, or kept: with ``outside`` as "clamp" they get the value of the nearest knot, with
    "null" none. A sample whose key has fewer than two knots has no value. The piece of a sample is the last that starts
    at or before it: an as-of join, so no pairing of ranges.
    """
    if outside != "drop":
        if outside not in ("clamp", "null"):
            raise ValueError("outside is drop, clamp or null")
        bounds = knots.groupBy(*key).agg(F.min(t).alias("__low"), F.max(t).alias("__high"))
        placed = samples.join(bounds, key, "left").withColumn("__x", F.least(F.greatest(F.col(x), "__low"), "__high"))
        pieces = pchip_slopes(knots, key, t, y).select(*key, F.col("t0").alias("__x"), F.struct("t0", "t1", "y0", "y1", "d0", "d1").alias("__piece"))
        met = asof_backward(placed, pieces, key, "__x", "__piece", "__p").select(*samples.columns, "__x", "__p.*")
        value = hermite(F.col("__x")) if outside == "clamp" else F.when(F.col("__x") == F.col(x), hermite(F.col("__x")))
        return met.withColumn(name, value).select(*samples.columns, name)
    pieces = pchip_slopes(knots, key, t, y).select(*key, F.col("t0").alias(x), F.struct("t0", "t1", "y0", "y1", "d0", "d1").alias("__piece"))
    met = asof_backward(samples, pieces, key, x, "__piece", "__p")
    inside = met.where(F.col(x) <= F.col("__p.t1")).select(*samples.columns, "__p.*")
    return inside.withColumn(name, hermite(F.col(x))).select(*samples.columns, name)


def reel(df: DataFrame, key: list[str], order: list[str], start: str, end: str, default_length: float, lead_in: float) -> DataFrame:
    """Play list: stop at the given end or ``default_length`` after the start; next_start is where the next clip is entered."""
    w = _w(key, order)
    return df.withColumn("stop", F.coalesce(F.col(end), F.col(start) + default_length)).withColumn("next_start", F.greatest(F.lit(0.0), F.lead(start).over(w) - lead_in)).withColumn("place", F.row_number().over(w).cast("bigint"))


def ordered_points(context: Column, at: Column, shown: Column, end: Column) -> list[Column]:
    """The four times pushed into order: context <= at <= shown <= end."""
    shown2 = F.greatest(shown, at)
    return [F.least(context, at), at, shown2, F.greatest(end, shown2)]


def moved_handle(handle: str, to: Column, context: Column, at: Column, shown: Column, end: Column) -> list[Column]:
    """(context, at, shown, end) after one handle (``context``, ``at``, ``shown`` or ``end``) is dragged ``to`` a time: the pin ``at`` pushes its
    neighbours along, the others stop at it or at each other, and what comes later never ends up earlier."""
    if handle not in ("context", "at", "shown", "end"):
        raise ValueError("handle is context, at, shown or end")
    at2 = to if handle == "at" else at
    context2 = {"context": F.least(to, at), "at": F.least(context, to)}.get(handle, context)
    shown2 = F.greatest(to if handle == "shown" else shown, at2)
    return [context2, at2, shown2, F.greatest(to if handle == "end" else end, shown2)]
