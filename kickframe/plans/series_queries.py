"""Time-series operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.operators import folds, series
from kickframe.plans.registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("t", F.col("us") / 1e6)


_EV = "(SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t FROM events)"
_SESSIONS = f"""SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM (
 SELECT *, CAST(coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY us, event_id) > 3600, false) AS BIGINT) AS new FROM {_EV} e) x"""
KEY, ORDER = ["user_id"], ["us", "event_id"]


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gap_sessions(_events(spark, sf_dir), KEY, F.col("t"), ORDER, 3600.0)


@query(f"SELECT event_id, user_id, CAST(session AS BIGINT) AS session, round(min(t) OVER (PARTITION BY user_id, session), 3) AS session_start FROM ({_SESSIONS}) s")
def gap_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("event_id", "user_id", "session", F.round("session_start", 3).alias("session_start"))


@query(f"SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, round(max(value), 6) AS max_value FROM ({_SESSIONS}) s GROUP BY user_id, session")
def session_stats(spark, sf_dir):
    return _sessions(spark, sf_dir).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_pop("value"), 6).alias("std_value"), F.round(F.max("value"), 6).alias("max_value"))


@query("SELECT event_id, round(prev, 6) AS prev, round(value - prev, 6) AS velocity FROM (SELECT event_id, value, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) x")
def first_diff_velocity(spark, sf_dir):
    return series.first_difference(_events(spark, sf_dir), KEY, ORDER, "value").select("event_id", F.round("prev", 6).alias("prev"), F.round("velocity", 6).alias("velocity"))


@query("""SELECT event_id, CAST(coalesce(i - last, 999 + i) AS BIGINT) AS rows_since FROM (SELECT event_id, i, max(CASE WHEN event_type = 'purchase' THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS last FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) a) b""")
def frames_since_hit(spark, sf_dir):
    return series.rows_since(_events(spark, sf_dir), KEY, ORDER, F.col("event_type") == "purchase", 999).select("event_id", "rows_since")


@query("""SELECT event_id, CAST(streak AS BIGINT) AS streak, max(streak) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 2 AS trusted FROM (
 SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, miss ORDER BY ts, event_id) AS streak FROM (
 SELECT *, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS miss FROM events) a) b""")
def hit_streak_latch(spark, sf_dir):
    return series.hit_streak(_events(spark, sf_dir), KEY, ORDER, F.col("event_type") == "view", 2).select("event_id", "streak", "trusted")


@query("SELECT event_id, round(last_value(CASE WHEN event_id % 5 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS held FROM events")
def hold_last_value(spark, sf_dir):
    return series.hold_last(_events(spark, sf_dir), KEY, ORDER, F.when(F.col("event_id") % 5 == 0, F.col("value"))).select("event_id", F.round("held", 6).alias("held"))


@query("""WITH v AS (SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS votes FROM events),
u AS (SELECT event_id, len(votes) AS n, unnest(votes) AS vote, generate_subscripts(votes, 1) AS pos FROM v),
c AS (SELECT event_id, n, vote, count(*) AS k, min(pos) AS first FROM u GROUP BY event_id, n, vote),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k DESC, first) AS rn FROM c)
SELECT event_id, CAST(n AS BIGINT) AS votes, CASE WHEN k >= 4 AND k >= 0.4 * n THEN vote END AS majority FROM b WHERE rn = 1""")
def bounded_vote_majority(spark, sf_dir):
    return series.majority_of_last(_events(spark, sf_dir), KEY, ORDER, "event_type", 15, 4, 0.4).select("event_id", "votes", "majority")


_DAILY = "(SELECT l_returnflag AS flag, strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double").alias("total"))


@query(f"SELECT flag, day, round(sum(total) OVER (PARTITION BY flag ORDER BY day ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8, 6) AS smooth FROM {_DAILY} d")
def moving_average_same(spark, sf_dir):
    return series.moving_average(_daily(spark, sf_dir), ["flag"], ["day"], "total", 8).select("flag", "day", F.round("smooth", 6).alias("smooth"))


@query(f"""SELECT flag, min(CASE WHEN was AND total < lim THEN day END) AS first_below FROM (SELECT *, bool_or(total >= lim) OVER (PARTITION BY flag ORDER BY day) AS was FROM (
 SELECT *, 0.35 * max(total) OVER (PARTITION BY flag) AS lim FROM {_DAILY} d) a) b GROUP BY flag""")
def hysteresis_first_below(spark, sf_dir):
    return series.first_below_after(_daily(spark, sf_dir), ["flag"], "day", "total", 0.35)


@query(f"SELECT flag, max(CASE WHEN total > 10000000 THEN day END) AS last_match FROM {_DAILY} d GROUP BY flag")
def last_matching(spark, sf_dir):
    return series.last_matching(_daily(spark, sf_dir), ["flag"], "day", F.col("total") > 10000000)


@query(f"""SELECT l.event_id, CASE WHEN r.t IS NULL THEN 999.0 ELSE least(round(l.t - r.t, 3), 86400.0) END AS since
FROM (SELECT * FROM {_EV} a WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT user_id, t FROM {_EV} b WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.t >= r.t""")
def asof_backward(spark, sf_dir):
    e = _events(spark, sf_dir)
    right = e.where("event_type = 'purchase'").select("user_id", "t", F.col("t").alias("mark"))
    met = series.asof_backward(e.where("event_type = 'click'"), right, KEY, "t", "mark")
    return met.select("event_id", F.when(F.col("asof").isNull(), F.lit(999.0)).otherwise(F.least(F.round(F.col("t") - F.col("asof"), 3), F.lit(86400.0))).alias("since"))


@query(f"SELECT event_id FROM {_EV} l WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM {_EV} r WHERE r.event_type = 'view' AND r.user_id = l.user_id AND abs(l.t - r.t) < 7200)")
def nearest_within_tol(spark, sf_dir):
    e = _events(spark, sf_dir)
    return series.nearest_within(e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'view'"), KEY, "t", "t", 7200.0).select("event_id")


_SPANS = f"(SELECT event_id AS span_id, user_id, t AS start, t + 5000 AS stop FROM {_EV} s WHERE event_type = 'signup')"


def _spans(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", F.col("t").alias("start"), (F.col("t") + 5000).alias("stop"))


@query(f"SELECT p.event_id, s.span_id FROM {_EV} p JOIN {_SPANS} s ON p.user_id = s.user_id AND p.t >= s.start AND p.t < s.stop")
def interval_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    return series.interval_join(e, _spans(e), KEY, "t", "start", "stop", 5000.0).select("event_id", "span_id")


@query(f"SELECT event_id FROM {_EV} p WHERE EXISTS (SELECT 1 FROM {_SPANS} s WHERE p.user_id = s.user_id AND p.t >= s.start AND p.t < s.stop)")
def interval_join_any(spark, sf_dir):
    e = _events(spark, sf_dir)
    return series.interval_join(e, _spans(e), KEY, "t", "start", "stop", 5000.0, how="left_semi").select("event_id")


@query(f"SELECT event_id, span_id FROM (SELECT p.event_id, s.span_id, row_number() OVER (PARTITION BY p.event_id ORDER BY s.start, s.stop) AS n FROM {_EV} p JOIN {_SPANS} s ON p.user_id = s.user_id AND p.t >= s.start AND p.t <= s.stop) x WHERE n = 1")
def interval_first_match(spark, sf_dir):
    e = _events(spark, sf_dir)
    return series.first_span(e, _spans(e), KEY, "event_id", "t", "start", "stop", 5000.0).select("event_id", "span_id")


@query(f"""SELECT p.event_id, round(m.t, 3) AS mark FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM (SELECT * FROM {_EV} q WHERE event_type <> 'error') z) p
JOIN (SELECT user_id, t FROM {_EV} r WHERE event_type = 'error') m ON m.user_id = p.user_id AND m.t > p.prev AND m.t <= p.t WHERE p.t - p.prev > 0 AND p.t - p.prev < 20000""")
def crossing_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    met = series.crossings(e.where("event_type <> 'error'"), e.where("event_type = 'error'").select("user_id", F.col("t").alias("at")), KEY, ORDER, "t", "at", 20000.0, 20000.0)
    return met.select("event_id", F.round("mark", 3).alias("mark"))


_KNOTS = "SELECT user_id, CAST(event_id AS DOUBLE) AS x, value AS y FROM events WHERE event_id % 4 = 0"
PCHIP_SQL = """k0 AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS m FROM knots WINDOW w AS (PARTITION BY {key} ORDER BY x)),
k1 AS (SELECT *, lag(h) OVER w AS hp, lag(m) OVER w AS mp, lead(h) OVER w AS hn, lead(m) OVER w AS mn, lag(h, 2) OVER w AS hpp, lag(m, 2) OVER w AS mpp FROM k0 WINDOW w AS (PARTITION BY {key} ORDER BY x)),
k2 AS (SELECT *, CASE WHEN mp IS NULL THEN h WHEN m IS NULL THEN hp END AS e0, CASE WHEN mp IS NULL THEN m WHEN m IS NULL THEN mp END AS f0, CASE WHEN mp IS NULL THEN hn WHEN m IS NULL THEN hpp END AS e1, CASE WHEN mp IS NULL THEN mn WHEN m IS NULL THEN mpp END AS f1 FROM k1),
k3 AS (SELECT *, ((2 * e0 + e1) * f0 - e0 * f1) / (e0 + e1) AS de FROM k2),
k4 AS (SELECT *, CASE WHEN mp IS NULL OR m IS NULL THEN CASE WHEN e1 IS NULL THEN f0 WHEN sign(de) <> sign(f0) THEN 0.0 WHEN sign(f0) <> sign(f1) AND abs(de) > 3 * abs(f0) THEN 3 * f0 ELSE de END
 WHEN mp * m <= 0 THEN 0.0 ELSE (3 * h + 3 * hp) / ((2 * h + hp) / mp + (h + 2 * hp) / m) END AS d FROM k3),
pieces AS (SELECT * FROM (SELECT {key}, x AS t0, lead(x) OVER w AS t1, y AS y0, lead(y) OVER w AS y1, d AS d0, lead(d) OVER w AS d1 FROM k4 WINDOW w AS (PARTITION BY {key} ORDER BY x)) p WHERE t1 IS NOT NULL)"""
_HERMITE = "(2*u*u*u - 3*u*u + 1) * y0 + (u*u*u - 2*u*u + u) * (t1 - t0) * d0 + (3*u*u - 2*u*u*u) * y1 + (u*u*u - u*u) * (t1 - t0) * d1"
_TRUTH = f"""knots AS ({_KNOTS}), {PCHIP_SQL.format(key="user_id")},
met AS (SELECT e.event_id, e.user_id, e.value, p.*, (e.event_id - t0) / (t1 - t0) AS u FROM events e ASOF JOIN (SELECT user_id AS pu, t0, t1, y0, y1, d0, d1 FROM pieces) p ON p.pu = e.user_id AND CAST(e.event_id AS DOUBLE) >= p.t0 WHERE e.event_id <= t1),
truth AS (SELECT event_id, user_id, value, {_HERMITE} AS truth FROM met)"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("x", F.col("event_id").cast("double"))
    knots = e.where("event_id % 4 = 0").select("user_id", F.col("x").alias("kx"), F.col("value").alias("ky"))
    return series.pchip_at(e.select("event_id", "user_id", "value", "x"), knots, KEY, "x", "kx", "ky")


# many truths are exact halves of the last place kept; the small term decides them alike on both sides
@query(f"WITH {_TRUTH} SELECT event_id, round(truth + 3e-12, 9) AS truth FROM truth")
def pchip_interpolate(spark, sf_dir):
    return _truth(spark, sf_dir).select("event_id", F.round(F.col("truth") + 3e-12, 9).alias("truth"))


@query(f"WITH {_TRUTH} SELECT user_id, count(*) AS n, round(sqrt(avg((value - truth) * (value - truth))), 6) AS rmse, round(avg(abs(value - truth)), 6) AS mae FROM truth GROUP BY user_id HAVING count(*) >= 5")
def pchip_eval_metrics(spark, sf_dir):
    e = F.col("value") - F.col("truth")
    return _truth(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae")).where("n >= 5")


def _ema(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    def step(state: dict, row: dict) -> tuple:
        state["s"] = row["value"] if "s" not in state else state["s"] + 0.12 * (row["value"] - state["s"])
        return (state["s"],)

    return folds.ordered_fold(df, KEY, ["event_id"], dict, step, "smooth double")


@query(f"""WITH RECURSIVE {_TRUTH},
r AS (SELECT event_id, user_id, value, truth, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM truth),
f AS (SELECT user_id, rn, event_id, truth, value AS s FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, r.event_id, r.truth, f.s + 0.12 * (r.value - f.s) FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1),
g AS (SELECT f.*, s - truth AS e, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM (SELECT *, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 300, false) AS new FROM f) f),
m AS (SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM g GROUP BY user_id, segment HAVING count(*) >= 3)
SELECT user_id, segment, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(sqrt(avg(rmse * rmse) OVER (PARTITION BY user_id)), 6) AS overall_by_segment, round(sqrt(sum(rmse * rmse * n) OVER (PARTITION BY user_id) / sum(n) OVER (PARTITION BY user_id)), 6) AS overall_by_row FROM m""")
def segment_error(spark, sf_dir):
    """Flagship: smoothed values against an interpolated truth, by gap segments, with both overall weightings."""
    from kickframe.operators import evaluate

    smoothed = _ema(spark, sf_dir, _truth(spark, sf_dir))
    parts = series.gap_sessions(smoothed, KEY, F.col("event_id").cast("double"), ["event_id"], 300.0).withColumnRenamed("session", "segment")
    return evaluate.segment_errors(parts, ["user_id"], "segment", "smooth", "truth", 3)
