"""Ordered folds over the driver's events; their SQL walks the rows of every key with a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import control
from kickframe.plans.registry import query, table

KEY, ORDER = ["user_id"], ["event_id"]
_R = "r AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


def _walk(first: str, step: str, out: str, more: str = "") -> str:
    """A recursive query: ``first`` and ``step`` are select lists of the state, ``out`` the final select list."""
    return f"""WITH RECURSIVE {_R}, f AS (SELECT r.user_id, r.rn, r.event_id, {first} FROM r WHERE rn = 1
UNION ALL SELECT r.user_id, r.rn, r.event_id, {step} FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1 {more}) SELECT event_id, {out} FROM f"""


def _e(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def _rounded(df, *names):
    return df.select("event_id", *[F.round(n, 6).alias(n) for n in names])


@query(_walk("value AS s", "s + 0.12 * (r.value - s)", "round(s, 6) AS smooth"))
def ema_fold(spark, sf_dir):
    return _rounded(control.ema(_e(spark, sf_dir), KEY, ORDER, "value"), "smooth")


@query(_walk("value AS s", "s + CASE WHEN r.event_type = 'view' THEN least(0.8, 0.12 * 3 * (1 + 5 * (abs(r.value - s) / 100))) ELSE 0.06 END * (r.value - s)", "round(s, 6) AS smooth"))
def ema_adaptive(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("sure", F.col("event_type") == "view")
    return _rounded(control.adaptive_ema(e, KEY, ORDER, "value", "sure", scale=100.0), "smooth")


@query(_walk("value AS x, 0.0::DOUBLE AS v", "r.value, 2.0::DOUBLE / 3 * v + (1 - 2.0::DOUBLE / 3) * (r.value - x)", "round(v, 6) AS velocity"))
def velocity_ema(spark, sf_dir):
    return _rounded(control.velocity_ema(_e(spark, sf_dir), KEY, ORDER, "value", keep=2.0 / 3), "velocity")


def _step_v(p: str, v: str, x: str) -> str:
    return f"({v} + 0.4 * (CASE WHEN abs({x} - {p}) < 5 THEN 0.0 ELSE 0.3 * ({x} - {p}) END - {v}))"


def _moved(p: str, v: str) -> str:
    return f"greatest(0.0, least(300.0, {p} + greatest(-20.0, least(20.0, {v}))))"


@query(
    _walk(
        f"{_moved('0.0', _step_v('0.0', '0.0', 'value'))}::DOUBLE AS p, {_step_v('0.0', '0.0', 'value')}::DOUBLE AS v",
        f"{_moved('p', _step_v('p', 'v', 'r.value'))}, {_step_v('p', 'v', 'r.value')}",
        "round(p, 6) AS position, round(v, 6) AS velocity",
    )
)
def controller_fold(spark, sf_dir):
    return _rounded(control.controller(_e(spark, sf_dir), KEY, ORDER, "value", 5.0, 0.3, 0.4, 20.0, 0.0, 300.0), "position", "velocity")


_FIRE = "(CASE WHEN r.event_type <> 'purchase' THEN n + 1 ELSE 0 END >= 3 AND since + 1 > 5)"


@query(
    _walk(
        "CAST(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS n, CAST(6 AS BIGINT) AS since, false AS fired",
        f"CASE WHEN {_FIRE} OR r.event_type = 'purchase' THEN 0 ELSE n + 1 END, CASE WHEN {_FIRE} THEN 0 ELSE since + 1 END, {_FIRE}",
        "fired",
    )
)
def run_length_trigger(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("on", F.col("event_type") != "purchase")
    return control.run_trigger(e, KEY, ORDER, "on", 3, 5).select("event_id", "fired")


_Y = "CAST(r.event_id % 97 AS DOUBLE)"
_BAD = f"(abs(r.value - x) / 400 > 0.25 OR abs({_Y} - y) / 100 > 0.5 OR (abs(r.value - x) < 5 AND abs({_Y} - y) < 5 AND n = 0))"


@query(
    _walk(
        "value AS x, CAST(event_id % 97 AS DOUBLE) AS y, CAST(0 AS BIGINT) AS n, true AS ok",
        f"CASE WHEN {_BAD} THEN x ELSE r.value END, CASE WHEN {_BAD} THEN y ELSE {_Y} END, CASE WHEN {_BAD} THEN n + 1 ELSE 0 END, NOT {_BAD}",
        "ok AS accepted",
    )
)
def jump_static_reject(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("y", (F.col("event_id") % 97).cast("double"))
    # the height is halved so that the same share allows half of it
    return control.accept_moves(e, KEY, ORDER, "value", "y", 400.0, 200.0).select("event_id", "accepted")


def _kalman_sql(n: int, seen: str = "true") -> str:
    """One state row per key: positions, velocities, the covariance a, b, c and the misses."""
    zs = ["r.value", "CAST(r.event_id % 97 AS DOUBLE)"][:n]
    x, v = [f"x{i}" for i in range(n)], [f"v{i}" for i in range(n)]
    away = "sqrt(" + " + ".join(f"({z} - {a}) * ({z} - {a})" for z, a in zip(zs, x)) + ")"
    state = f"CASE WHEN NOT {seen} THEN 'miss' WHEN {away} > 200 AND missed = 0 THEN 'ignore' WHEN {away} > 400 THEN 'start' ELSE 'see' END"
    pa, pb, pc = "(a + 2 * b + c + 12.5)", "(b + c + 25)", "(c + 50)"
    k0, k1 = f"({pa} / ({pa} + 225))", f"({pb} / ({pa} + 225))"
    decay = "pow(0.92, least(missed + 1, 30))"
    case = lambda start, miss, see, same: f"CASE st WHEN 'start' THEN {start} WHEN 'miss' THEN {miss} WHEN 'see' THEN {see} ELSE {same} END"
    cols = []
    for i in range(n):
        z = f"z{i}"
        cols.append(f"{case(z, f'x{i} + v{i}', f'x{i} + v{i} + {k0} * ({z} - x{i} - v{i})', f'x{i}')} AS x{i}")
        cols.append(f"{case('0.0', f'v{i} * {decay}', f'v{i} + {k1} * ({z} - x{i} - v{i})', f'v{i}')} AS v{i}")
    cols += [f"{case('500.0', pa, f'(1 - {k0}) * {pa}', 'a')} AS a", f"{case('0.0', pb, f'(1 - {k0}) * {pb}', 'b')} AS b", f"{case('500.0', pc, f'{pc} - {k1} * {pb}', 'c')} AS c", f"{case('0', 'missed + 1', '0', 'missed')} AS missed"]
    first = ", ".join([f"{z.replace('r.', '')} AS x{i}, 0.0::DOUBLE AS v{i}" for i, z in enumerate(zs)] + ["500.0::DOUBLE AS a, 0.0::DOUBLE AS b, 500.0::DOUBLE AS c, 0 AS missed"])
    inner = f"SELECT r.user_id, r.rn, r.event_id, f.* EXCLUDE (user_id, rn, event_id), {', '.join(f'{z} AS z{i}' for i, z in enumerate(zs))}, {state} AS st FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1"
    out = ", ".join(f"round(x{i}, 6) AS est_{i}, round(v{i}, 6) AS vel_{i}" for i in range(n))
    return f"WITH RECURSIVE {_R}, f AS (SELECT user_id, rn, event_id, {first} FROM r WHERE rn = 1 UNION ALL SELECT user_id, rn, event_id, {', '.join(cols)} FROM ({inner}) s) SELECT event_id, {out}, CAST(missed AS INTEGER) AS missed FROM f"


@query(_kalman_sql(1))
def kalman_1d(spark, sf_dir):
    return control.kalman(_e(spark, sf_dir), KEY, ORDER, ["value"]).select("event_id", F.round("est_0", 6).alias("est_0"), F.round("vel_0", 6).alias("vel_0"), "missed")


@query(_kalman_sql(2, "(r.event_type <> 'error' OR r.rn = 1)"))
def kalman_2d(spark, sf_dir):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    e = _e(spark, sf_dir).withColumn("y", (F.col("event_id") % 97).cast("double")).withColumn("seen", (F.col("event_type") != "error") | first)
    names = ["est_0", "vel_0", "est_1", "vel_1"]
    return control.kalman(e, KEY, ORDER, ["value", "y"], seen="seen").select("event_id", *[F.round(n, 6).alias(n) for n in names], "missed")


#: What a frame shows: a ball on clicks, up to four players, and a cluster of them now and then.
_SCENE = {
    "ball_x": "CASE WHEN event_type = 'click' THEN value * 4 END",
    "ball_y": "CASE WHEN event_type = 'click' THEN CAST(event_id % 97 * 8 AS DOUBLE) END",
    "conf": "event_id % 10 / 10.0",
    "n": "CASE WHEN event_id % 4 = 3 THEN 0 ELSE event_id % 5 END",
    "cx": "CASE WHEN event_id % 3 = 0 THEN CAST(event_id * 31 % 1280 AS DOUBLE) END",
    "cy": "CASE WHEN event_id % 3 = 0 THEN CAST(event_id * 17 % 720 AS DOUBLE) END",
    "gx": "CAST(event_id * 13 % 1280 AS DOUBLE)",
    "gy": "CAST(event_id * 7 % 720 AS DOUBLE)",
}


_SCENE_SQL = ", ".join(f"{v} AS {k}" for k, v in _SCENE.items())


def _scene(spark, sf_dir):
    return _e(spark, sf_dir).selectExpr("*", *[f"{v} AS {k}" for k, v in _SCENE.items()])


@query(f"""SELECT event_id, CASE mode WHEN 'players' THEN gx WHEN 'home' THEN 640.0 ELSE lx END AS target_x, CASE mode WHEN 'players' THEN gy WHEN 'home' THEN 360.0 ELSE ly END AS target_y, mode FROM (
SELECT *, CASE WHEN rn = seen THEN 'ball' WHEN rn - seen < 3 THEN 'last_ball' WHEN rn - seen < 6 AND n > 0 THEN 'players' ELSE 'home' END AS mode FROM (
SELECT *, max(CASE WHEN ball_x IS NOT NULL THEN rn END) OVER w AS seen, last_value(ball_x IGNORE NULLS) OVER w AS lx, last_value(ball_y IGNORE NULLS) OVER w AS ly FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, {_SCENE_SQL} FROM events) a WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING)) b) c""")
def target_choice_classic(spark, sf_dir):
    e = _scene(spark, sf_dir).withColumn("px", F.when(F.col("n") > 0, F.col("gx")))
    return control.choose_classic(e, KEY, ORDER, ("ball_x", "ball_y"), ("px", "gy"), short=3, long=6).select("event_id", "target_x", "target_y", "mode")


_FAST, _FADE = "(sqrt(vx * vx + vy * vy) > 2 AND gone < 15)", "greatest(0.0, 1 - gone / 7.0)"


def _blend_sql() -> str:
    weight = f"coalesce(CASE WHEN ok AND ball_x IS NOT NULL THEN 3 + least(3.0, sqrt(vx * vx + vy * vy) / 5) WHEN lx IS NOT NULL AND {_FAST} THEN 2.5 * {_FADE} WHEN lx IS NOT NULL THEN 1.5 * {_FADE} END, 0.0)"
    at = lambda ball, last, v, most, home: f"coalesce(CASE WHEN ok AND {ball} IS NOT NULL THEN {ball} WHEN lx IS NOT NULL THEN CASE WHEN {_FAST} THEN least(greatest({last} + {v} * gone * 0.5, 0.0), {most}) ELSE {last} END END, {home})"
    mean = lambda at, crowd, home: f"round((wb * {at} + wc * CASE WHEN n > 0 THEN {crowd} ELSE {home} END + 0.2 * {home}) / (wb + wc + 0.2), 6)"
    return f"""SELECT event_id, {mean(at('ball_x', 'lx', 'vx', '1280.0', '640.0'), 'gx', '640.0')} AS target_x, {mean(at('ball_y', 'ly', 'vy', '720.0', '302.4'), 'gy', '302.4')} AS target_y,
CASE WHEN wb > 2 THEN 'ball' WHEN wb > 0.5 THEN 'last_ball' WHEN wc > 0 THEN 'players' ELSE 'centre' END AS mode FROM (SELECT *, {weight} AS wb, CASE WHEN n > 0 THEN 0.7 ELSE 0.0 END AS wc FROM (
SELECT *, rn - max(CASE WHEN ball_x IS NOT NULL THEN rn END) OVER w AS gone, last_value(ball_x IGNORE NULLS) OVER w AS lx, last_value(ball_y IGNORE NULLS) OVER w AS ly FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id % 10 >= 3 AS ok, event_id % 9 - 4.0::DOUBLE AS vx, event_id % 5 - 2.0::DOUBLE AS vy, {_SCENE_SQL} FROM events) a WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING)) b) c"""


@query(_blend_sql())
def target_choice_blend(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("event_id")
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = _scene(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    e = e.withColumns({"ok": k % 10 >= 3, "vx": (k % 9 - 4).cast("double"), "vy": (k % 5 - 2).cast("double"), "px": F.when(F.col("n") > 0, F.col("gx"))})
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    e = e.withColumns({"gone": F.col("rn") - last(F.when(F.col("ball_x").isNotNull(), F.col("rn"))), "lx": last("ball_x"), "ly": last("ball_y")})
    out = control.choose_blend(e, "ok", ("ball_x", "ball_y"), ("lx", "ly"), "gone", ("vx", "vy"), ("px", "gy"), short=7)
    return out.select("event_id", F.round("target_x", 6).alias("target_x"), F.round("target_y", 6).alias("target_y"), "mode")


def _cascade_sql(fresh: int = 2, old: int = 5, older: bool = False) -> str:
    """The track as a recursive query, one stage for what happens to it and one for whether it leaves the picture; then the rules."""
    pa, pb, pc = "(a + 2 * b + c + 12.5)", "(b + c + 25)", "(c + 50)"
    k0, k1 = f"({pa} / ({pa} + 225))", f"({pb} / ({pa} + 225))"
    by_case = lambda start, miss, see, same: f"CASE st WHEN 'start' THEN {start} WHEN 'miss' THEN {miss} WHEN 'see' THEN {see} ELSE {same} END"
    away = "sqrt((s.ball_x - x) * (s.ball_x - x) + (s.ball_y - y) * (s.ball_y - y))"
    what = f"CASE WHEN NOT live THEN CASE WHEN s.ball_x IS NULL THEN 'none' ELSE 'start' END WHEN s.ball_x IS NULL THEN 'miss' WHEN {away} > 200 AND missed = 0 THEN 'ignore' WHEN {away} > 400 THEN 'start' ELSE 'see' END"
    axis = lambda p, v, z: f"{by_case(z, f'{p} + {v}', f'{p} + {v} + {k0} * ({z} - {p} - {v})', p)} AS {p}, {by_case('0.0', f'{v} * pow(0.92, least(missed + 1, 30))', f'{v} + {k1} * ({z} - {p} - {v})', v)} AS {v}"
    moved = f"""SELECT user_id, rn, st <> 'none' AS known, {axis('x', 'vx', 'zx')}, {axis('y', 'vy', 'zy')}, {by_case('500.0', pa, f'(1 - {k0}) * {pa}', 'a')} AS a,
{by_case('0.0', pb, f'(1 - {k0}) * {pb}', 'b')} AS b, {by_case('500.0', pc, f'{pc} - {k1} * {pb}', 'c')} AS c, CASE WHEN st IN ('start', 'see') THEN 0 WHEN st = 'ignore' THEN missed ELSE missed + 1 END AS missed
FROM (SELECT s.user_id, s.rn, s.ball_x AS zx, s.ball_y AS zy, {what} AS st, live, x, vx, y, vy, a, b, c, missed FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1) u"""
    lost = f"(known AND missed >= {fresh} AND missed < {old} AND (x < 0 OR x > 1280 OR y < 0 OR y > 720))"
    if older:
        lost = "false"
    walk = f"""f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, false AS known, false AS live, 0.0::DOUBLE AS x, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS y, 0.0::DOUBLE AS vy, 500.0::DOUBLE AS a, 0.0::DOUBLE AS b, 500.0::DOUBLE AS c, 999 AS missed FROM s
UNION ALL SELECT user_id, rn, known, known AND NOT {lost}, x, vx, y, vy, a, b, c, CASE WHEN {lost} THEN 999 ELSE missed END FROM ({moved}) m)"""
    rules = f"""CASE WHEN ball_x IS NOT NULL AND conf >= 0.5 AND sqrt((ball_x - x) * (ball_x - x) + (ball_y - y) * (ball_y - y)) <= 200 THEN 'ball_highconf' WHEN known AND missed < {fresh} THEN 'ball'
WHEN live AND missed < {old} THEN CASE WHEN n >= 2 AND cx IS NOT NULL OR n >= 4 THEN 'kalman_blend' ELSE 'kalman' END
WHEN n >= 2 AND cx IS NOT NULL THEN CASE WHEN abs(cx - 640) / 640 >= 0.8 THEN 'players' ELSE 'hold' END
WHEN n >= 2 THEN CASE WHEN abs(gx - 640) / 640 >= 0.8 THEN 'few_players' ELSE 'hold' END WHEN n = 1 THEN 'single_player' ELSE 'centre' END"""
    w = f"greatest(0.85, 0.9 * (1 - missed / {old}))"
    if older:
        rules = f"""CASE WHEN ball_x IS NOT NULL AND conf >= 0.5 THEN 'ball_highconf' WHEN known AND missed < {fresh} THEN 'ball' WHEN known AND missed < {old} THEN CASE WHEN n >= 4 THEN 'kalman_blend' ELSE 'kalman' END
WHEN n >= 4 THEN 'players' WHEN n >= 2 THEN 'few_players' WHEN n = 1 THEN 'single_player' ELSE 'centre' END"""
        w = f"(0.9 * (1 - missed / {old}) + 0.3 * (missed / {old}))"
    at = lambda ball, p, c, g, half: f"CASE mode WHEN 'ball_highconf' THEN {ball} WHEN 'ball' THEN {p} WHEN 'kalman' THEN {p} WHEN 'kalman_blend' THEN {w} * {p} + (1 - {w}) * coalesce({c}, {g}) WHEN 'players' THEN {c} WHEN 'few_players' THEN 0.2 * {g} + 0.8 * {half} WHEN 'single_player' THEN 0.05 * {g} + 0.95 * {half} ELSE {half} END"
    group = (lambda c, g: g) if older else (lambda c, g: c)
    return f"""WITH RECURSIVE s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, {_SCENE_SQL} FROM events), {walk}
SELECT event_id, round({at('ball_x', 'x', group('cx', 'gx'), 'gx', '640.0')}, 6) AS target_x, round({at('ball_y', 'y', group('cy', 'gy'), 'gy', '360.0')}, 6) AS target_y, mode
FROM (SELECT s.*, f.known, f.live, f.x, f.y, f.missed, {rules} AS mode FROM s JOIN f USING (user_id, rn)) q"""


@query(_cascade_sql())
def target_choice_kalman(spark, sf_dir):
    out = control.choose_kalman(_scene(spark, sf_dir), KEY, ORDER, ("ball_x", "ball_y"), "conf", "n", ("cx", "cy"), ("gx", "gy"), fresh=2, old=5)
    return out.select("event_id", F.round("target_x", 6).alias("target_x"), F.round("target_y", 6).alias("target_y"), "mode")


@query(_cascade_sql(older=True))
def target_choice_kalman_older(spark, sf_dir):
    out = control.choose_kalman_older(_scene(spark, sf_dir), KEY, ORDER, ("ball_x", "ball_y"), "conf", "n", ("gx", "gy"), fresh=2, old=5)
    return out.select("event_id", F.round("target_x", 6).alias("target_x"), F.round("target_y", 6).alias("target_y"), "mode")


_BEFORE = """CASE WHEN ball_x IS NOT NULL AND conf >= 0.5 THEN 'ball_highconf' WHEN trusted AND gone < 2 THEN 'ball' WHEN gone < 5 AND n > 0 THEN 'blend' WHEN gone < 5 THEN 'last_ball'
WHEN n >= 4 THEN 'players' WHEN n >= 2 THEN 'few_players' WHEN n = 1 THEN 'single_player' ELSE 'centre' END"""
_BEFORE_AT = "CASE WHEN mode IN ('ball_highconf', 'ball', 'last_ball') THEN {l} WHEN mode = 'blend' THEN (1 - gone / 5.0) * {l} + gone / 5.0 * ({g} + 10) WHEN mode = 'players' THEN {g} WHEN mode = 'few_players' THEN 0.2 * {g} + 0.8 * {m} WHEN mode = 'single_player' THEN 0.05 * {g} + 0.95 * {m} ELSE {m} END"


@query(f"""SELECT event_id, round({_BEFORE_AT.format(l="lx", g="gx", m="640.0")}, 6) AS target_x, round({_BEFORE_AT.format(l="ly", g="gy", m="360.0")}, 6) AS target_y, mode FROM (SELECT *, {_BEFORE} AS mode FROM (
SELECT *, max(CASE WHEN ball_x IS NOT NULL AND (conf >= 0.5 OR rn - coalesce(none, 0) >= 3) THEN 1 ELSE 0 END) OVER w = 1 AS trusted FROM (
SELECT *, rn - max(CASE WHEN ball_x IS NOT NULL THEN rn END) OVER w AS gone, max(CASE WHEN ball_x IS NULL THEN rn END) OVER w AS none, last_value(ball_x IGNORE NULLS) OVER w AS lx, last_value(ball_y IGNORE NULLS) OVER w AS ly FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, {_SCENE_SQL} FROM events) a WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING)) b WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING)) c) d""")
def target_choice_before_kalman(spark, sf_dir):
    e = _scene(spark, sf_dir).withColumns({"mx": F.col("gx") + 10, "my": F.col("gy") + 10})
    out = control.choose_before_kalman(e, KEY, ORDER, ("ball_x", "ball_y"), "conf", "n", ("mx", "my"), ("gx", "gy"), short=2, long=5)
    return out.select("event_id", F.round("target_x", 6).alias("target_x"), F.round("target_y", 6).alias("target_y"), "mode")


_PLAYERS, _FAR_BALL = "CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN 1 ELSE 5 END", "event_id % 3 > 0"


def _reanchor_sql() -> str:
    """Counts of a row hold for the next; a trigger sets them back before the row itself is counted."""
    counts = f"CASE WHEN n <= 1 THEN s0 + 2 ELSE 0 END AS single, CASE WHEN n = 0 THEN n0 + 2 ELSE 0 END AS nobody, CASE WHEN b THEN f0 + 1 ELSE 0 END AS far"
    fired = "CASE WHEN t0 IS NULL THEN 'startup' WHEN t - t0 >= 100 THEN CASE WHEN t - t0 >= 600 THEN 'backstop' WHEN single >= 6 THEN 'single_player' WHEN nobody >= 4 THEN 'centre' WHEN far >= 3 THEN 'ball_far' END END"
    joined = f"SELECT r.user_id, r.rn, r.event_id, r.value, CAST(r.event_id AS DOUBLE) AS t, {_PLAYERS.replace('event_type', 'r.event_type')} AS n, r.{_FAR_BALL} AS b, f.t0, f.aim, f.pan, f.single, f.nobody, f.far FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1"
    set_anew = "SELECT *, CASE WHEN tr IS NULL THEN t0 ELSE t END AS at2, CASE WHEN tr IS NULL THEN aim ELSE value END AS aim2, CASE WHEN tr IS NULL THEN single ELSE 0 END AS s0, CASE WHEN tr IS NULL THEN nobody ELSE 0 END AS n0, CASE WHEN tr IS NULL THEN far ELSE 0 END AS f0"
    return f"""WITH RECURSIVE {_R}, f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS t0, CAST(NULL AS DOUBLE) AS aim, 0.0::DOUBLE AS pan, 0 AS single, 0 AS nobody, 0 AS far, CAST(NULL AS VARCHAR) AS trigger, '' AS mode FROM r
UNION ALL SELECT user_id, rn, event_id, at2, aim2, greatest(-180.0, least(180.0, pan + greatest(-3.0, least(3.0, 0.15 * (aim2 - pan))))), {counts}, tr, CASE WHEN abs(aim2 - pan) < 1 THEN 'hold' ELSE 'players' END FROM ({set_anew} FROM (SELECT *, {fired} AS tr FROM ({joined}) a) b) c)
SELECT event_id, round(pan + 3e-9, 6) AS pan, trigger, mode FROM f WHERE rn > 0"""


@query(_reanchor_sql())
def reanchor_triggers(spark, sf_dir):
    e = _e(spark, sf_dir).selectExpr("*", "cast(event_id as double) AS t", f"{_PLAYERS} AS n", f"{_FAR_BALL} AS far")
    out = control.reanchor(e, KEY, ORDER, "t", "n", "far", "value", backstop=600.0, cooldown=100.0, single=6, nobody=4, confirms=3, every=2)
    return out.select("event_id", F.round(F.col("pan") + 3e-9, 6).alias("pan"), "trigger", "mode")  # moves exact halves off the last place


def _centres_sql() -> str:
    d = ", ".join(f"sqrt(list_sum(list_transform(list_zip(c{k}, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d{k}" for k in range(3))
    unit = lambda k: f"[{', '.join('1.0' if i == k else '0.0' for i in range(64))}]::DOUBLE[]"
    near = "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
    fits = "best <= 6 AND margin >= 0.05"
    new = lambda k: f"CASE WHEN i = {k} AND {fits} AND best < 2.5 THEN list_transform(m{k}, lambda q: q / (sqrt(list_sum(list_transform(m{k}, lambda z: z * z))) + 1e-8)) ELSE c{k} END"
    moved = ", ".join(f"list_transform(list_zip(c{k}, v), lambda z: 0.98 * z[1] + 0.02 * z[2]) AS m{k}" for k in range(3))
    return f"""WITH RECURSIVE s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
f AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS vec_id, {', '.join(f'{unit(k)} AS c{k}' for k in range(3))}, CAST(NULL AS INTEGER) AS assigned, 0.0::DOUBLE AS margin, 0.0::DOUBLE AS best FROM s
UNION ALL SELECT label, rn, vec_id, {', '.join(new(k) for k in range(3))}, CASE WHEN {fits} THEN i END, margin, best FROM (
SELECT *, {near} AS i, least(d0, d1, d2) AS best, list_sort([d0, d1, d2])[2] - least(d0, d1, d2) AS margin, {moved} FROM (
SELECT s.label, s.rn, s.vec_id, s.v, c0, c1, c2, {d} FROM f JOIN s ON s.label = f.label AND s.rn = f.rn + 1) a) b)
SELECT vec_id, assigned, round(margin, 6) AS margin, round(best, 6) AS distance FROM f WHERE rn > 0"""


@query(_centres_sql())
def online_centre_ema(spark, sf_dir):
    """Features of the embeddings in order of id, one series per label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("feature"))
    centres = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(3)]
    out = control.online_centres(e, ["label"], ["vec_id"], "feature", centres)
    return out.select("vec_id", "assigned", F.round("margin", 6).alias("margin"), F.round("distance", 6).alias("distance"))
