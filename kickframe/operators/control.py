"""State machines over ordered rows: smoothing, acceptance, filters and target choice.

Each operator is a fold by key; constants are keyword arguments with the usual values as defaults.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe.operators.folds import ordered_fold

Names = list[str]


def ema(df: DataFrame, key: Names, order: Names, value: str, alpha: float = 0.12) -> DataFrame:
    """smooth: s moves by ``alpha`` of its distance to each value, from the first value on."""

    def step(s: dict, row: dict) -> tuple:
        x = row[value]
        s["s"] = x if "s" not in s else s["s"] + alpha * (x - s["s"])
        return (s["s"],)

    return ordered_fold(df, key, order, dict, step, "smooth double")


def adaptive_ema(df: DataFrame, key: Names, order: Names, value: str, sure: str, alpha: float = 0.12, scale: float = 1.0, cap: float = 0.8) -> DataFrame:
    """smooth: three times ``alpha``, more the larger the error, where the row is sure, else half of it."""

    def step(s: dict, row: dict) -> tuple:
        x = row[value]
        if "s" not in s:
            s["s"] = x
        else:
            err = abs(x - s["s"]) / scale
            a = min(cap, alpha * 3 * (1 + 5 * err)) if row[sure] else alpha * 0.5
            s["s"] += a * (x - s["s"])
        return (s["s"],)

    return ordered_fold(df, key, order, dict, step, "smooth double")


def velocity_ema(df: DataFrame, key: Names, order: Names, value: str, keep: float = 0.7) -> DataFrame:
    """velocity: ``keep`` of the old plus the rest of the last change; 0 at first."""

    def step(s: dict, row: dict) -> tuple:
        x = row[value]
        s["v"] = keep * s["v"] + (1 - keep) * (x - s["x"]) if "x" in s else 0.0
        s["x"] = x
        return (s["v"],)

    return ordered_fold(df, key, order, dict, step, "velocity double")


def controller(df: DataFrame, key: Names, order: Names, target: str, deadband: float, gain: float, smooth: float, most: float, low: float, high: float, start: float = 0.0) -> DataFrame:
    """position and velocity: follows the target with a dead band, a smoothed velocity, a greatest step and a range.

    Only the step is limited; the velocity that is carried on is not. ``smooth`` of 1 steps by the wanted velocity itself.
    """

    def step(s: dict, row: dict) -> tuple:
        p, v = s.get("p", start), s.get("v", 0.0)
        err = row[target] - p
        want = 0.0 if abs(err) < deadband else gain * err
        v += smooth * (want - v)
        s["v"], s["p"] = v, max(low, min(high, p + max(-most, min(most, v))))
        return s["p"], v

    return ordered_fold(df, key, order, dict, step, "position double, velocity double")


def run_trigger(df: DataFrame, key: Names, order: Names, condition: str, length: int, cooldown: int) -> DataFrame:
    """fired: after ``length`` rows in a row with the condition, unless it fired within ``cooldown`` rows; firing restarts the count."""

    def step(s: dict, row: dict) -> tuple:
        s["n"] = s.get("n", 0) + 1 if row[condition] else 0
        s["since"] = s.get("since", cooldown) + 1
        fired = s["n"] >= length and s["since"] > cooldown
        if fired:
            s["n"], s["since"] = 0, 0
        return (fired,)

    return ordered_fold(df, key, order, dict, step, "fired boolean")


def accept_moves(df: DataFrame, key: Names, order: Names, x: str, y: str, width: float, height: float, jump: float = 0.25, still: float = 5.0) -> DataFrame:
    """accepted: not too far from the last accepted place, and not still right after one."""

    def step(s: dict, row: dict) -> tuple:
        if "x" in s:
            dx, dy = abs(row[x] - s["x"]), abs(row[y] - s["y"])
            if dx / width > jump or dy / height > jump or (dx < still and dy < still and s["n"] == 0):
                s["n"] += 1
                return (False,)
        s["x"], s["y"], s["n"] = row[x], row[y], 0
        return (True,)

    return ordered_fold(df, key, order, dict, step, "accepted boolean")


class Kalman:
    """Constant velocity on each axis, both with one covariance since noise is the same on both.

    ``missed`` counts the rows since the last measurement and is 999 before the first.
    """

    def __init__(self, q: float = 50.0, r: float = 225.0, far: float = 200.0, lost: float = 400.0, decay: float = 0.92) -> None:
        self.q, self.r, self.far, self.lost, self.decay = q, r, far, lost, decay
        self.forget()

    def forget(self) -> None:
        self.x, self.v, self.p, self.missed = [], [], (500.0, 0.0, 500.0), 999

    def _start(self, at: list[float]) -> None:
        self.x, self.v, self.p, self.missed = list(at), [0.0] * len(at), (500.0, 0.0, 500.0), 0

    def _predict(self) -> None:
        a, b, c = self.p
        self.x = [x + v for x, v in zip(self.x, self.v, strict=True)]
        self.p = (a + 2 * b + c + self.q / 4, b + c + self.q / 2, c + self.q)

    def away(self, at: list[float]) -> float:
        return math.sqrt(sum((a - x) ** 2 for a, x in zip(at, self.x, strict=True)))

    def see(self, at: list[float]) -> None:
        """A measurement. A far one right after another is taken for a mistake; a very far one later starts anew."""
        if not self.x:
            return self._start(at)
        away = self.away(at)
        if away > self.far and self.missed == 0:
            return None
        if away > self.lost:
            return self._start(at)
        self._predict()
        a, b, c = self.p
        k0, k1 = a / (a + self.r), b / (a + self.r)
        gap = [z - x for z, x in zip(at, self.x, strict=True)]
        self.x = [x + k0 * g for x, g in zip(self.x, gap, strict=True)]
        self.v = [v + k1 * g for v, g in zip(self.v, gap, strict=True)]
        self.p, self.missed = ((1 - k0) * a, (1 - k0) * b, c - k1 * b), 0
        return None

    def miss(self) -> None:
        """No measurement: the track moves on, and then its velocity decays, the faster the longer nothing is seen."""
        self.missed += 1
        if self.x:
            self._predict()
            self.v = [v * self.decay ** min(self.missed, 30) for v in self.v]


def kalman(df: DataFrame, key: Names, order: Names, values: Names, seen: str | None = None, first_seen: bool = False, **constants: float) -> DataFrame:
    """est_0, vel_0, … per value and ``missed``: a filtered track; rows whose ``seen`` is false only predict.

    A measurement more than ``far`` from the track is ignored if the row before was measured; else one more
    than ``lost`` away starts the track anew. While nothing is seen the track moves on and its velocity
    decays. Null until the first measurement, which with ``first_seen`` is a key's first row.
    """

    def step(s: Kalman, row: dict) -> tuple:
        if seen is None or row[seen] or (first_seen and not s.x):
            s.see([row[v] for v in values])
        else:
            s.miss()
        if not s.x:
            return (None,) * (2 * len(values) + 1)
        return (*(z for pair in zip(s.x, s.v, strict=True) for z in pair), s.missed)

    ddl = ", ".join(f"est_{i} double, vel_{i} double" for i in range(len(values)))
    return ordered_fold(df, key, order, lambda: Kalman(**constants), step, f"{ddl}, missed int")


def choose_classic(df: DataFrame, key: Names, order: Names, ball: tuple[str, str], crowd: tuple[str, str], width: float = 1280.0, height: float = 720.0, short: int = 10, long: int = 90) -> DataFrame:
    """target_x, target_y and mode: the ball; its last place for fewer than ``short`` rows; the players' centre while a
    ball was seen fewer than ``long`` rows ago; else ``home``, the middle. Nulls are balls and players not seen."""
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    row = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    numbered = df.withColumn("__row", row)
    last = F.last(F.when(F.col(ball[0]).isNotNull(), F.struct(F.col("__row").alias("row"), F.col(ball[0]).alias("x"), F.col(ball[1]).alias("y"))), ignorenulls=True).over(so_far)
    since = F.col("__row") - F.col("__last.row")
    near = F.when(since == 0, F.lit("ball")).when(since < short, F.lit("last_ball")).when((since < long) & F.col(crowd[0]).isNotNull(), F.lit("players"))
    chosen = numbered.withColumn("__last", last).withColumn("mode", F.coalesce(near, F.lit("home")))
    at = lambda part, c, home: F.when(F.col("mode").isin("ball", "last_ball"), F.col("__last")[part]).when(F.col("mode") == "players", F.col(c)).otherwise(F.lit(home))
    return chosen.withColumns({"target_x": at("x", crowd[0], width / 2), "target_y": at("y", crowd[1], height / 2)}).drop("__row", "__last")


def choose_blend(df: DataFrame, trusted: str, ball: tuple[str, str], last: tuple[str, str], since: str, velocity: tuple[str, str], crowd: tuple[str, str], width: float = 1280.0, height: float = 720.0, short: int = 10) -> DataFrame:
    """target_x, target_y and mode: a mean of the ball, the players and the middle by weight.

    A trusted ball weighs 3, and a fifth of its speed, up to 3, more. Else its ``last`` place fades over
    ``short`` rows: from 2.5, moved on by half its velocity, where it was faster than 2 and is gone for fewer
    than 15 rows, and from 1.5 where not. Players weigh 0.7, the middle, at 0.42 of the height, 0.2. The mode
    goes by the ball's weight: over 2 ``ball``, over 0.5 ``last_ball``. All of it are expressions over a row;
    last place, rows since and velocity are made before by windows.
    """
    x, y = (F.col(c) for c in velocity)
    speed, gone = F.hypot(x, y), F.col(since)
    seen, known = F.col(trusted) & F.col(ball[0]).isNotNull(), F.col(last[0]).isNotNull()
    fast = (speed > 2.0) & (gone < 15)
    fade = F.greatest(F.lit(0.0), 1 - gone / short)
    weight = F.coalesce(F.when(seen, 3 + F.least(F.lit(3.0), speed / 5)).when(known & fast, 2.5 * fade).when(known, 1.5 * fade), F.lit(0.0))
    group = F.when(F.col(crowd[0]).isNotNull(), F.lit(0.7)).otherwise(F.lit(0.0))
    moved = lambda k, most: F.when(fast, F.least(F.greatest(F.col(last[k]) + F.col(velocity[k]) * gone * 0.5, F.lit(0.0)), F.lit(most))).otherwise(F.col(last[k]))
    place = lambda k, most, home: F.coalesce(F.when(seen, F.col(ball[k])).when(known, moved(k, most)), F.lit(home))
    mean = lambda k, most, home: (F.col("__ball") * place(k, most, home) + F.col("__group") * F.coalesce(F.col(crowd[k]), F.lit(home)) + 0.2 * home) / (F.col("__ball") + F.col("__group") + 0.2)
    mode = F.when(F.col("__ball") > 2, "ball").when(F.col("__ball") > 0.5, "last_ball").when(F.col("__group") > 0, "players").otherwise("centre")
    weighed = df.withColumns({"__ball": weight, "__group": group})
    return weighed.withColumns({"target_x": mean(0, width, width / 2), "target_y": mean(1, height, height * 0.42), "mode": mode}).drop("__ball", "__group")


def choose_kalman(
    df: DataFrame, key: Names, order: Names, ball: tuple[str, str], conf: str, players: str, cluster: tuple[str, str], crowd: tuple[str, str],
    width: float = 1280.0, height: float = 720.0, high: float = 0.5, gate: float = 200.0, fresh: int = 10, old: int = 45, edge: float = 0.8, **constants: float,
) -> DataFrame:
    """target_x, target_y and mode, by the first rule that applies to a row:

    - ``ball_highconf``: a ball of confidence ``high`` or more, within ``gate`` of the track, as it was seen;
    - ``ball``: the track, if a ball was seen fewer than ``fresh`` rows ago;
    - ``kalman_blend``, ``kalman``: the track, if fewer than ``old`` rows ago, mostly, and for the rest the players' cluster
      or, of four players or more, their weighted centre ``crowd``; a track that leaves the picture is forgotten;
    - ``players``: a cluster beyond ``edge`` of half the width, else ``hold`` in the middle;
    - ``few_players``: two or more without a cluster, a fifth of the way to their centre if that is beyond the edge, else ``hold``;
    - ``single_player``: a twentieth of the way; ``centre``: nobody there.

    The track is a Kalman filter over the ball. Cluster and crowd are features of a row, made before by the
    cluster and centroid operators; null where there is none.
    """
    middle = width / 2, height / 2

    def mixed(weight: float, a: tuple, b: tuple) -> tuple[float, float]:
        return weight * a[0] + (1 - weight) * b[0], weight * a[1] + (1 - weight) * b[1]

    def off(x: float) -> float:
        return abs(x - middle[0]) / middle[0]

    def choose(k: Kalman, row: dict) -> tuple[tuple[float, float], str]:
        n = row[players] or 0
        group = (row[cluster[0]], row[cluster[1]]) if n >= 2 and row[cluster[0]] is not None else None
        centre = (row[crowd[0]], row[crowd[1]])
        if row[ball[0]] is not None:
            at = [row[ball[0]], row[ball[1]]]
            k.see(at)
            if row[conf] >= high and (k.missed >= old or k.away(at) <= gate):
                return tuple(at), "ball_highconf"
        else:
            k.miss()
        if k.x and k.missed < fresh:
            return tuple(k.x), "ball"
        if k.x and k.missed < old:
            here = tuple(k.x)
            if 0 <= here[0] <= width and 0 <= here[1] <= height:
                weight = max(0.85, 0.9 * (1 - k.missed / old))
                if group:
                    return mixed(weight, here, group), "kalman_blend"
                return (mixed(weight, here, centre), "kalman_blend") if n >= 4 else (here, "kalman")
            k.forget()
        if group:
            return (group, "players") if off(group[0]) >= edge else (middle, "hold")
        if n >= 2:
            return (mixed(0.2, centre, middle), "few_players") if off(centre[0]) >= edge else (middle, "hold")
        return (mixed(0.05, centre, middle), "single_player") if n == 1 else (middle, "centre")

    def step(k: Kalman, row: dict) -> tuple:
        (x, y), mode = choose(k, row)
        return x, y, mode

    return ordered_fold(df, key, order, lambda: Kalman(**constants), step, "target_x double, target_y double, mode string")


def choose_kalman_older(
    df: DataFrame, key: Names, order: Names, ball: tuple[str, str], conf: str, players: str, crowd: tuple[str, str],
    width: float = 1280.0, height: float = 720.0, high: float = 0.5, fresh: int = 10, old: int = 45, weights: tuple[float, float] = (0.9, 0.3), **constants: float,
) -> DataFrame:
    """target_x, target_y and mode by the cascade's older rules: no gate, no edge, no cluster, and a track that is never forgotten.

    A ball of confidence ``high`` as it was seen; the track while fresh; then, of four players or more, a mean of the
    track and their weighted centre, the track's weight going from the first to the second of ``weights`` as it ages,
    or else the track alone; ``players``, ``few_players`` (a fifth of the way from the middle), ``single_player`` (a
    twentieth) and ``centre`` without one.
    """
    middle = width / 2, height / 2

    def step(k: Kalman, row: dict) -> tuple:
        n, centre = row[players] or 0, (row[crowd[0]], row[crowd[1]])
        mixed = lambda w, a, b: (w * a[0] + (1 - w) * b[0], w * a[1] + (1 - w) * b[1])
        if row[ball[0]] is not None:
            at = (row[ball[0]], row[ball[1]])
            k.see(list(at))
            if row[conf] >= high:
                return *at, "ball_highconf"
        else:
            k.miss()
        if k.x and k.missed < old:
            here = tuple(k.x)
            if k.missed < fresh:
                return *here, "ball"
            age = k.missed / old
            return (*mixed(weights[0] * (1 - age) + weights[1] * age, here, centre), "kalman_blend") if n >= 4 else (*here, "kalman")
        if n >= 4:
            return *centre, "players"
        if n >= 2:
            return *mixed(0.2, centre, middle), "few_players"
        return (*mixed(0.05, centre, middle), "single_player") if n == 1 else (*middle, "centre")

    return ordered_fold(df, key, order, lambda: Kalman(**constants), step, "target_x double, target_y double, mode string")


def choose_before_kalman(
    df: DataFrame, key: Names, order: Names, ball: tuple[str, str], conf: str, players: str, mean: tuple[str, str], crowd: tuple[str, str],
    width: float = 1280.0, height: float = 720.0, high: float = 0.5, confirm: int = 3, short: int = 10, long: int = 90,
) -> DataFrame:
    """target_x, target_y and mode by the rules before there was a track, all of it windows and expressions:

    - ``ball_highconf``: a ball of confidence ``high`` or more;
    - ``ball``: its last place for fewer than ``short`` rows, once it has been trusted: seen with that confidence, or in
      ``confirm`` rows in a row;
    - ``blend``, ``last_ball``: for fewer than ``long`` rows, from its last place to the players' plain ``mean`` as it ages,
      or its last place without players;
    - ``players``, of four or more their weighted centre ``crowd``; ``few_players``, ``single_player`` a fifth and a twentieth of
      the way from the middle; ``centre``.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    seen, n = F.col(ball[0]).isNotNull(), F.coalesce(F.col(players), F.lit(0))
    rows = df.withColumn("__row", F.row_number().over(w))
    rows = rows.withColumn("__last", F.last(F.when(seen, F.struct(F.col("__row").alias("row"), F.col(ball[0]).alias("x"), F.col(ball[1]).alias("y"))), ignorenulls=True).over(so_far))
    # rows in a row with a ball: those since the last one without
    rows = rows.withColumn("__hits", F.col("__row") - F.coalesce(F.max(F.when(~seen, F.col("__row"))).over(so_far), F.lit(0)))
    rows = rows.withColumn("__trusted", F.max(seen & ((F.col(conf) >= high) | (F.col("__hits") >= confirm))).over(so_far))
    since = F.col("__row") - F.col("__last.row")
    near = F.when(seen & (F.col(conf) >= high), "ball_highconf").when(F.col("__trusted") & (since < short), "ball").when((since < long) & (n > 0), "blend").when(since < long, "last_ball")
    far = F.when(n >= 4, "players").when(n >= 2, "few_players").when(n == 1, "single_player").otherwise("centre")
    rows = rows.withColumns({"mode": F.coalesce(near, far), "__age": since / long})
    mode = F.col("mode")

    def at(part: str, k: int, middle: float) -> Column:
        last, group = F.col("__last")[part], F.col(crowd[k])
        alone = F.when(mode.isin("ball_highconf", "ball", "last_ball"), last).when(mode == "blend", (1 - F.col("__age")) * last + F.col("__age") * F.col(mean[k]))
        return alone.when(mode == "players", group).when(mode == "few_players", 0.2 * group + 0.8 * middle).when(mode == "single_player", 0.05 * group + 0.95 * middle).otherwise(F.lit(middle))

    return rows.withColumns({"target_x": at("x", 0, width / 2), "target_y": at("y", 1, height / 2)}).drop("__row", "__last", "__hits", "__trusted", "__age")


def reanchor(
    df: DataFrame, key: Names, order: Names, time: str, players: str, far: str, target: str, detected: str | None = None, backstop: float = 60.0, cooldown: float = 10.0,
    single: int = 60, nobody: int = 30, confirms: int = 2, every: int = 1, gain: float = 0.15, most: float = 3.0, limit: float = 180.0,
) -> DataFrame:
    """pan, trigger and mode: the pan goes towards an aim that is taken from ``target`` anew when a trigger fires.

    The first row is ``startup``. Later, at least ``cooldown`` after the last trigger, the first that holds:
    ``backstop`` after that time, ``single_player`` and ``centre`` after so many frames with one player or
    fewer and with none, ``ball_far`` after ``confirms`` rows in a row with ``far``. The counts are of the rows
    before, of those with ``detected`` only, each for ``every`` frames, and start anew with a trigger. A step is
    ``gain`` of the way and ``most`` at most; mode is ``hold`` within one degree of the aim, else ``players``.
    """

    def step(s: dict, row: dict) -> tuple:
        t = row[time]
        trigger = None
        if "at" not in s:
            trigger = "startup"
        elif t - s["at"] >= cooldown:
            holds = {"backstop": t - s["at"] >= backstop, "single_player": s["single"] >= single, "centre": s["nobody"] >= nobody, "ball_far": s["far"] >= confirms}
            trigger = next((name for name, fired in holds.items() if fired), None)
        if trigger:
            s.update(at=t, aim=row[target], single=0, nobody=0, far=0)
        pan = s.get("pan", 0.0)
        away = s["aim"] - pan
        s["pan"] = max(-limit, min(limit, pan + max(-most, min(most, gain * away))))
        if detected is None or row[detected]:
            n = row[players] or 0
            s["single"] = s["single"] + every if n <= 1 else 0
            s["nobody"] = s["nobody"] + every if n == 0 else 0
            s["far"] = s["far"] + 1 if row[far] else 0
        return s["pan"], trigger, "hold" if abs(away) < 1.0 else "players"

    return ordered_fold(df, key, order, dict, step, "pan double, trigger string, mode string")


def online_centres(df: DataFrame, key: Names, order: Names, feature: str, centres: list[list[float]], beta: float = 0.02, most: float = 2.5, farthest: float = 6.0, least_margin: float = 0.05) -> DataFrame:
    """assigned, margin and distance to the nearest unit centre, which then moves a little towards the feature and is normalised.

    A feature farther than ``farthest``, or nearer to the second centre by less than ``least_margin``, is not
    assigned and moves nothing; one of ``most`` or farther is assigned and moves nothing.
    """

    def step(s: list, row: dict) -> tuple:
        f = row[feature]
        d = [math.sqrt(sum((a - b) ** 2 for a, b in zip(c, f, strict=True))) for c in s]
        best = min(range(len(s)), key=d.__getitem__)
        margin = sorted(d)[1] - d[best]
        if d[best] > farthest or margin < least_margin:
            return None, margin, d[best]
        if d[best] < most:
            moved = [(1 - beta) * a + beta * b for a, b in zip(s[best], f, strict=True)]
            norm = math.sqrt(sum(a * a for a in moved)) + 1e-8
            s[best] = [a / norm for a in moved]
        return best, margin, d[best]

    return ordered_fold(df, key, order, lambda: [list(c) for c in centres], step, "assigned int, margin double, distance double")
