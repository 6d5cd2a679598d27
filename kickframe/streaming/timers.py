"""Actions that happen after a delay unless something else happens first, as timers of keyed streams, and the same over tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Seconds after which a recording is saved by itself.
AUTO_SAVE = 30


class _Timed(StatefulProcessor):
    """One state per key, a dict whose ``due`` (milliseconds) is when ``fire`` is to be called with it.

    A row at or after the due time comes after the action, whether or not both are in one batch, so what is put out
    does not depend on how rows are dealt into batches, as long as none is late.
    """

    def __init__(self, key: list[str], at: str, names: list[str], out: list[str], take: Callable[[dict, dict, int], list[tuple]], fire: Callable[[dict], list[tuple]], event_time: bool) -> None:
        self.key, self.at, self.names, self.out = key, at, names, out
        self.take, self.fire, self.event_time = take, fire, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("timed", "data binary")

    def _load(self) -> tuple[dict, int | None]:
        """The state and when its timer goes off."""
        held = self.state.get()
        return pickle.loads(held[0]) if held else ({}, None)

    def _store(self, state: dict, timer: int | None) -> None:
        due = state.get("due")
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if state:
            self.state.update((pickle.dumps((state, due)),))
        elif self.state.exists():
            self.state.clear()

    def _due(self, state: dict, now: int) -> list[tuple]:
        made = []
        while state.get("due") is not None and state["due"] <= now:
            made += self.fire(state)
        return made

    def _frame(self, key: tuple, made: list[tuple]) -> Iterator[pd.DataFrame]:
        if made:
            yield pd.DataFrame([(*key, *m) for m in made], columns=self.out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        (state, timer), made = self._load(), []
        batch = pd.concat(list(rows)).sort_values(self.names, kind="stable", key=lambda c: c if c.name == self.at else c.astype(str))
        arrived = None if self.event_time else timer_values.getCurrentProcessingTimeInMs()
        for values in zip(*[batch[n].tolist() for n in self.names], strict=True):
            row = {n: None if pd.isna(v) else v for n, v in zip(self.names, values, strict=True)}
            if row[self.at] is None:
                continue
            now = row[self.at].value // 1_000_000 if self.event_time else arrived
            made += self._due(state, now)
            made += self.take(state, row, now)
        self._store(state, timer)
        yield from self._frame(key, made)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, timer = self._load()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        made = self._due(state, expired)
        # the timer that went off is gone by itself
        self._store(state, None if timer == expired else timer)
        yield from self._frame(key, made)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, keys: list[str], at: str, columns: list[str], ddl: str, take: Callable, fire: Callable, late: str | None) -> DataFrame:
    """``late`` makes event-time timers that wait for the watermark; without it they go by the cluster's clock."""
    rows = rows.select(*keys, *columns)
    schema = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(ddl).fields])
    processor = _Timed(keys, at, columns, schema.names, take, fire, late is not None)
    if late is not None:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime" if late is not None else "processingTime")


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def _arm(state: dict, row: dict, now: int, delay: str) -> list[tuple]:
    state.clear()
    seconds = row[delay]
    if seconds is not None and seconds > 0:
        state.update(since=now, due=now + round(seconds * 1000))
    return []


def _resume(state: dict) -> list[tuple]:
    made = [(_stamp(state["since"]), _stamp(state["due"]))]
    state.clear()
    return made


class _Arm:
    def __init__(self, delay: str) -> None:
        self.delay = delay

    def __call__(self, state: dict, row: dict, now: int) -> list[tuple]:
        return _arm(state, row, now, self.delay)


def resume_after(rows: DataFrame, keys: list[str], at: str, delay: str, late: str | None = "10 seconds") -> DataFrame:
    """(keys, since, due): the pauses that end by themselves.

    Each row is a change of what a viewer does; one with a ``delay`` of seconds above 0 starts a pause that ends after
    it, if no other row of the viewer comes before. A row at the very end comes after it. A pause fires once. On a
    stream timers go by event time and the watermark ``late``, or by the clock if that is null; a table gives the
    same rows by a window over the next row, those after which no row comes included. Rows without a time are not
    read; rows of one time are taken in the order of their delays as text.
    """
    if rows.isStreaming:
        return _timed(rows, keys, at, [at, delay], "since timestamp, due timestamp", _Arm(delay), _resume, late)
    order = Window.partitionBy(*keys).orderBy(at, F.coalesce(F.col(delay).cast("string"), F.lit("None")))
    due = (F.unix_millis(at) + F.round(F.col(delay) * 1000).cast("bigint")).alias("due")
    seen = rows.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("since"), F.col(delay).alias("__d"), due, F.unix_millis(F.lead(at).over(order)).alias("__next"))
    fired = seen.where("__d > 0 AND (__next IS NULL OR __next >= due)")
    return fired.select(*keys, "since", F.timestamp_millis("due").alias("due"))


def _record(state: dict, row: dict, now: int) -> list[tuple]:
    kind, value = row["event"], row["value"]
    if kind == "start":
        state.clear()
        state.update(begin=now, mark=float(value or 0), shift=0.0, due=now + AUTO_SAVE * 1000)
    elif state and kind == "adjust":
        state["shift"] += float(value or 0)
    elif state and kind == "save":
        return _saved(state, now, "manual")
    elif kind == "cancel":
        state.clear()
    return []


def _saved(state: dict, now: int, how: str) -> list[tuple]:
    elapsed = (now - state["begin"]) // 1000
    made = [(state["mark"], max(state["mark"] + 1, state["mark"] + elapsed + state["shift"]), how)]
    state.clear()
    return made


def _auto(state: dict) -> list[tuple]:
    return _saved(state, state["due"], "auto")


def recordings(rows: DataFrame, keys: list[str], at: str, late: str | None = "10 seconds") -> DataFrame:
    """(keys, start, end, saved): the clips that a stream of recorder events makes.

    Events are ``start`` (``value``: the video's time), ``adjust`` (seconds to add to the end), ``save`` and ``cancel``;
    what is neither saved nor cancelled is saved by itself after AUTO_SAVE seconds. A clip lasts as long as it was
    recorded, in whole seconds, plus what was added, and one second at least. Events without a recording do nothing,
    a new start drops the one before. Timers go by event time, or by the clock if ``late`` is null.
    """
    return _timed(rows, keys, at, [at, "event", "value"], "start double, end double, saved string", _record, _auto, late)
