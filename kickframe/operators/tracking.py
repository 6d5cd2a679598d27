"""Greedy tracking of boxes over frames, with the label that most votes give a track."""

from __future__ import annotations

from collections import deque
from itertools import chain
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from kickframe.operators.folds import ordered_fold


def _iou(a: tuple, b: tuple) -> float:
    a1, b1, a2, b2 = a
    x1, y1, x2, y2 = b
    # conditions, for calls of min and max take most of the time
    w, h = (x2 if x2 < a2 else a2) - (x1 if x1 > a1 else a1), (y2 if y2 < b2 else b2) - (y1 if y1 > b1 else b1)
    both = (w if w > 0 else 0.0) * (h if h > 0 else 0.0)
    w, h, v, u = a2 - a1, b2 - b1, x2 - x1, y2 - y1
    union = (w if w > 0 else 0.0) * (h if h > 0 else 0.0) + (v if v > 0 else 0.0) * (u if u > 0 else 0.0) - both
    return both / union if union > 0 else 0.0


#: Boxes of a clip that are held against its tracks, and each other, at once; and the most pairs of such.
RUN, PAIRS = 256, 1 << 20
#: Numbers beyond it are not exact as doubles.
_EXACT = 2.0**52


def _may_overlap(a: list[tuple], b: list[tuple], least: float) -> np.ndarray:
    """For each box of ``a`` those of ``b`` that may overlap it by ``least``; leaves out only what certainly does not, so
    nulls, NaN and numbers that are no exact doubles are left to the caller."""
    p, q = (np.array(boxes, float).reshape(-1, 4).T for boxes in (a, b))
    p, q = (np.where(np.abs(x) > _EXACT, np.nan, x) for x in (p[:, :, None], q))
    share = (1 - 1e-6) * least
    area = lambda c: np.maximum(c[2] - c[0], 0.0) * np.maximum(c[3] - c[1], 0.0) * share
    both = np.minimum(p[2], q[2])
    both -= np.maximum(p[0], q[0])
    np.maximum(both, 0.0, out=both)
    high = np.minimum(p[3], q[3])
    high -= np.maximum(p[1], q[1])
    both *= np.maximum(high, 0.0, out=high)
    both *= 1 + share
    return ~(both < np.add(area(p), area(q), out=high))


def _overlaps(a: list[tuple], b: list[tuple], least: float, before: int) -> tuple[list[int], list[int], list[float]]:
    """Where the partners of each box of ``a`` end, the partners (places in ``b``, from ``before`` on only of boxes before it), and
    what both overlap by: leaves out what overlaps by less than ``least``; NaN is left to the caller."""
    if {*map(type, chain.from_iterable(a))} == {float}:
        p, q = (np.array(boxes, float).reshape(-1, 4).T for boxes in (a, b))
        p = p[:, :, None]
        with np.errstate(all="ignore"):
            # the operations of _iou in their order, so the same doubles; where NaN would go another way, all is NaN
            size = [np.maximum(c[2] - c[0], 0.0) * np.maximum(c[3] - c[1], 0.0) for c in (p, q)]
            both = np.minimum(p[2], q[2])
            both -= np.maximum(p[0], q[0])
            np.maximum(both, 0.0, out=both)
            high = np.minimum(p[3], q[3])
            high -= np.maximum(p[1], q[1])
            both *= np.maximum(high, 0.0, out=high)
            union = np.add(size[1], size[0], out=high)
            union -= both
            over = np.divide(both, union, out=np.zeros_like(both), where=~(union <= 0))
        near = ~(over < least)
    else:
        near, over = _may_overlap(a, b, least), None
    row, other = np.nonzero(np.tril(near, before - 1))
    ends = np.searchsorted(row, np.arange(1, len(a) + 1)).tolist()
    return ends, other.tolist(), [np.nan] * len(other) if over is None else over[row, other].tolist()


class _Tracks:
    def __init__(self) -> None:
        self.frame, self.next, self.tracks = None, 1, {}


def track(df: DataFrame, clip: list[str], frame: str, order: list[str], box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), vote: str | None = None, least_iou: float = 0.3, forget: int = 10, reuse_new: bool = True, history: int = 15, min_votes: int = 4, ratio: float = 0.65) -> DataFrame:
    """track_id and label of each box: in order, a box takes the free track that overlaps it most, or starts one.

    A track is forgotten after more than ``forget`` frames without a box. With ``reuse_new`` a track begun in
    a frame may be taken by a later box of that frame. The label is the commonest of the track's last
    ``history`` votes if it has enough of them, the first of equals; null otherwise. ``least_iou`` is above 0.
    """

    names = list(box)

    def begin(s: _Tracks, now: Any) -> None:
        if now != s.frame:
            s.frame = now
            s.tracks = {k: t for k, t in s.tracks.items() if now - t["seen"] <= forget + 1}
            for t in s.tracks.values():
                t["used"] = False

    def better(o: tuple, b: tuple, score: float) -> float:
        """What a track's box overlaps ``b`` by, or -1 if by less than ``score``."""
        # most boxes are apart, which two comparisons show
        if o[0] >= b[2] or o[2] <= b[0] or o[1] >= b[3] or o[3] <= b[1]:
            return -1.0
        over = _iou(o, b)
        return over if over >= score else -1.0

    def take(s: _Tracks, best: int | None, b: tuple, voted: str | None) -> tuple[int, str | None]:
        if best is None:
            best, s.next = s.next, s.next + 1
            t = s.tracks[best] = {"votes": deque(maxlen=history), "used": not reuse_new, "label": None}
        else:
            t = s.tracks[best]
            t["used"] = True
        t["box"], t["seen"] = b, s.frame
        if voted is not None:
            votes = t["votes"]
            votes.append(voted)
            t["label"] = None
            if len(votes) >= min_votes:
                top = max(dict.fromkeys(votes), key=votes.count)
                n = votes.count(top)
                if n >= min_votes and n / len(votes) >= ratio:
                    t["label"] = top
        return best, t["label"]

    def step(s: _Tracks, row: dict) -> tuple:
        begin(s, row[frame])
        b = tuple(map(row.__getitem__, names))
        best, score = None, least_iou
        for k, t in s.tracks.items():
            if not t["used"] and (over := better(t["box"], b, score)) >= 0 and (best is None or over > score):
                best, score = k, over
        return take(s, best, b, None if vote is None else row[vote])

    def steps(s: _Tracks, lists: dict, start: int, end: int) -> list[tuple]:
        made: list[tuple] = []
        while start < end:
            first, start = start, min(end, start + max(1, min(RUN, PAIRS // (len(s.tracks) + RUN))))
            own = list(zip(*(lists[c][first:start] for c in names), strict=True))
            # a track's box is that of a row, so all rows are held at once against the tracks there are and the rows before them
            ends, other, overs = _overlaps(own, [*(t["box"] for t in s.tracks.values()), *own], least_iou, len(s.tracks))
            # the track whose box each is, and where a track's box stands
            owner, stands, x = [*s.tracks, *[0] * len(own)], {k: j for j, k in enumerate(s.tracks)}, 0
            voted = lists[vote][first:start] if vote is not None else [None] * len(own)
            for i, (now, b, v, y) in enumerate(zip(lists[frame][first:start], own, voted, ends, strict=True), len(stands)):
                if now != s.frame:
                    begin(s, now)
                best, score = None, least_iou
                for j, over in zip(other[x:y], overs[x:y], strict=True):
                    k = owner[j]
                    if not k or (t := s.tracks.get(k)) is None or t["used"]:
                        continue
                    if over != over:
                        over = better(t["box"], b, score)
                    # of equals the first track
                    if over > score or (over == score and (best is None or k < best)):
                        best, score = k, over
                x = y
                made.append(take(s, best, b, v))
                k = made[-1][0]
                if k in stands:
                    owner[stands[k]] = 0
                owner[i], stands[k] = k, i
        return made

    return ordered_fold(df, clip, [frame, *order], _Tracks, step, "track_id int, label string", steps)
