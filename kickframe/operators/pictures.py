"""Pictures as packed pixels: statistics of strips, colour tests and kit features, in Arrow batches without an image library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Share of a box's height that is torso, and of its width that is left out on either side.
TORSO, SIDE = (0.08, 0.48), 0.20
#: Grass in hue (of 180), least saturation and brightness.
GRASS_HUE, GRASS_SATURATION, GRASS_VALUE = (35, 95), 40, 15
#: Least pixels of a crop after scaling, of what is not grass, and least share of that.
LEAST_PIXELS, LEAST_KEPT, LEAST_SHARE = 12 * 12, 10, 0.10
#: Bins of hue, saturation and brightness; side to which crops are scaled.
BINS, CROP = (18, 6, 6), 64


def is_green(r: Column, g: Column, b: Column, by: int = 20) -> Column:
    """Whether green exceeds both other channels by more than ``by``."""
    return (g - r > by) & (g - b > by)


def within(h: Column, s: Column, v: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Whether each channel is between its bounds, both included."""
    tests = [(c >= a) & (c <= b) for c, a, b in zip((h, s, v), low, high, strict=True)]
    return tests[0] & tests[1] & tests[2]


def hue_saturation_value(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 179), saturation and value (0 to 255) of channels of 0 to 255, halves rounded up."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span = most - least
    safe = F.when(span == 0, F.lit(None)).otherwise(span)
    turn = F.when(most == r, 60.0 * (g - b) / safe).when(most == g, 120 + 60.0 * (b - r) / safe).otherwise(240 + 60.0 * (r - g) / safe)
    hue = F.floor(F.when(turn < 0, turn + 360).otherwise(turn) / 2 + 0.5) % 180
    return F.coalesce(hue, F.lit(0)).cast("int"), F.coalesce(F.floor(255.0 * span / F.when(most == 0, F.lit(None)).otherwise(most) + 0.5), F.lit(0)).cast("int"), most.cast("int")


def _by_row(df: DataFrame, kept: list[str], read: list[str], ddl: str, make: Callable[..., list[tuple]]) -> DataFrame:
    """``kept`` columns of each row with the rows that ``make`` gives for its ``read`` columns."""
    new = StructType.fromDDL(ddl)
    schema = StructType([*[df.schema[k] for k in kept], *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, made = [], []
            for i, values in enumerate(zip(*[batch.column(len(kept) + k) for k in range(len(read))], strict=True)):
                rows = make(*[v.as_py() for v in values])
                which += [i] * len(rows)
                made += rows
            owners = pa.array(which, pa.int64())
            columns = [batch.column(k).take(owners).cast(arrow.field(k).type) for k in range(len(kept))]
            lists = list(zip(*made, strict=True)) if made else [[]] * len(new)
            columns += [pa.array(v, f.type) for v, f in zip(lists, list(arrow)[len(kept) :], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*kept, *read).mapInArrow(run, schema)


def _percentile(counts: np.ndarray, share: float) -> np.ndarray:
    """Of each row of value counts the percentile between the two nearest ranks."""
    total = counts.cumsum(axis=1)
    at = share * (total[:, -1] - 1)
    low = np.floor(at)
    value = lambda rank: (total <= rank[:, None]).sum(axis=1)
    a, b = value(low), value(np.minimum(low + 1, total[:, -1] - 1))
    return a + (b - a) * (at - low)


def strip_rows(pixels: np.ndarray, first: int) -> list[tuple]:
    """(y, n, mean, variance, median, p75) of each row of 8-bit pixels."""
    n, width = pixels.shape
    if not width:
        return []
    counts = np.bincount((np.arange(n)[:, None] * 256 + pixels).reshape(-1), minlength=n * 256).reshape(n, 256)
    values = np.arange(256)
    mean = counts @ values / width
    variance = (counts * (values - mean[:, None]) ** 2).sum(axis=1) / width
    columns = (mean.tolist(), variance.tolist(), _percentile(counts, 0.5).tolist(), _percentile(counts, 0.75).tolist())
    return [(first + y, width, *row) for y, row in enumerate(zip(*columns, strict=True))]


def row_statistics(pictures: DataFrame, keys: list[str], pixels: str, width: str, left: int = 0, right: int | None = None, top: int = 0, bottom: int | None = None) -> DataFrame:
    """(keys, y, n, mean, variance, median, p75): per picture row, over the columns from ``left`` to before ``right``.

    ``pixels`` holds one byte a pixel, row by row; percentiles are exact, by counting. Null pictures, and those of
    no width, have no rows; bytes beyond the last full row are not a row.
    """

    def make(data: bytes | None, w: int | None) -> list[tuple]:
        if data is None or not w or w < 1:
            return []
        picture = np.frombuffer(data, np.uint8)[: len(data) // w * w].reshape(-1, w)
        return strip_rows(picture[top:bottom, left:right], top) if len(picture) else []

    return _by_row(pictures, keys, [pixels, width], "y int, n int, mean double, variance double, median double, p75 double", make)


def patch_colour(pictures: DataFrame, keys: list[str], hsv: str, width: str, x: str, y: str, half: int = 20) -> DataFrame:
    """(keys, hue, saturation, value): the medians of hue and saturation and the 75th percentile of value, cut to whole numbers, of the
    patch of ``half`` pixels around (x, y); ``hsv`` holds three bytes a pixel. Null where the patch is empty."""

    def make(data: bytes | None, w: int | None, cx: int | None, cy: int | None) -> list[tuple]:
        if data is None or not w or cx is None or cy is None:
            return [(None, None, None)]
        picture = np.frombuffer(data, np.uint8)[: len(data) // (3 * w) * 3 * w].reshape(-1, w, 3)
        patch = picture[max(cy - half, 0) : max(cy + half, 0), max(cx - half, 0) : max(cx + half, 0)].reshape(-1, 3)
        if not len(patch):
            return [(None, None, None)]
        counts = np.stack([np.bincount(patch[:, c], minlength=256) for c in range(3)])
        middle = _percentile(counts, 0.5)
        return [(int(middle[0]), int(middle[1]), int(_percentile(counts[2:], 0.75)[0]))]

    return _by_row(pictures, keys, [hsv, width, x, y], "hue int, saturation int, value int", make)


def green_below(pictures: DataFrame, keys: list[str], rgb: str, width: str) -> DataFrame:
    """(keys, green_below): whether the lower half has at least as many green pixels as the upper; true where there is no picture to tell by."""

    def make(data: bytes | None, w: int | None) -> list[tuple]:
        if data is None or not w:
            return [(True,)]
        p = np.frombuffer(data, np.uint8)[: len(data) // (3 * w) * 3 * w].reshape(-1, w, 3).astype(np.int16)
        green = (p[..., 1] - p[..., 0] > 20) & (p[..., 1] - p[..., 2] > 20)
        return [(bool(green[len(p) // 2 :].sum() >= green[: len(p) // 2].sum()),)]

    return _by_row(pictures, keys, [rgb, width], "green_below boolean", make)


def rgb_to_hsv(p: np.ndarray) -> np.ndarray:
    """8-bit hue (0 to 179), saturation and value of (..., 3) 8-bit colours."""
    c = p.astype(np.float64)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    most, span = c.max(axis=-1), c.max(axis=-1) - c.min(axis=-1)
    safe = np.where(span > 0, span, 1)
    turn = np.where(most == r, 60 * (g - b) / safe, np.where(most == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    turn = np.where(span > 0, np.where(turn < 0, turn + 360, turn), 0)
    return np.stack([np.floor(turn / 2 + 0.5) % 180, np.floor(255 * span / np.where(most > 0, most, 1) + 0.5), most], axis=-1).astype(np.uint8)


def rgb_to_lab(p: np.ndarray) -> np.ndarray:
    """8-bit L*a*b* (L scaled to 255, a and b around 128) of (..., 3) 8-bit sRGB colours, for white D65."""
    c = p.astype(np.float64) / 255
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    # fixed values: sRGB to XYZ, and the white point
    matrix = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = linear @ matrix.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lightness = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    lab = np.stack([lightness * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.floor(lab + 0.5), 0, 255).astype(np.uint8)


def scaled(p: np.ndarray, side: int) -> np.ndarray:
    """A picture scaled to ``side`` by ``side``, between the four nearest pixels by their distance."""
    places = []
    for n in p.shape[:2]:
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        places.append((low, np.minimum(low + 1, n - 1), at - low))
    (y0, y1, fy), (x0, x1, fx) = places
    c = p.astype(np.float64)
    top = c[y0][:, x0] * (1 - fx)[None, :, None] + c[y0][:, x1] * fx[None, :, None]
    low = c[y1][:, x0] * (1 - fx)[None, :, None] + c[y1][:, x1] * fx[None, :, None]
    return np.floor(top * (1 - fy)[:, None, None] + low * fy[:, None, None] + 0.5).astype(np.uint8)


def torso(width: int, height: int, x1: float, y1: float, x2: float, y2: float) -> tuple[int, int, int, int] | None:
    """(left, top, right, bottom) of a box's torso within the picture, right and bottom not included; none if empty."""
    held = lambda v, n: min(max(int(v), 0), n - 1)
    x1, x2, y1, y2 = held(x1, width), held(x2, width), held(y1, height), held(y2, height)
    w, h = max(1, x2 - x1), max(1, y2 - y1)
    side = int(SIDE * w)
    left, right = held(x1 + side, width), held(x2 - side, width)
    top, bottom = held(y1 + int(TORSO[0] * h), height), held(y1 + int(TORSO[1] * h), height)
    return (left, top, right, bottom) if right > left and bottom > top else None


def kit_feature(crop: np.ndarray, side: int = CROP) -> np.ndarray | None:
    """The unit vector of a torso's colours without grass: mean and spread of L*a*b*, then densities of hue, saturation and value.

    None where too little is left: a crop of fewer pixels than LEAST_PIXELS after scaling, or one that is nearly all grass.
    """
    hsv, lab = rgb_to_hsv(crop), rgb_to_lab(crop)
    if side:
        hsv, lab = scaled(hsv, side), scaled(lab, side)
    if hsv.shape[0] * hsv.shape[1] < LEAST_PIXELS:
        return None
    h, s, v = hsv[..., 0], hsv[..., 1], hsv[..., 2]
    kept = ~((h >= GRASS_HUE[0]) & (h <= GRASS_HUE[1]) & (s >= GRASS_SATURATION) & (v >= GRASS_VALUE))
    if kept.mean() < LEAST_SHARE or kept.sum() < LEAST_KEPT:
        return None
    colours = lab[kept].astype(np.float64)
    parts = [colours.mean(axis=0), colours.std(axis=0)]
    for channel, bins, end in zip((h, s, v), BINS, (180, 256, 256), strict=True):
        parts.append(np.histogram(channel[kept], bins=bins, range=(0, end), density=True)[0])
    feature = np.concatenate(parts)
    return feature / (np.linalg.norm(feature) + 1e-8)


def kit_features(boxes: DataFrame, keys: list[str], rgb: str, width: str, box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), side: int = CROP) -> DataFrame:
    """(keys, feature array<double>): the kit feature of each box of a picture, ``rgb`` of three bytes a pixel; null where none can be had.

    ``rgb`` may be the whole frame, or the box's own crop, in which the box is then given. One vectorised pass a
    box; nothing is shuffled.
    """

    def make(data: bytes | None, w: int | None, *corners: float | None) -> list[tuple]:
        if data is None or not w or any(c is None for c in corners):
            return [(None,)]
        picture = np.frombuffer(data, np.uint8)[: len(data) // (3 * w) * 3 * w].reshape(-1, w, 3)
        place = torso(w, len(picture), *corners) if len(picture) else None
        found = kit_feature(picture[place[1] : place[3], place[0] : place[2]], side) if place else None
        return [(None if found is None else found.tolist(),)]

    return _by_row(boxes, keys, [rgb, width, *box], "feature array<double>", make)
