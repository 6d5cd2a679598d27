"""Detection in tiles: frames are cut into overlapping tiles, the model hook sees these, and boxes go back to the frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kickframe.operators.boxes import suppress
from kickframe.operators.masks import tile_coverage
from kickframe.sources.readers import detect

#: Smallest side of a tile, smallest step, and share of a tile that the next one covers again.
LEAST_TILE, LEAST_STEP, OVERLAP = 64, 32, 0.2
#: A frame gets a second pass with fewer boxes, or a smaller median share of the view; that covers so much of its height.
FEW, SMALL, BAND, BAND_FEW = 10, 0.0025, 0.55, 0.70
#: Tiles with a smaller share of the mask are passed over; boxes that overlap so much, or are so near, are one.
LEAST_COVERAGE, LEAST_IOU, CENTRE = 0.02, 0.55, 0.35


def _spans(size: Column, tile: int | Column, overlap: float, least_tile: int) -> Column:
    """(from, to) of the tiles of a length: each a step on, the last flush with the end."""
    t = F.greatest(F.lit(least_tile), F.least(tile if isinstance(tile, Column) else F.lit(tile), size))
    step = F.greatest(F.lit(LEAST_STEP), t - F.floor(t * overlap).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((size - t) / step).cast("int")) * step, step)
    return F.transform(starts, lambda s: F.struct(F.greatest(F.lit(0), F.least(size, s + t) - t).alias("a"), F.least(size, s + t).alias("b")))


def tile_grid(width: Column, height: Column, tile: tuple[int, int], overlap: float = OVERLAP, least_tile: int = LEAST_TILE) -> Column:
    """Array of struct(x1, y1, x2, y2): tiles that cover a view row by row, none smaller than ``least_tile`` but where the view is."""
    columns, rows = _spans(width, tile[0], overlap, least_tile), _spans(height, tile[1], overlap, least_tile)
    corner = lambda r, c: F.struct(c["a"].cast("int").alias("x1"), r["a"].cast("int").alias("y1"), c["b"].cast("int").alias("x2"), r["b"].cast("int").alias("y2"))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: corner(r, c))))


def cut_tiles(frames: DataFrame, keys: list[str], pixels: str, width: str, tiles: str, channels: int = 3) -> DataFrame:
    """(keys, x1, y1, x2, y2, pixels, width, height): a row for each tile of the array column ``tiles``, with its own pixels.

    A frame's bytes are read once for all of its tiles; frames without pixels, and tiles outside them, give no rows.
    """
    schema = StructType([*[frames.schema[k] for k in keys], *StructType.fromDDL("x1 int, y1 int, x2 int, y2 int, pixels binary, width int, height int").fields])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, w, wanted = (batch.column(len(keys) + k)[i].as_py() for k in range(3))
                if not data or not w or not wanted:
                    continue
                frame = np.frombuffer(data, np.uint8)[: len(data) // (w * channels) * w * channels].reshape(-1, w, channels)
                rows = []
                for t in wanted:
                    part = frame[max(t["y1"], 0) : max(t["y2"], 0), max(t["x1"], 0) : max(t["x2"], 0)]
                    if part.size:
                        rows.append((*t.values(), part.tobytes(), part.shape[1], part.shape[0]))
                if rows:  # a batch for each frame, so memory is bounded by one frame's tiles
                    own = [pa.array([batch.column(k)[i].as_py()] * len(rows), arrow.field(k).type) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[len(keys) :], strict=True)]], schema=arrow)

    return frames.select(*keys, pixels, width, tiles).mapInArrow(cut, schema)


def detect_tiles(frames: DataFrame, keys: list[str], pixels: str, width: str, tiles: str, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], channels: int = 3) -> DataFrame:
    """(keys, x1, y1, x2, y2, conf): what the model finds in the tiles, in the frame's pixels.

    The model gets batches of (tile, pixels, width, height), where ``tile`` is a struct it hands on, and returns rows of
    (tile, x1, y1, x2, y2, conf) in the tile's pixels.
    """
    key_types = ",".join(f"{k}:{frames.schema[k].dataType.simpleString()}" for k in keys)
    cut = cut_tiles(frames, keys, pixels, width, tiles, channels)
    named = cut.select(F.struct(*keys, "x1", "y1").alias("tile"), "pixels", "width", "height")
    found = detect(named, make_model, f"tile struct<{key_types},x1:int,y1:int>, x1 double, y1 double, x2 double, y2 double, conf double")
    back = [(F.col(c) + F.col("tile")[c[0] + "1"]).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return found.select(*[F.col("tile")[k].alias(k) for k in keys], *back, "conf")


def merged(boxes: DataFrame, keys: list[str], least_iou: float = LEAST_IOU, centre_share: float | None = CENTRE) -> DataFrame:
    """(keys, x1, y1, x2, y2, conf): boxes of a frame of which none overlaps a better one, or is too near to it; across tiles and passes."""
    order = F.xxhash64("x1", "y1", "x2", "y2", "conf")
    struct = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf")], order.alias("id"))
    kept = suppress(boxes.select(F.struct(*keys).alias("__frame"), struct.alias("__box")), "__frame", "__box", least_iou, centre_share)
    rows = kept.select("__frame", F.explode("kept").alias("b"))
    return rows.select(*[F.col("__frame")[k].alias(k) for k in keys], *[F.col("b")[c].alias(c) for c in ("x1", "y1", "x2", "y2", "conf")])


def sliced(frames: DataFrame, keys: list[str], pixels: str, width: str, height: str, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], tile: tuple[int, int] = (960, 540), overlap: float = OVERLAP, channels: int = 3, least_tile: int = LEAST_TILE) -> DataFrame:
    """Boxes of frames by tiles alone, one where tiles saw the same thing twice."""
    tiled = frames.withColumn("__tiles", tile_grid(F.col(width), F.col(height), tile, overlap, least_tile))
    return merged(detect_tiles(tiled, keys, pixels, width, "__tiles", make_model, channels), keys)


def two_passes(
    frames: DataFrame,
    keys: list[str],
    index: str,
    pixels: str,
    width: str,
    height: str,
    make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    masks: DataFrame | None = None,
    tile: tuple[int, int] = (960, 540),
    every: int = 1,
    few: int = FEW,
    channels: int = 3,
    least_tile: int = LEAST_TILE,
) -> DataFrame:
    """(keys, x1, y1, x2, y2, conf): a pass over whole frames, and one over tiles of the upper band where it found too little.

    A frame gets the second pass if the first finds fewer than ``few`` boxes, or boxes whose median area is less than SMALL
    of the view, but only where ``index`` is divisible by ``every``. Its band is BAND of the height, BAND_FEW if it has few
    boxes, 64 rows at least. Tiles of which the mask (runs, as ``masks.mask_runs`` gives them) covers less than
    LEAST_COVERAGE are passed over. Boxes of a frame without a second pass are as the model gave them.
    """
    whole = F.array(F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col(width).cast("int").alias("x2"), F.col(height).cast("int").alias("y2")))
    first = detect_tiles(frames.withColumn("__tiles", whole), keys, pixels, width, "__tiles", make_model, channels)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    seen = first.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile(area, F.lit(0.5)).alias("__median"))
    judged = frames.select(*keys, index, pixels, width, height).join(seen, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    lacking = F.col("__n") < few
    small = F.coalesce(F.col("__median") / (F.col(width) * F.col(height)) < SMALL, F.lit(False))
    again = judged.where((lacking | small) & (F.col(index) % every == 0))
    band = F.greatest(F.lit(64), F.least(F.col(height), F.bround(F.col(height) * F.when(lacking, F.lit(BAND_FEW)).otherwise(F.lit(BAND))).cast("int")))
    tiled = again.withColumn("__tiles", tile_grid(F.col(width), band, tile, OVERLAP, least_tile))
    if masks is not None:
        rows = tiled.select(*keys, F.explode("__tiles").alias("t")).select(*keys, "t.*").distinct()
        enough = tile_coverage(rows, masks, keys).where(F.coalesce(F.col("coverage") >= LEAST_COVERAGE, F.lit(True)))
        kept = enough.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("__tiles"))
        tiled = tiled.drop("__tiles").join(kept, keys)
    second = detect_tiles(tiled, keys, pixels, width, "__tiles", make_model, channels)
    twice = again.select(*keys)
    both = first.join(twice, keys, "left_semi").unionByName(second)
    return first.join(twice, keys, "left_anti").unionByName(merged(both, keys))
