"""Readers of the application's files into normalised tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTR = ("time", "pan", "tilt", "fov", "roll", "distance")
_KEYFRAME = "struct<_id:string," + ",".join(f"_{a}:double" for a in _ATTR) + ">"


def _normal(k: str) -> list[Column]:
    """Milliseconds to seconds, radians to degrees, a missing attribute as 0."""
    value = lambda a: F.coalesce(F.col(f"{k}_{a}"), F.lit(0.0))
    return [F.col(f"{k}_id").alias("kf_id"), (value("time") / 1000).alias("time_s"), *[F.degrees(value(a)).alias(f"{a}_deg") for a in ("pan", "tilt", "fov")]]


def _clip() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[A-Za-z.]*$", 1).alias("clip")


def all_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """(clip, kf_id, time_s, pan_deg, tilt_deg, fov_deg) of every keyframe element, wherever it stands."""
    schema = "_id string, " + ", ".join(f"_{a} double" for a in _ATTR)
    return spark.read.format("xml").option("rowTag", "keyframe").schema(schema).load(path).select(_clip(), *_normal(""))


def keyframes(spark: SparkSession, path: str) -> DataFrame:
    """The keyframes of recordings with the scheme that they belong to; a scheme without any has no rows."""
    schema = f"_id string, timeline struct<recording:array<struct<keyframes:struct<keyframe:array<{_KEYFRAME}>>>>>"
    schemes = spark.read.format("xml").option("rowTag", "scheme").schema(schema).load(path)
    lists = schemes.select(_clip(), F.col("_id").alias("scheme_id"), F.explode("timeline.recording").alias("r"))
    return lists.select("clip", "scheme_id", F.explode("r.keyframes.keyframe").alias("k")).select("clip", "scheme_id", *_normal("k."))


def pan_log(spark: SparkSession, path: str, required: tuple[str, ...] = ("timestamp_s", "predicted_pan_deg")) -> DataFrame:
    """(timestamp_s, predicted_pan_deg, mode, ball_conf); an empty field is null. Raises if a required column is missing."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(required) - set(header))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    kinds = {"timestamp_s": "double", "predicted_pan_deg": "double", "ball_conf": "double"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)
    return spark.read.option("header", True).option("nullValue", "").schema(schema).csv(path)


def manifest(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """(insv, project, calib) of a JSON array; with ``existing`` (a column path) only rows whose three files are there."""
    rows = spark.read.option("multiLine", True).schema("insv string, project string, calib string").json(path)
    if existing is None:
        return rows
    for c in rows.columns:
        rows = rows.join(existing.select(F.col("path").alias(c)).distinct(), c, "left_semi")
    return rows.select("insv", "project", "calib")


_XY = "array<struct<x:double,y:double>>"
_LIST = "array<array<double>>"


def polygons(spark: SparkSession, path: str, frame: tuple[int, int] = (2880, 1440)) -> DataFrame:
    """(source, layout, idx, x, y, frame_w, frame_h) in pixels of calibrations in any of the known layouts.

    Named points take precedence as written: pixels as lists, else shares of the frame as objects. A polygon
    of fewer than three points is left out.
    """
    size = "struct<width:int,height:int>"
    schema = f"pitch_polygon {_LIST}, auto_polygon {_XY}, pixel_polygon {_LIST}, source_frame {size}, equirect_size array<int>, pitch_polygon_equirect {_LIST}, polygon_points {_LIST}, w int, h int, pitch_polygon_360 {_LIST}, equirect struct<in_w:int,in_h:int>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("source", F.col("_metadata.file_path"))
    fw, fh = F.lit(frame[0]), F.lit(frame[1])
    lists = lambda c: F.transform(c, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    shares = F.transform("auto_polygon", lambda p: F.when((p["x"] <= 1) & (p["y"] <= 1), F.struct((p["x"] * fw).alias("x"), (p["y"] * fh).alias("y"))).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    whole = lambda name, points, w, h: F.when(points.isNotNull(), F.struct(F.lit(name).alias("layout"), points.alias("points"), w.cast("int").alias("frame_w"), h.cast("int").alias("frame_h")))
    found = F.coalesce(
        whole("pixels", lists("pitch_polygon"), fw, fh),
        whole("auto", shares, fw, fh),
        whole("source", lists("pixel_polygon"), F.coalesce("source_frame.width", fw), F.coalesce("source_frame.height", fh)),
        whole("equirect", lists("pitch_polygon_equirect"), F.col("equirect_size")[0], F.col("equirect_size")[1]),
        whole("mask", lists("polygon_points"), F.col("w"), F.col("h")),
        whole("360", lists("pitch_polygon_360"), F.col("equirect.in_w"), F.col("equirect.in_h")),
    )
    points = raw.select("source", found.alias("f")).where(F.size("f.points") >= 3)
    return points.select("source", "f.layout", F.posexplode("f.points").alias("idx", "p"), "f.frame_w", "f.frame_h").select("source", "layout", "idx", "p.x", "p.y", "frame_w", "frame_h")


_SEGMENT = "struct<t0:double,rmse:double,mae:double,n:bigint>"


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(approach, clip, segments, overall_rmse, overall_mae): one row per clip; of files with one approach the last by name counts."""
    schema = f"approach string, clips map<string,struct<segments:array<{_SEGMENT}>,overall_rmse:double,overall_mae:double>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    last = raw.groupBy("approach").agg(F.max_by("clips", "file").alias("clips"))
    return last.select("approach", F.explode("clips").alias("clip", "c")).select("approach", "clip", "c.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(split, stem, obj_idx, cls, coords) of label files: one object per line of at least five numbers."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("obj_idx", "line"))
    tokens = lines.withColumn("tokens", F.split(F.trim("line"), r"\s+")).where(F.size("tokens") >= 5)
    split = F.regexp_extract("file", r"/(train|valid|test)/", 1)
    stem = F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1)
    return tokens.select(split.alias("split"), stem.alias("stem"), "obj_idx", F.col("tokens")[0].cast("int").alias("cls"), F.transform(F.slice("tokens", 2, F.size("tokens")), lambda t: t.cast("double")).alias("coords"))


def first_labels(labelled: DataFrame) -> DataFrame:
    """The first object of each file."""
    return labelled.groupBy("split", "stem").agg(F.min_by(F.struct("cls", "coords"), "obj_idx").alias("o")).select("split", "stem", "o.*")


def crop_labels(spark: SparkSession, path: str, wanted: tuple[str, ...] | None = ("team0", "team1", "ref", "other")) -> DataFrame:
    """Crop labels of JSON lines; malformed lines are dropped, labels other than ``wanted`` too."""
    schema = "video string, frame_index bigint, perspective struct<out_w:int,out_h:int,fov_deg:double,yaw_deg:double,pitch_deg:double>, box struct<x1:int,y1:int,x2:int,y2:int>, crop_file string, cfg struct<torso_y1:double,torso_y2:double,torso_xpad:double>, label string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if wanted is None else rows.where(F.col("label").isin(*wanted))


def footage(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size_bytes, modified) of the footage files of a folder: neither hidden nor low-resolution copies."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{insv,INSV}").load(folder).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listed.withColumn("name", name).where(~name.startswith(".") & ~name.startswith("LRV")).select("path", "name", "size_bytes", "modified")


def raw_frames(spark: SparkSession, path: str, width: int, height: int, channels: int = 3) -> DataFrame:
    """(source, frame_idx, pixels) of files of raw frames; what is too short for a frame at the end is left out."""
    size = width * height * channels
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content", F.floor(F.col("length") / size).cast("int").alias("n")).where("n > 0")
    indexed = files.select("source", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_idx"))
    return indexed.select("source", "frame_idx", F.substring("content", F.col("frame_idx") * size + 1, F.lit(size)).alias("pixels"))


def stratified_times(spark: SparkSession, start: float, end: float, n: int, seed: int) -> DataFrame:
    """(i, t): one time in each of ``n`` equal stretches, in their first four fifths, a second before the end at most."""
    step = (end - start) / n
    return spark.range(n).select(F.col("id").alias("i"), F.least(F.lit(start) + F.col("id") * step + F.rand(seed) * 0.8 * step, F.lit(end - 1)).alias("t"))


def random_starts(spark: SparkSession, duration: float, length: float, n: int, seed: int) -> DataFrame:
    """(t0): sorted random starts of segments that fit."""
    high = max(10.0, duration - length - 5)
    return spark.range(n).select((F.rand(seed) * (high - 10) + 10).alias("t0")).orderBy("t0")


def interval_times(spark: SparkSession, start: float, end: float, interval: float, seed: int) -> DataFrame:
    """(i, t): one time after each ``interval``, up to four fifths of it late, a second before the end at most."""
    n = max(0, int((end - start) / interval))
    return spark.range(n).select(F.col("id").alias("i"), F.least(F.lit(start) + F.col("id") * interval + F.rand(seed) * 0.8 * interval, F.lit(end - 1)).alias("t"))


def listed_starts(spark: SparkSession, starts: list[float]) -> DataFrame:
    """(t0): given starts of segments, in order."""
    return spark.createDataFrame([(float(t),) for t in starts], "t0 double").orderBy("t0")


def volumes(spark: SparkSession, root: str) -> DataFrame:
    """(volume, path, mount) of each folder below ``root`` that has footage somewhere inside: the first such folder in order.
    Hidden volumes are passed over, and so is what cannot be read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{insv,INSV}").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root).select("path")
    base = root.rstrip("/").removeprefix("file:")
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^.*?{re.escape(base)}/", "")
    parts = found.select("path", below.alias("below")).select("path", F.split_part("below", F.lit("/"), F.lit(1)).alias("volume"), "below").where(F.col("below").contains("/") & ~F.col("volume").startswith("."))
    first = parts.groupBy("volume").agg(F.min("path").alias("path"))
    return first.select("volume", F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.concat(F.lit(base + "/"), "volume").alias("mount"))


def image_sets(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """(split, name, image, label): the footage pictures of each split in order, with where the label file of each belongs.
    The pictures are listed, not read; a split that is not there has none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "VID_*.jpg").option("recursiveFileLookup", True).load(root).select("path")
    part = lambda k: F.regexp_extract("path", "([^/]+)/images/([^/]+)$", k)
    named = found.select(part(1).alias("split"), part(2).alias("name"), F.col("path").alias("image")).where(F.col("split").isin(*splits))
    label = F.regexp_replace(F.regexp_replace("image", "/images/([^/]+)$", "/labels/$1"), r"\.jpg$", ".txt")
    return named.withColumn("label", label).orderBy("split", "name")


def resume(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The items that are not done yet; with nothing done all of them."""
    return items.join(done.select(*key).distinct(), key, "left_anti")


def some(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, or an error if there are none."""
    if rows.isEmpty():
        raise ValueError(f"no {what} found")
    return rows


def number_list(text: Column) -> Column:
    """``"100,250"`` as an array of doubles."""
    return F.transform(F.split(text, ","), lambda s: F.trim(s).cast("double"))


def known_duration(duration: Column, default: float = 1800.0) -> Column:
    return F.coalesce(duration, F.lit(default))


def detect(frames: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Boxes of frames: ``make_model`` runs once per task and returns what turns a batch of frames into rows of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield model(batch)

    return frames.mapInPandas(run, schema)
