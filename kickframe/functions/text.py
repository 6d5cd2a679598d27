"""Names, labels, times and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_frame_name(name: Column) -> Column:
    """struct(clip, t, yaw) of ``VID_n_n_n_n_t<seconds>_yaw<+-degrees>_det`` or ``_neg``, with or without an export's hash; nulls otherwise."""
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^./]*$", ""), r"_jpg\.rf\.[a-f0-9]+$", "")
    pattern = r"^(VID_\d+_\d+_\d+_\d+)_t(\d+)_yaw([+-]?\d+)_(?:det|neg)"
    return F.struct(found(stem, pattern, 1).alias("clip"), found(stem, pattern, 2).cast("double").alias("t"), found(stem, pattern, 3).cast("double").alias("yaw"))


def sequence_key(name: Column, modified: Column) -> Column:
    """The three-digit number that ends a file name, else the whole minutes from the epoch to its last change."""
    return F.coalesce(found(name, r"_(\d{3})(?:\.\w+)?$"), F.floor(F.unix_timestamp(modified) / 60).cast("string"))


def slug(text: Column) -> Column:
    """A name for a folder: all but letters and digits of any script, _ and - become _."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\-]", "_")


def place_slug(text: Column) -> Column:
    """A key for a place: lower case, each run of white space one _."""
    return F.regexp_replace(F.lower(text), r"\s+", "_")


def video_id(url: Column) -> Column:
    """The eleven characters that name a video in a watch, short or embed address of the one site."""
    patterns = (r"youtube\.com/watch\?v=([a-zA-Z0-9_-]{11})", r"youtu\.be/([a-zA-Z0-9_-]{11})", r"youtube\.com/embed/([a-zA-Z0-9_-]{11})")
    return F.coalesce(*[found(url, p) for p in patterns])


def clock(seconds: Column) -> Column:
    """m:ss, rounded down."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), (s % 60).cast("bigint"))


def clock_rounded(seconds: Column) -> Column:
    """m:ss to the nearest second, halves up, never below 0:00."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5))
    return F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), (s % 60).cast("bigint"))


def game_title(home: Column, away: Column) -> Column:
    """``home vs. away``; null unless both have a name."""
    return F.concat(blank_to_null(home), F.lit(" vs. "), blank_to_null(away))


def size_to_duration(megabytes: Column, per_minute: float = 170.0) -> Column:
    """How long footage of a size lasts: ~Ns below a minute, else ~Nmin."""
    minutes = megabytes / per_minute
    return F.when(minutes < 1, F.format_string("~%ds", F.floor(minutes * 60).cast("bigint"))).otherwise(F.format_string("~%dmin", F.floor(minutes).cast("bigint")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def signed_tag(clip: Column, t: Column, yaw: Column) -> Column:
    return F.format_string("%s_t%d_yaw%+d", clip, t.cast("bigint"), yaw.cast("bigint"))


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.75, F.lit("high")).when(x >= 0.5, F.lit("medium")).otherwise(F.lit("low"))


def points_confidence(n: Column) -> Column:
    """0 for fewer than four points, then a twelfth more for each, up to 1; two decimals."""
    return F.when(n < 4, F.lit(0.0)).otherwise(F.round(F.least(F.greatest((n - 4) / 12, F.lit(0.0)), F.lit(1.0)), 2))


#: Label key, its group and team; a label of any other key belongs to no group.
LABELS = (
    ("goal_home", "goal", "home"),
    ("goal_away", "goal", "away"),
    ("shot_home", "shot", "home"),
    ("shot_away", "shot", "away"),
    ("setpiece_home", "setpiece", "home"),
    ("setpiece_away", "setpiece", "away"),
    ("tactical", "tactical", None),
)


def label_group(label: Column) -> Column:
    """goal, shot or setpiece by prefix, tactical by equality, else null."""
    by_prefix = F.coalesce(*[F.when(label.startswith(p), F.lit(p)) for p in ("goal", "shot", "setpiece")])
    return F.coalesce(by_prefix, F.when(label == "tactical", label))


def label_team(label: Column) -> Column:
    return F.when(label.endswith("_home"), F.lit("home")).when(label.endswith("_away"), F.lit("away"))
