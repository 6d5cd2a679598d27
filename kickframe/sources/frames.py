"""Raw frames as a data source: partitions begin at a seek offset and hold one frame at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of frames that one task reads.
TASK_BYTES = 128 << 20


@dataclass
class _Stretch(InputPartition):
    """Frames ``first`` to before ``last`` of a file."""

    path: str
    first: int
    last: int


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        number = lambda name, default: float(options.get(name, default))
        self.path = options["path"]
        self.size = int(options["width"]) * int(options["height"]) * int(options.get("channels", 3))
        fps = number("fps", 30)
        if self.size < 1 or fps <= 0:
            raise ValueError("frames need a width, a height and a rate above 0")
        self.first = int(max(0.0, number("start", 0)) * fps)
        self.count = int(number("duration", 0) * fps + 1e-9) if "duration" in options else None
        self.each = max(1, int(options.get("taskbytes", TASK_BYTES)) // self.size)

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith(("/", "file:")) else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        out: list[InputPartition] = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            end = f.size // self.size
            if self.count is not None:
                end = min(end, self.first + self.count)
            out += [_Stretch(f.path, at, min(at + self.each, end)) for at in range(self.first, end, self.each)]
        return out or [_Stretch("", 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        if partition.first >= partition.last:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as source:
            source.seek(partition.first * self.size)
            for number in range(partition.first, partition.last):
                frame = source.read(self.size)
                if len(frame) < self.size:  # the file has become shorter: what is there ends here
                    return
                yield partition.path, number, bytes(frame)


class RawFrames(DataSource):
    """``spark.read.format("raw_frames")`` with options path (a file or folder), width, height, channels (3), fps (30), start and
    duration in seconds, and taskBytes: rows (source, frame_idx, pixels).

    Frames are numbered from the beginning of their file, whatever ``start`` is. A beginning below 0 is 0; one beyond the
    end, an empty file and an empty folder give no rows; bytes at the end that are no whole frame are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "source string, frame_idx bigint, pixels binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _FrameReader({k.lower(): v for k, v in self.options.items()})


def read_frames(spark: SparkSession, path: str, width: int, height: int, channels: int = 3, fps: float = 30, start: float = 0, duration: float | None = None, tail: float = 0) -> DataFrame:
    """Frames of ``duration`` seconds, and ``tail`` more, from ``start`` on; of the whole file without a duration."""
    spark.dataSource.register(RawFrames)
    reader = spark.read.format("raw_frames").option("width", width).option("height", height).option("channels", channels).option("fps", fps).option("start", start)
    if duration is not None:
        reader = reader.option("duration", duration + tail)
    return reader.load(path)
