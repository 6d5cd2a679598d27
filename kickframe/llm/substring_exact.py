"""Removal of byte strings that occur more than once, by sorting sampled suffixes and inducing the rest.

A suffix array of all bytes needs a tuple per byte in every sort, many times the input; here, as in induced
sorting, only sampled suffixes are sorted and named, and what holds for the others follows from them. A
place is sampled if its ``GRAM`` bytes have the least hash in some window of ``LENGTH`` bytes. A window's
sample depends on its bytes alone, so equal windows have the same sample at the same distance, and the
windows that share a sample are one stretch, a *segment*. Spark's external sorts bring segments with equal
samples together:

1. A sample that occurs once cannot be in a repeated window: its segment is done.
2. Segments that are equal as a whole repeat in all their windows; they are named by a hash, not compared.
3. Where a sample has different segments, one of each kind is fetched with its bytes, and the windows at
   equal distance from the sample are compared by a hash that, with the sample's, has 128 bits: in one task
   for samples with few segments, as rows spread over all tasks for those with very many.

Only segments of the third kind carry bytes. Results are those of the full suffix array: every byte
covered by a window that also starts elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, map_batches, materialize, text_of

LENGTH, GRAM = 200, 32
#: Segments of one sample that one task compares; those of a sample with more are spread over all tasks.
TOGETHER = 20_000
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def segments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, sample's 64-bit hash, sample's place) of each segment, as arrays."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    h, width = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1
    for factor in _FACTORS:
        h = h[:-width] * factor + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h = h * _FACTORS[1]
    h ^= h >> np.uint64(31)
    # the least hash of each window's grams; of equal ones the leftmost
    low, size, span = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1, length - GRAM + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: -(span - size)], low[span - size :])
    at = (low & _LOW).astype(np.int64)
    first = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
    return first, np.diff(np.append(first, len(at))), h[at[first]].view(np.int64), at[first]


def _segment_rows(rows: DataFrame, length: int) -> DataFrame:
    """(sample, name, id, check, first, n) of every segment."""
    ddl = "sample bigint, name bigint, id bigint, check bigint, first bigint, n int"
    schema = arrow_schema(ddl)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, names, which = [], [], []
        for row, text in enumerate(batch.column(2)):
            data = text.as_py().encode("utf-8")
            first, n, sample, _ = segments(data, length)
            if len(first):
                parts.append((sample, first, n))
                view = memoryview(data)
                names += [xxhash.xxh3_64_intdigest(view[a : a + b + length - 1]) for a, b in zip(first.tolist(), n.tolist(), strict=True)]
                which.append(np.full(len(first), row))
        if not parts:
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
        sample, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        take = pa.array(np.concatenate(which))
        columns = [pa.array(sample), pa.array(np.array(names, np.uint64).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(first), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(rows, cut, ddl)


_CONTENT = "sample bigint, total bigint, id bigint, check bigint, first bigint, ahead int, times bigint, content binary"


def _contents(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments in ``asked``; ``ahead`` is the sample's distance from the segment's start."""
    lists = asked.groupBy("id", "check").agg(F.collect_list(F.struct("sample", "total", "first", "n", "times")).alias("asked"))
    schema = arrow_schema(_CONTENT)

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, c, text, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
            data = text.as_py().encode("utf-8")
            first, _, _, at = segments(data, length)
            place = dict(zip(first.tolist(), at.tolist(), strict=True))
            i, c = i.as_py(), c.as_py()
            for w in wanted.as_py():
                a = w["first"]
                out.append((w["sample"], w["total"], i, c, a, place[a] - a, w["times"], data[a : a + w["n"] + length - 1]))
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("check") == F.col("__check"))
    met = rows.join(lists.withColumnsRenamed({"id": "__id", "check": "__check"}).hint("shuffle_hash"), same)
    return map_batches(met.select("id", "check", "text", "asked"), fetch, _CONTENT)


_FOUND = "id bigint, check bigint, start bigint, end bigint"


def _runs(windows: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of neighbouring numbers in a sorted array."""
    cut = np.flatnonzero(np.diff(windows) > 1)
    return list(zip(windows[np.append(0, cut + 1)].tolist(), windows[np.append(cut, len(windows) - 1)].tolist(), strict=True))


def _marks(content: bytes, ahead: int, length: int) -> list[int]:
    """A hash of each window, with its distance from the sample."""
    view = memoryview(content)
    return [xxhash.xxh3_64_intdigest(view[j : j + length], seed=ahead - j) for j in range(len(content) - length + 1)]


def _compared(group: list[tuple], length: int) -> Iterator[tuple]:
    """Spans of the windows of a sample's segments that another of them has too."""
    marks = [_marks(content, ahead, length) for _, _, _, ahead, _, content in group]
    sizes = [len(m) for m in marks]
    _, which = np.unique(np.array([x for m in marks for x in m], np.uint64), return_inverse=True)
    often = np.bincount(which, np.repeat([g[4] for g in group], sizes)) > 1
    starts = np.cumsum([0, *sizes])
    for (i, c, first, _, times, _), a, b in zip(group, starts[:-1], starts[1:], strict=True):
        if times == 1:
            hit = np.flatnonzero(often[which[a:b]])
            for x, y in _runs(hit) if len(hit) else ():
                yield i, c, first + x, first + y + length


def _compare_together(contents: DataFrame, length: int) -> DataFrame:
    schema = arrow_schema(_FOUND)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, group, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7)), strict=True):
                if row[0] != sample:
                    out += _compared(group, length) if group else ()
                    sample, group = row[0], []
                    if len(out) > 10_000:
                        yield as_batch(out)
                        out = []
                group.append(row[1:])
        out += _compared(group, length) if group else ()
        if out:
            yield as_batch(out)

    return contents.repartition("sample").sortWithinPartitions("sample").mapInArrow(compare, _FOUND)


def _compare_spread(contents: DataFrame, length: int) -> DataFrame:
    ddl = "sample bigint, window bigint, id bigint, check bigint, start bigint, times bigint"
    schema = arrow_schema(ddl)

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for sample, _, i, c, first, ahead, times, content in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            out += [(sample, mark - (1 << 63), i, c, first + j, times) for j, mark in enumerate(_marks(content, ahead, length))]
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    marked = map_batches(contents, windows, ddl)
    twice = marked.groupBy("sample", "window").agg(F.sum("times").alias("all")).where("all > 1").select("sample", "window")
    met = marked.where("times = 1").join(twice, ["sample", "window"])
    return met.select("id", "check", "start", (F.col("start") + length).alias("end"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """(id, n_bytes, spans, kept): one row per row of ``docs``; other columns are ignored.

    ``spans`` are the maximal runs of bytes covered by ``length``-byte strings that also start elsewhere in
    any text, the same one too; ``kept`` is the rest of the text's UTF-8. Strings are judged on the input
    and never cross texts. Null and empty texts have no bytes; repeated rows repeat each other; rows with
    a null id take part. An empty table gives no rows. Ids are integers, ``length`` is at least 32.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("check"), "text")
    cut = _segment_rows(rows, length)
    samples = cut.groupBy("sample").agg(F.count("*").alias("total"), (F.min("name") != F.max("name")).alias("mixed")).where("total > 1")
    shared = materialize(cut.join(samples, "sample"))

    kinds = shared.where("mixed").groupBy("sample", "name").agg(F.count("*").alias("times"), F.min(F.struct("id", "check", "first", "n")).alias("place"), F.first("total").alias("total"))
    whole = shared.where("not mixed").select("id", "check", "first", "n").union(
        shared.where("mixed").join(kinds.where("times > 1").select("sample", "name"), ["sample", "name"]).select("id", "check", "first", "n")
    )
    asked = kinds.select("sample", "total", "times", "place.*")
    contents = materialize(_contents(rows, asked, length))
    found = (
        whole.select("id", "check", F.col("first").alias("start"), (F.col("first") + F.col("n") + length - 1).alias("end"))
        .union(_compare_together(contents.where(F.col("total") <= together), length))
        .union(_compare_spread(contents.where(F.col("total") > together), length))
    )
    spans = found.groupBy("id", "check").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("check") == F.col("__check"))
    met = rows.join(spans.withColumnsRenamed({"id": "__id", "check": "__check"}).hint("shuffle_hash"), same, "left").select("id", "text", "spans")
    ddl = f"`{id_col}` bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    schema = arrow_schema(ddl)

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, merged, kept = [], [], []
        for text, pieces in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_py().encode("utf-8")
            runs: list[list[int]] = []
            for a, b in sorted((p["start"], p["end"]) for p in pieces.as_py() or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            edges = [0, *(x for r in runs for x in r), len(data)]
            sizes.append(len(data))
            merged.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        columns = [batch.column(0), *(pa.array(c, f.type) for c, f in zip((sizes, merged, kept), list(schema)[1:], strict=True))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(met, remove, ddl)
