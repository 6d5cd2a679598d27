"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

The test strings are windows of consecutive benchmark words. For test strings of one length m, a shift
table says for a block of two words how far the search may jump; at a shift of zero, the bucket of the
window's hash holds the strings to compare with directly. Tables are flat arrays: the benchmark's words in
one buffer, and 16 bytes for each window. Documents are scanned where they lie, without a shuffle, if the
benchmark fits in one block. A larger one is dealt into blocks of bounded size, each a pass of its own that
reports only what it finds; findings meet by the text's digest.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, map_batches, text_of

WINDOW = 13
#: Bytes of benchmark text that are broadcast as one block; its tables take some 140 MB in each Python worker.
BLOCK_BYTES = 8_000_000
#: Words of an item that stay together; longer items are cut, with an overlap.
PIECE = 50_000
#: Parts into which the rows of one text are dealt where findings come back to them.
SALTS = 32
_BITS, _MASK = 20, (1 << 64) - 1
_rng = np.random.default_rng(20240503)
_PLACES = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Words: runs of ASCII digits and letters, in lower case, and of all other characters beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """The words in UTF-8; lower() of bytes changes A-Z only."""
    return _WORD.findall(text.encode("utf-8").lower())


class _Memory(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_memory = _Memory()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memory.__getitem__, words), np.uint64, len(words))


class WuManber:
    """Finds test strings of ``m`` words in a list of words.

    ``strings`` has for each test string where it starts in the words of ``texts`` and the number of its item.
    """

    def __init__(self, m: int, hashes: np.ndarray, starts: np.ndarray, items: np.ndarray) -> None:
        self.m = m
        self.width = min(2, m)
        self.places = _PLACES if m <= len(_PLACES) else np.resize(_PLACES, m)
        self.numbers = self.places[:m].tolist()
        self.shift = np.full(1 << _BITS, m - self.width + 1, np.uint32)
        for end in range(self.width, m + 1):
            np.minimum.at(self.shift, self._slots(hashes, starts + end), np.uint32(m - end))
        keys = self._keys(hashes, starts + m)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.items = keys[order], starts[order].astype(np.uint32), items[order].astype(np.uint32)

    def _slots(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The shift table's entry for the block of words before each end; blocks that share one only make shifts smaller."""
        key = hashes[ends - 1] * _PLACES[0]
        if self.width == 2:
            key = key + hashes[ends - 2] * _PLACES[1]
        return (key ^ (key >> np.uint64(29))) * _PLACES[2] >> np.uint64(64 - _BITS)

    def _keys(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        key = np.zeros(len(ends), np.uint64)
        for k in range(self.m):
            key += hashes[ends - self.m + k] * self.places[k]
        return key ^ (key >> np.uint64(31))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(start, test string's start, item) of each test string that may stand there, by hash; only words that the search looks at are hashed."""
        m, n, two, shift, hashed = self.m, len(words), self.width == 2, self.shift.data, _memory.__getitem__
        one, other, last = (int(x) for x in _PLACES[:3])
        end = m
        while end <= n:
            key = hashed(words[end - 1]) * one
            if two:
                key += hashed(words[end - 2]) * other
            key &= _MASK
            by = shift[((key ^ key >> 29) * last & _MASK) >> 64 - _BITS]
            if by:
                end += by
                continue
            key = sum(hashed(w) * p for w, p in zip(words[end - m : end], self.numbers, strict=True)) & _MASK
            key = np.uint64(key ^ key >> 31)
            for x in range(int(np.searchsorted(self.keys, key)), int(np.searchsorted(self.keys, key, "right"))):
                yield end - m, int(self.starts[x]), int(self.items[x])
            end += 1


class Searcher:
    """All test strings of a block of items: one searcher for each length; an item of fewer words is one string, one without words none."""

    def __init__(self, benchmark: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.names = [item for item, _ in benchmark]
        parts, hashes, sizes = [], [], []
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        at = 0
        for number, (_, text) in enumerate(benchmark):
            words = words_of(text)
            if not words:
                continue
            m = min(window, len(words))
            by_length.setdefault(m, []).append((at, len(words) - m + 1, number))
            parts.append(b"".join(w + b" " for w in words))
            hashes.append(_hashes(words))
            sizes.append(np.fromiter(map(len, words), np.uint32, len(words)) + np.uint32(1))
            at += len(words)
        self.buffer = b"".join(parts)
        self.offsets = np.append(0, np.cumsum(np.concatenate(sizes), dtype=np.int64)) if sizes else np.zeros(1, np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.tables = []
        for m, runs in sorted(by_length.items()):
            starts = np.concatenate([np.arange(a, a + n) for a, n, _ in runs])
            self.tables.append(WuManber(m, flat, starts, np.repeat([i for *_, i in runs], [n for _, n, _ in runs])))

    def search(self, words: list[bytes]) -> tuple[list[dict[str, int]], list[str]]:
        """(spans, items): the maximal runs of words within occurrences, and the sorted names of the items that have one."""
        found: set[str] = set()
        mask = None
        for table in self.tables:
            m, last, same = table.m, None, False
            for start, string, item in table.find(words):
                low, high = int(self.offsets[string]), int(self.offsets[string + m])
                if start != last:
                    here, last = b"".join(w + b" " for w in words[start : start + m]), start
                if self.buffer[low:high] != here:
                    continue
                mask = mask or bytearray(len(words))
                mask[start : start + m] = b"\x01" * m
                if self.names[item] is not None:
                    found.add(self.names[item])
        return (_spans(mask) if mask else []), sorted(found)


_searchers: dict[int, Searcher] = {}


def _searcher(block: Broadcast, window: int) -> Searcher:
    """Built once per worker and block; a worker holds one block at a time."""
    key = hash((block.value, window))
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(pickle.loads(block.value), window)
    return _searchers[key]


def _spans(mask: bytearray) -> list[dict[str, int]]:
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(rb"\x01+", bytes(mask))]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(id, text): the distinct items, long ones in pieces that overlap so that each window is whole in one."""
    schema = arrow_schema("id string, text string")
    step = PIECE - window + 1

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            for at in range(0, max(len(words) - window + 1, 1), step) if words else ():
                ids.append(item)
                texts.append(b" ".join(words[at : at + PIECE]).decode("utf-8"))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], schema=schema)

    rows = benchmark.select(F.col(item_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    return map_batches(rows, cut, "id string, text string").distinct()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list[Broadcast]:
    sc = benchmark.sparkSession.sparkContext
    pieces = _pieces(benchmark, item_col, text_col, window).cache()
    try:
        size = pieces.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        n = -(-size // block_bytes) or 1
        part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
        return [sc.broadcast(pickle.dumps([tuple(r) for r in pieces.where(part == k).collect()])) for k in range(n)]
    finally:
        pieces.unpersist()


_SPANS = "array<struct<start:bigint,end:bigint>>"
_FOUND = f"n_words bigint, spans {_SPANS}, items array<string>"


def _one_pass(rows: DataFrame, block: Broadcast, window: int, only_found: bool) -> DataFrame:
    """The columns of ``rows`` but the last, its text, with what the block's test strings find there."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), _FOUND])
    schema = arrow_schema(ddl)

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            searcher = _searcher(block, window)
            counts, spans, items = [], [], []
            for text in batch.columns[-1]:
                words = words_of(text.as_py())
                found, names = searcher.search(words)
                counts.append(len(words))
                spans.append(found)
                items.append(names)
            new = [pa.array(c, f.type) for c, f in zip((counts, spans, items), list(schema)[-3:], strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_found else out

    return rows.mapInArrow(one_pass, ddl)


def _union_of(spans: Column) -> Column:
    """Maximal runs of sorted spans."""
    none = F.array().cast(_SPANS)

    def join_up(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touches = (F.size(acc) > 0) & (s["start"] <= last["end"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, none, join_up)


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, spans, items) and the columns in ``keep``, one row per row of ``docs``; other columns are ignored.

    ``spans`` are the maximal runs of words within occurrences, ``items`` the item ids, as sorted strings,
    that have one. Null and empty texts have no words; rows without id and repeated rows are searched like
    others. A null item id marks words but is not listed; repeated items count once, and very long ones are
    dealt in pieces. Either table may be empty.
    """
    held = [c for c in keep if c != id_col]
    blocks = _blocks(benchmark, item_col, "text", window, block_bytes)
    rows = docs.select(F.col(id_col), *held, text_of(text_col).alias("__text"))
    if len(blocks) == 1:
        return _one_pass(rows, blocks[0], window, only_found=False)
    texts = rows.select(F.md5("__text").alias("__key"), "__text")
    found = _one_pass(texts, blocks[0], window, only_found=True)
    for block in blocks[1:]:
        found = found.union(_one_pass(texts, block, window, only_found=True))
    by_text = found.groupBy("__key").agg(F.collect_set("spans").alias("s"), F.collect_set("items").alias("i"))
    joined = by_text.select("__key", _union_of(F.array_sort(F.array_distinct(F.flatten("s")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("items"))
    dealt = joined.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    low = F.translate("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.size(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).cast("bigint")
    counted = rows.withColumn("n_words", n_words).withColumn("__key", F.md5("__text")).drop("__text")
    counted = counted.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    met = counted.join(dealt.hint("shuffle_hash"), ["__key", "__salt"], "left")
    return met.select(F.col(id_col), *held, "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _hits(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])


def contaminated(n_hit, n_words):
    """At least one word in twenty is in an occurrence."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``.

    Null and empty texts stay, an empty table stays empty; ids are not read, so null and repeated ones do not matter.
    """
    names = docs.columns
    hidden = docs.select(F.struct(*names).alias("__row"), F.lit(0).alias("__id"), F.col(text_col).alias("__body"))
    found = search(hidden, benchmark, "__id", "__body", keep=("__row",))
    return found.where(~contaminated(_hits(), F.col("n_words"))).select("__row.*")
