"""Token-id files with Re-Pair grammar compression.

Documents are range-partitioned by id and encoded in order; every partition is a run of shards. In a
shard, frequent pairs of neighbouring ids are replaced by nonterminals again and again, until no pair is
frequent any more. A shard stores the rules, the length to which each rule expands, the remaining stream
with a mark of the ids before every ``MARK``-th symbol, and the documents' names and lengths, so it can be
read by itself, and any range of its ids without decoding the rest.

Shard layout, little-endian: the magic ``RPG2``; unsigned 32-bit first nonterminal, rules, stream symbols,
documents, bytes of names and the writing task; unsigned 64-bit place, the ids that the task wrote before;
the rules' pairs, their lengths and the stream as unsigned 32-bit; the marks and the documents' numbers of
ids as unsigned 64-bit; the documents' names as a JSON array in UTF-8; a crc32 of all before it. Shards are
the ``shard`` column of a Parquet dataset, beside their task, place and size, so that any file system and
Spark's commit protocol serve.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, text_of
from kickframe.llm.encoder import encoder

MAGIC = b"RPG2"
#: Ids after which a shard is closed, at the end of a document.
SHARD_IDS = 1 << 18
#: Pairs replaced in a round, and times that a pair must occur to be frequent.
PAIRS, LEAST = 1024, 8
#: Stream symbols from one mark to the next.
MARK = 1024
#: Ids that a rule stands for, at most, to be written out once when a whole shard is decoded.
SHORT = 64
_BITS = 18
_ODD = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)


def _winners(joined: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which places are better than the overlapping ones; of a run of one rank every second.

    ``joined`` says whether a place overlaps the next one in the list.
    """
    none, n = ranks.max() + 1, len(ranks)
    fresh = np.append(True, ~joined | (ranks[1:] != ranks[:-1]))
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], n) - 1
    before = np.where(np.append(False, joined)[start], ranks[start - 1], none)
    after = np.where(np.append(joined, False)[end], ranks[np.minimum(end + 1, n - 1)], none)
    wins = (before > ranks[start]) & (after > ranks[start])
    run = np.cumsum(fresh) - 1
    return wins[run] & ((np.arange(n) - start[run]) % 2 == 0)


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low


class _Grammar:
    """A stream as a linked list of symbols, with the places of its frequent pairs.

    Counts are kept, not made anew: a pair of old symbols only gets rarer, so a place is watched for as long
    as its pair is frequent, and after a round only the places beside new symbols are counted.
    """

    def __init__(self, ids: np.ndarray, first: int, least: int) -> None:
        n = len(ids)
        self.first, self.least, self.n = first, least, n
        self.symbols = np.append(ids.astype(np.uint32), np.uint32(0))
        self.next = np.arange(1, n + 2, dtype=np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)
        self.used = np.zeros(n + 1, bool)
        self.gone = np.zeros(n + 1, bool)
        self.rules = np.zeros((0, 2), np.uint32)
        self.lengths = np.zeros(0, np.uint32)
        # watched places in order, each with the number of its pair; the pairs as left << 32 | right
        self.places, self.which = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pairs = np.zeros(0, np.uint64)
        left, right = self.symbols[: max(n - 1, 0)], self.symbols[1:n]
        bins = ((left * _ODD[0]) ^ (right * _ODD[1])) >> np.uint32(32 - _BITS)
        # a count by hash leaves out most places whose pairs are too rare
        self._watch(np.flatnonzero((np.bincount(bins, minlength=1 << _BITS) >= least)[bins]).astype(np.int32))

    def _watch(self, places: np.ndarray) -> None:
        """Watch those of new ``places``, in order, whose pairs are frequent among them."""
        if not len(places):
            return
        left, right = self.symbols[places].astype(np.uint64), self.symbols[self.next[places]].astype(np.uint64)
        bits, low = int(max(left.max(), right.max())).bit_length(), len(places).bit_length()
        if 2 * bits + low <= 64:
            packed = np.sort((left << np.uint64(bits + low)) | (right << np.uint64(low)) | np.arange(len(places), dtype=np.uint64))
            order, key = (packed & np.uint64((1 << low) - 1)).astype(np.int64), packed >> np.uint64(low)
        else:
            key = (left << np.uint64(32)) | right
            order = np.argsort(key, kind="stable")
            key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(start, len(key)))
        good = times >= self.least
        if not good.any():
            return
        number = (np.cumsum(good) - 1 + len(self.pairs)).astype(np.int32)
        chosen = order[start[good]]
        keep = np.repeat(good, times)
        which = np.repeat(number, times)[keep]
        self.pairs = np.append(self.pairs, (left[chosen] << np.uint64(32)) | right[chosen])
        # one sort puts the places in order, each with its pair's number
        both = np.append(_packed(self.places, self.which), _packed(places[order[keep]], which))
        both.sort()
        self.places, self.which = (both >> 32).astype(np.int32), both.astype(np.int32)

    def _best(self, pairs: int) -> np.ndarray:
        """Forget rare pairs, and give the rank of each that is left, -1 beyond the best ``pairs``."""
        times = np.bincount(self.which, minlength=len(self.pairs))
        kept = np.flatnonzero(times >= self.least)
        if len(kept) < len(self.pairs):
            number = np.full(len(self.pairs), -1, np.int32)
            number[kept] = np.arange(len(kept))
            self.which = number[self.which]
            stay = self.which >= 0
            self.places, self.which, self.pairs = self.places[stay], self.which[stay], self.pairs[kept]
        order = np.lexsort((self.pairs, -times[kept]))[:pairs]
        ranks = np.full(len(kept), -1, np.int32)
        ranks[order] = np.arange(len(order))
        return ranks

    def round(self, pairs: int) -> bool:
        """Replace the best ``pairs`` wherever they do not overlap better ones; False if no pair is frequent."""
        ranks = self._best(pairs)
        if not len(ranks):
            return False
        rank = ranks[self.which]
        good = rank >= 0
        left, rank = self.places[good], rank[good]
        right = self.next[left]
        taken = []
        while len(left):
            wins = _winners(right[:-1] == left[1:], rank)
            taken.append(_packed(left[wins], rank[wins]))
            self.used[left[wins]] = self.used[right[wins]] = True
            free = ~(self.used[left] | self.used[right])
            left, right, rank = left[free], right[free], rank[free]
        chosen = np.sort(np.concatenate(taken))
        at, ranked = (chosen >> 32).astype(np.int32), chosen.astype(np.int32)
        stay = ~(self.used[self.places] | self.used[self.next[self.places]])
        self.used[at] = self.used[self.next[at]] = False

        # pairs of which no place was left get no rule
        name = np.cumsum(np.bincount(ranked) > 0) - 1
        number = np.zeros(ranks.max() + 1, np.int64)
        number[ranks[ranks >= 0]] = np.flatnonzero(ranks >= 0)
        new = self.pairs[number[np.flatnonzero(np.bincount(ranked))]]
        new = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        sizes = np.append(np.ones(1, np.uint32), self.lengths)[np.maximum(new.astype(np.int64) - self.first + 1, 0)]
        self.symbols[at] = self.first + len(self.rules) + name[ranked]
        self.lengths = np.append(self.lengths, sizes.sum(axis=1)).astype(np.uint32)
        self.rules = np.concatenate([self.rules, new])

        second = self.next[at]
        self.gone[second] = True
        self.next[at] = self.next[second]
        self.before[self.next[at]] = at
        self.places, self.which = self.places[stay], self.which[stay]
        beside = np.append(at, self.before[at])
        beside = np.sort(beside[(beside >= 0) & (self.next[beside] < self.n)])
        self._watch(beside[np.append(True, beside[1:] != beside[:-1])] if len(beside) else beside)
        return True

    def stream(self) -> np.ndarray:
        return self.symbols[:-1][~self.gone[:-1]]


def compress(ids: np.ndarray, first: int, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, stream); symbol ``first`` + k stands for the pair rules[k].

    Ends when no pair of neighbours in the stream stands at ``least`` places.
    """
    grammar = _Grammar(ids, first, least)
    while grammar.round(pairs):
        pass
    return grammar.rules, grammar.lengths, grammar.stream()


def expand(stream: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that a stream stands for, by replacing nonterminals until none is left."""
    while len(big := np.flatnonzero(stream >= first)):
        times = np.ones(len(stream), np.int64)
        times[big] = 2
        starts = (np.cumsum(times) - times)[big]
        pair = rules[stream[big] - first]
        stream = np.repeat(stream, times)
        stream[starts], stream[starts + 1] = pair[:, 0], pair[:, 1]
    return stream


def _sizes(stream: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The number of ids that each symbol stands for."""
    sizes = np.ones(len(stream), np.int64)
    big = stream >= first
    sizes[big] = lengths[stream[big] - first]
    return sizes


class _Expander:
    """Expands streams of one grammar; what short rules stand for is written out once."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first: int) -> None:
        self.rules, self.first = rules, first
        self.short = lengths <= SHORT
        sizes = np.where(self.short, lengths, 0).astype(np.int64)
        self.table = expand((np.flatnonzero(self.short) + first).astype(np.uint32), rules, first)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def __call__(self, stream: np.ndarray) -> np.ndarray:
        while True:
            big = np.flatnonzero(stream >= self.first)
            which = stream[big] - self.first
            if self.short[which].all():
                break
            # rules that stand for more are replaced by their pairs first
            big = big[~self.short[which]]
            times = np.ones(len(stream), np.int64)
            times[big] = 2
            starts = (np.cumsum(times) - times)[big]
            pair = self.rules[stream[big] - self.first]
            stream = np.repeat(stream, times)
            stream[starts], stream[starts + 1] = pair[:, 0], pair[:, 1]
        times = np.ones(len(stream), np.int64)
        times[big] = self.sizes[which]
        out = np.repeat(stream, times)
        ends = np.cumsum(times)[big]
        own = times[big]
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(ends - own, own) + within] = self.table[np.repeat(self.starts[which], own) + within]
        return out


class Shard:
    """A shard read back: ``ids(a, b)`` decodes the ids from a to b (exclusive) alone, ``document(k)`` those of one document."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a whole shard")
        self.first, n_rules, n_stream, n_docs, n_names, self.part = (int(x) for x in np.frombuffer(data, "<u4", 6, 4))
        self.place = int.from_bytes(data[28:36], "little")
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at := 36).reshape(-1, 2)
        self.lengths = np.frombuffer(data, "<u4", n_rules, at := at + 8 * n_rules)
        self.stream = np.frombuffer(data, "<u4", n_stream, at := at + 4 * n_rules)
        n_marks = -(-n_stream // MARK)
        self.marks = np.frombuffer(data, "<u8", n_marks, at := at + 4 * n_stream)
        self.counts = np.frombuffer(data, "<u8", n_docs, at := at + 8 * n_marks)
        self.names = json.loads(data[(at := at + 8 * n_docs) : at + n_names])
        self.ends = np.cumsum(self.counts.astype(np.int64))
        self._expand: _Expander | None = None

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        # the marked stretches that hold the range, then the symbols that do
        a, b = int(np.searchsorted(self.marks, start, "right")) - 1, int(np.searchsorted(self.marks, end, "left"))
        stream, base = self.stream[a * MARK : b * MARK], int(self.marks[a])
        ends = base + np.cumsum(_sizes(stream, self.lengths, self.first))
        x, y = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        before = int(ends[x - 1]) if x else base
        if y - x > MARK and self._expand is None:
            self._expand = _Expander(self.rules, self.lengths, self.first)
        whole = self._expand(stream[x:y]) if self._expand else expand(stream[x:y], self.rules, self.first)
        return whole[start - before : end - before]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k] - int(self.counts[k])), int(self.ends[k]))


def to_bytes(documents: list[np.ndarray], first: int, names: list | None = None, part: int = 0, place: int = 0) -> bytes:
    rules, lengths, stream = compress(np.concatenate(documents), first)
    sizes = _sizes(stream, lengths, first)
    listed = json.dumps([None] * len(documents) if names is None else names).encode("utf-8")
    head = np.array([first, len(rules), len(stream), len(documents), len(listed), part], "<u4").tobytes() + place.to_bytes(8, "little")
    counts = np.array([len(d) for d in documents], "<u8")
    marks = (np.cumsum(sizes) - sizes)[::MARK]
    data = b"".join([MAGIC, head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), stream.astype("<u4").tobytes(), marks.astype("<u8").tobytes(), counts.tobytes(), listed])
    return data + zlib.crc32(data).to_bytes(4, "little")


_WRITTEN = "part int, place bigint, n_ids bigint, shard binary"


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` in ascending order of id (nulls first, ties by a hash of the text) and write shards to ``path``.

    Each document ends with ``end_id``; null and empty texts are that id alone. Very long texts make one
    large shard each, repeated rows are written each, and an empty table writes an empty dataset. Ids are
    integers or strings. Other columns are ignored, whatever their names.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise ValueError(f"{id_col} must hold integers or strings")
    schema = arrow_schema(_WRITTEN)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_file)
        first = max(coder.library.get_vocab_size(), end_id + 1)
        part, place, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            columns = [[part], [place], [size], [to_bytes(held, first, names, part, place)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), coder.ids_of(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= shard_ids:
                    yield closed()
                    place, names, held, size = place + size, [], [], 0
        if held:
            yield closed()

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(encode, _WRITTEN).write.parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """(start, n_ids, shard): ``start`` counts the ids of all shards before it."""
    shards = spark.read.parquet(path)
    # one row for each task that wrote, so one task can number them all and a broadcast is small
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("place")).alias("start"), "n_ids", "shard")


def read(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids) of each document written to ``path``: ``start`` counts the ids of all documents before it."""
    ddl = f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids binary"
    schema = arrow_schema(ddl)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0), batch.column(2), strict=True):
                shard = Shard(data.as_py())
                starts = shard.ends - shard.counts.astype(np.int64)
                every = shard.ids(0, int(shard.ends[-1])).astype("<u4")
                cuts = np.append(0, 4 * shard.ends).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(every)])
                columns = [pa.array(shard.names, schema.field(0).type), pa.array(starts + base.as_py()), pa.array(shard.ends - starts), ids]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return _shards(spark, path).mapInArrow(decode, ddl)


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(start, ids): the ids from ``start`` to ``end`` (exclusive) of all that is in ``path``, a row for each shard that has some; nothing else is decoded."""
    ddl = "start bigint, ids binary"
    schema = arrow_schema(ddl)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                a, b = max(start - base, 0), min(end - base, n)
                ids = Shard(data.as_py()).ids(a, b).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([base + a]), pa.array([ids], pa.binary())], schema=schema)

    wanted = _shards(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start))
    return wanted.mapInArrow(decode, ddl)
