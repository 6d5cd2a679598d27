"""Product codes of vectors by Lloyd's rounds that look again only at parts whose bounds have failed.

Vectors become integers and are cut into equal parts, each part position with a codebook of its own. They lie
in chunks that stay where they are read. In a chunk each entry of a codebook has a heap of the parts assigned
to it, keyed by slack: the distance to the second nearest entry less that to the nearest. When entries move by
at most d, the own one by c, a part's slack falls by c + d at most; the sum of these over the rounds is kept
per entry, so a key is compared with one number and never rewritten. A round pops the parts whose key the sum
has reached, scans all entries for these exactly, and pushes them with their new slack. All others keep their
entry, which then is strictly nearest, so the result is that of a full scan.

A round sends only the sums of parts that changed their entry; the driver keeps the codebooks, whose size is
bounded by the number of entries and the dimension. Chunks with their heaps are written to the shared folder
after each round and the version before is deleted.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, delete_path, shared_path

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a chunk, and distances that a scan holds at once.
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Greatest integer component: squared distances of a thousand of them stay exact in 64 bits.
LARGEST = 1 << 25
#: What rounding may take from a slack; true slacks are either 0 or far larger than that error.
ROUNDING = 1e-6


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, slack) of each row of ``part``; equal distances go to the lower entry."""
    largest = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    # products of small integers are exact in float64, where numpy multiplies fastest
    kind = np.float64 if part.shape[1] * 4 * largest * largest < 1 << 53 else np.int64
    b = book.astype(kind)
    norms = (b * b).sum(axis=1)
    entry, least, slack = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.full(len(part), np.inf)
    step = max(1, BLOCK // len(book))
    for at in range(0, len(part), step):
        x = part[at : at + step].astype(kind)
        d = norms - 2 * (x @ b.T) + (x * x).sum(axis=1)[:, None]
        rows = np.arange(len(x))
        first = d.argmin(axis=1)
        low = d[rows, first]
        entry[at : at + step], least[at : at + step] = first, low
        if len(book) > 1:
            d[rows, first] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
            slack[at : at + step] = np.sqrt(d.min(axis=1)) - np.sqrt(low)
    return entry, least, slack


class _Chunk:
    """The parts of some vectors, a heap per entry, and the sums of what changed its entry."""

    def __init__(self, parts: np.ndarray, entries: int) -> None:
        self.parts, self.entries = parts, entries
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(PARTS * entries)]
        self.moved: dict[int, np.ndarray] = {}

    @classmethod
    def loaded(cls, parts: np.ndarray, entries: int, sizes: bytes, order: bytes, keys: bytes) -> _Chunk:
        chunk = cls(parts, entries)
        ends = [0, *np.frombuffer(sizes, "<i4").cumsum().tolist()]
        pairs = list(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(order, "<i4").tolist(), strict=True))
        chunk.heaps = [pairs[a:b] for a, b in pairwise(ends)]
        return chunk

    def saved(self) -> tuple[bytes, bytes, bytes]:
        sizes = np.array([len(h) for h in self.heaps], "<i4").tobytes()
        order = np.array([i for h in self.heaps for _, i in h], "<i4").tobytes()
        return sizes, order, np.array([k for h in self.heaps for k, _ in h], "<f8").tobytes()

    def _add(self, at: int, rows: np.ndarray, entry: np.ndarray, sign: int) -> None:
        """Count rows of part position ``at`` to (or from) their entries: a count, then a sum per component."""
        if not len(rows):
            return
        order = np.argsort(entry, kind="stable")
        entry, values = entry[order], self.parts[rows[order], at].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        sums = np.add.reduceat(values, starts, axis=0)
        counts = np.diff(np.r_[starts, len(entry)])
        for e, n, s in zip((at * self.entries + entry[starts]).tolist(), counts, sums, strict=True):
            change = sign * np.r_[n, s]
            self.moved[e] = self.moved[e] + change if e in self.moved else change

    def start(self, books: np.ndarray) -> None:
        """Assign all parts."""
        rows = np.arange(len(self.parts))
        for at in range(PARTS):
            entry, _, slack = _nearest(self.parts[:, at], books[at])
            self._add(at, rows, entry, 1)
            for i in np.lexsort((slack, entry)).tolist():
                self.heaps[at * self.entries + entry[i]].append((float(slack[i]), i))

    def again(self, books: np.ndarray, drift: np.ndarray) -> None:
        """Look again at the parts whose key ``drift``, the summed movement by part position and entry, has reached."""
        for at in range(PARTS):
            popped, old = [], []
            for e in range(self.entries):
                heap, bound = self.heaps[at * self.entries + e], drift[at, e] + ROUNDING
                before = len(popped)
                while heap and heap[0][0] <= bound:
                    popped.append(heapq.heappop(heap)[1])
                old += [e] * (len(popped) - before)
            if not popped:
                continue
            rows, was = np.array(popped), np.array(old)
            entry, _, slack = _nearest(self.parts[rows, at], books[at])
            for i, e, key in zip(popped, entry.tolist(), (slack + drift[at, entry]).tolist(), strict=True):
                heapq.heappush(self.heaps[at * self.entries + e], (key, i))
            other = entry != was
            self._add(at, rows[other], was[other], -1)
            self._add(at, rows[other], entry[other], 1)

    def codes(self, books: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Each vector's code, two hexadecimal digits a part, and its summed squared distance."""
        codes, error = np.zeros((len(self.parts), PARTS), np.uint8), np.zeros(len(self.parts), np.int64)
        for at in range(PARTS):
            for e in range(self.entries):
                codes[[i for _, i in self.heaps[at * self.entries + e]], at] = e
            off = self.parts[:, at].astype(np.int64) - books[at][codes[:, at]]
            error += (off * off).sum(axis=1)
        text = codes.tobytes().hex()
        return [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], error


def _changes(state: DataFrame, entries: int, width: int) -> np.ndarray:
    """The change of each entry's count and sums, added up over all chunks: as many rows as there are entries at most."""
    ddl = "entry int, " + ", ".join(f"s{i} bigint" for i in range(width + 1))
    schema = arrow_schema(ddl)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS * entries, width + 1), np.int64)
        seen: set[int] = set()
        for batch in batches:
            for moved, delta in zip(batch.column(0), batch.column(1), strict=True):
                which = np.frombuffer(moved.as_py(), "<i4")
                total[which] += np.frombuffer(delta.as_py(), "<i8").reshape(len(which), width + 1)
                seen.update(which.tolist())
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(c, pa.int64()) for c in total[rows].T]], schema=schema)

    out = np.zeros((PARTS * entries, width + 1), np.int64)
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(width + 1)]
    for row in state.select("moved", "delta").mapInArrow(added, ddl).groupBy("entry").agg(*sums).collect():
        out[row[0]] = row[1:]
    return out.reshape(PARTS, -1, width + 1)


def _whole(df: DataFrame, vector_col: str) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): one row per row of ``vectors`` whose vector is whole.

    Null vectors and those with a null or non-finite component are dropped; other columns are not read. A
    component x is floor(1024 x). The codebooks begin as the parts of the rows of smallest id (null ids last,
    equal ids by their vectors), at most ``entries`` (256 or fewer); of fewer rows there are fewer entries. Each
    round assigns all parts and moves every used entry to the floor of its parts' mean. ``label_error`` adds up
    the errors of equal labels, nulls together. Repeated rows count each; with no row left the result is empty.
    Vectors of unequal length, of a length that 4 does not divide, or with a component beyond 32768 in size end
    in an error, since they have no code.
    """
    if rounds < 1 or not 1 <= entries <= 256:
        raise ValueError("at least one round, and from 1 to 256 entries")
    spark = vectors.sparkSession
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    out_ddl = f"id {types[id_col]}, label {types[label_col]}, code string, error bigint"
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    rows = _whole(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).select("id", "label", ints.alias("v"))
    first = [r[0] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {types[id_col]}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = len(first[0])
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components cannot be cut into {PARTS} equal parts")
    fits = (F.size("v") == dim) & F.forall("v", lambda x: F.abs(x) <= LARGEST)
    rows = rows.withColumn("v", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a vector has another length, or a component beyond the greatest"))))
    if any(len(v) != dim or max(map(abs, v), default=0) > LARGEST for v in first):
        raise ValueError("a vector has another length, or a component beyond the greatest")
    width = dim // PARTS
    books = np.array(first, np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    count = len(first)
    ddl = f"ids array<{types[id_col]}>, labels array<{types[label_col]}>, parts binary, sizes binary, order binary, keys binary, moved binary, delta binary"
    schema, out_schema = arrow_schema(ddl), arrow_schema(out_ddl)
    length = max(1, CHUNK // max(dim, 1))

    def packed(chunk: _Chunk, ids: pa.Array, labels: pa.Array, parts: bytes) -> pa.RecordBatch:
        moved = sorted(chunk.moved)
        delta = np.array([chunk.moved[e] for e in moved], "<i8").tobytes()
        whole = lambda column, field: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column).cast(field.type)
        binary = [pa.array([b], pa.binary()) for b in (parts, *chunk.saved(), np.array(moved, "<i4").tobytes(), delta)]
        return pa.RecordBatch.from_arrays([whole(ids, schema.field(0)), whole(labels, schema.field(1)), *binary], schema=schema)

    def loaded(row: dict) -> tuple[np.ndarray, _Chunk]:
        n = len(row["ids"])
        parts = np.frombuffer(row["parts"].as_py(), "<i2" if len(row["parts"].as_py()) == 2 * n * dim else "<i4").reshape(n, PARTS, width)
        return parts, _Chunk.loaded(parts, count, row["sizes"].as_py(), row["order"].as_py(), row["keys"].as_py())

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}

    def begin(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk(table: pa.Table) -> pa.RecordBatch:
            values = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            small = "<i2" if np.abs(values).max(initial=0) < 1 << 15 else "<i4"
            made = _Chunk(values.astype(small).reshape(table.num_rows, PARTS, width), count)
            made.start(books)
            return packed(made, table.column(0).combine_chunks(), table.column(1).combine_chunks(), made.parts.tobytes())

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= length:
                table = pa.Table.from_batches(held)
                yield chunk(table.slice(0, length))
                held = table.slice(length).to_batches()
        if any(b.num_rows for b in held):
            yield chunk(pa.Table.from_batches(held))

    def step(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in rows_of(batch):
                    parts, chunk = loaded(row)
                    chunk.again(books, drift)
                    yield packed(chunk, row["ids"].values, row["labels"].values, row["parts"].as_py())

        return run

    def end(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in rows_of(batch):
                    _, chunk = loaded(row)
                    chunk.again(books, drift)
                    codes, error = chunk.codes(books)
                    columns = [row["ids"].values, row["labels"].values, pa.array(codes, pa.string()), pa.array(error, pa.int64())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        return run

    state, path = rows.mapInArrow(begin, ddl), None
    totals, drift = np.zeros((PARTS, count, width + 1), np.int64), np.zeros((PARTS, count))
    for _ in range(rounds):
        before, path = path, shared_path(spark, "vector-codes")
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if before is not None:
            delete_path(spark, before)
        totals += _changes(state, count, width)
        used = totals[:, :, 0] > 0
        moved = np.where(used[:, :, None], totals[:, :, 1:] // np.maximum(totals[:, :, :1], 1), books)
        by = np.sqrt(((moved - books).astype(np.float64) ** 2).sum(axis=2))
        order = np.sort(by, axis=1)
        # of the other entries the farthest: the greatest of all, or the next where that is the own one
        most = np.where(by == order[:, -1:], order[:, -2:][:, :1], order[:, -1:]) if count > 1 else np.zeros_like(by)
        drift = drift + by + most
        books = moved
        state = state.mapInArrow(step(books, drift), ddl)
    last = shared_path(spark, "vector-codes")
    spark.read.schema(ddl).parquet(path).mapInArrow(end(books, drift), out_ddl).write.parquet(last)
    coded = spark.read.schema(out_ddl).parquet(last)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
