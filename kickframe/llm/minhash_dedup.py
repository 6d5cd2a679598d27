"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets are one node from the start. Every other node has a signature of
``HASHES`` minima and appears in ``TREES`` sorted orders: each order reads the signature from another
place on. Nodes that agree in the first ``DEPTH`` minima of an order form a region. In a region each node
takes the ``NEXT`` nodes that follow it in the order, those with the longest common prefixes, so a small
region yields all its pairs and a large one goes as deep as it is dense; besides, each node meets the
smallest id seen so far in its region and in its deeper part of it, which ties large groups to one node.
The number of candidates is linear in the nodes whatever the size of a region, and the orders are dealt
out by range, so a large region is spread over many tasks.

Candidates whose signatures agree too rarely for the threshold (by ``SIGMAS`` standard deviations) are
dropped; links are confirmed on the word shingles of the whole texts. First each node's most promising
link is tried, then the best between every two components found so far, then every candidate that still
joins two components. Regions whose pairs were not all candidates are *crowded*; where such a region still
holds several components, all nodes outside its largest component are compared exactly with all its nodes,
which are dealt out in chunks. Components of confirmed links are the result, so no untried pair of a region
could have changed it.

A pair at similarity 0.8 shares a region in a tree with probability 0.51; it is missed by all trees with
probability 0.00005, and by the signature test with about the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, map_batches, materialize, text_of
from kickframe.llm.graph import components

TREES, DEPTH, STEP, HASHES = 14, 3, 4, 64
#: Followers in an order, and bytes of the order that make the deeper part of a region.
NEXT, DEEPER = 4, 4
SIGMAS = 4.2
#: Nodes of a crowded region that one task holds at once.
CHUNK = 1024
_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_PLACES = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_REGION = _rng.integers(0, 1 << 63, (TREES, DEPTH + 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(32)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8").lower().split()


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of ``k`` words; of fewer words the whole run; of none nothing."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both) > 0


class _Memory(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_memory = _Memory()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_memory.__getitem__, words), np.uint64, len(words))
    if len(words) < k:
        return _mix((h * _PLACES[k : k + len(h)]).sum(keepdims=True))
    n = len(h) - k + 1
    total = h[:n] * _PLACES[0]
    for i in range(1, k):
        total = total + h[i : i + n] * _PLACES[i]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        block = hashes[at : at + 2048, None] * _FACTORS + _OFFSETS
        np.minimum(low, block.min(axis=0), out=low)
    return low >> _SHIFT


def _sign(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, check, n, key, regions, low): per row its set's size, 128-bit digest, regions by tree, and the minima's lowest bytes."""
    ddl = "id bigint, check bigint, n bigint, key binary, regions array<bigint>, low binary"
    schema = arrow_schema(ddl)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, regions, lows = [], [], [], []
        for text in batch.column(2):
            hashes = shingle_hashes(words_of(text.as_py()), k)
            sizes.append(len(hashes))
            if len(hashes):
                minima = signature(hashes)
                starts = np.stack([minima[t * STEP : t * STEP + DEPTH] for t in range(TREES)])
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                regions.append(_mix((starts * _REGION[:, :DEPTH]).sum(axis=1) + _REGION[:, DEPTH]).view(np.int64))
                lows.append(minima.astype(np.uint8).tobytes())
            else:
                keys.append(None)
                regions.append(None)
                lows.append(None)
        new = [pa.array(c, f.type) for c, f in zip([sizes, keys, regions, lows], list(schema)[2:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], schema=schema)

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("check"), text.alias("text"))
    return map_batches(rows, sign, ddl)


class _Forest:
    """Pairs up the rows of one partition as they come, in the order (region, order, id)."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.last: tuple[np.ndarray, ...] | None = None
        self.hubs: dict[int, tuple] = {}

    def _kept(self, rows: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        _, ids, checks, orders = rows
        same = (orders[i] == orders[j]).sum(axis=1)
        good = (same >= self.least) & (ids[i] != ids[j])
        i, j, same = i[good], j[good], same[good]
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return [ids[i], checks[i], ids[j], checks[j], same]

    def pairs(self, rows: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        old = 0
        if self.last is not None:
            old = len(self.last[0])
            rows = tuple(np.concatenate([a, b]) for a, b in zip(self.last, rows, strict=True))
        region, n = rows[0], len(rows[0])
        firsts, seconds = [], []
        for by in range(1, NEXT + 1):
            i = np.arange(max(old - by, 0), n - by)
            i = i[region[i] == region[i + by]]
            firsts.append(i)
            seconds.append(i + by)
        out = [self._kept(rows, np.concatenate(firsts), np.concatenate(seconds))]
        for level in (0, DEEPER):
            out += self._hub_pairs(rows, old, level)
        self.last = tuple(x[-NEXT:] for x in rows)
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def _marks(self, rows: tuple[np.ndarray, ...], s: int, e: int) -> list[np.ndarray]:
        """Rows s to e as members of a crowded region: (id, check, region, 0, -1)."""
        region, ids, checks, _ = (x[s:e] for x in rows)
        return [ids, checks, region, np.zeros(e - s, np.int64), np.full(e - s, -1)]

    def _hub_pairs(self, rows: tuple[np.ndarray, ...], old: int, level: int) -> list[list[np.ndarray]]:
        region, ids, checks, orders = (x[old:] for x in rows)
        if not len(region):
            return []
        prefix = orders[:, :level]
        new = np.append(True, (region[1:] != region[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1))
        starts = np.append(np.flatnonzero(new), len(region))
        out = []
        held = self.hubs.get(level)
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = (int(region[s]), prefix[s].tobytes())
            follows = s == 0 and held is not None and held[0] == key
            if level == 0 and (e - s > NEXT + 1 or s == 0 or e == len(region)):
                # large, or cut by a batch or a partition: not all pairs are made here
                out.append(self._marks((region, ids, checks, orders), s, e))
            if e - s > NEXT + 1 or follows:
                run = tuple(x[s:e] for x in (region, ids, checks, orders))
                if follows:
                    run = tuple(np.concatenate([a, b]) for a, b in zip(held[1], run, strict=True))
                low = np.minimum.accumulate(run[1])
                index = np.arange(len(low))
                hub = np.maximum.accumulate(np.where(np.append(True, low[1:] < low[:-1]), index, 0))
                out.append(self._kept(run, hub[:-1], index[1:]))
                s_hub = tuple(x[hub[-1] : hub[-1] + 1] for x in run)
            elif e == len(region):
                at = s + int(np.argmin(ids[s:e]))
                s_hub = tuple(x[at : at + 1] for x in (region, ids, checks, orders))
            if e == len(region):
                self.hubs[level] = (key, s_hub)
        return out


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, ca, b, cb, same): candidate pairs, a < b, with the number of equal signature bytes; and the members of crowded
    regions as (id, check, region, 0, -1)."""
    share = percent / 100
    least = int(np.ceil(HASHES * (share - SIGMAS * np.sqrt(share * (1 - share) / HASHES))))
    turned = F.concat(F.expr(f"substring(low, tree * {STEP} + {DEPTH} + 1)"), F.expr(f"substring(low, 1, tree * {STEP} + {DEPTH})"))
    rows = nodes.select("id", "check", "low", F.posexplode("regions").alias("tree", "region"))
    rows = rows.select("region", "id", "check", turned.alias("order")).repartitionByRange("region", "order", "id").sortWithinPartitions("region", "order", "id")
    ddl = "a bigint, ca bigint, b bigint, cb bigint, same int"
    schema = arrow_schema(ddl)

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest(least)
        for batch in batches:
            if batch.num_rows:
                orders = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
                found = forest.pairs((*(batch.column(c).to_numpy() for c in range(3)), orders))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema)

    return rows.mapInArrow(pair_up, ddl).distinct()


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are similar by the full shingle sets of their texts."""
    side = lambda x, c, t: texts.select(F.col("id").alias(x), F.col("check").alias(c), F.col("text").alias(t))
    full = pairs.join(side("b", "cb", "tb"), ["b", "cb"]).join(side("a", "ca", "ta"), ["a", "ca"]).select("a", "b", "ta", "tb")
    schema = arrow_schema("a bigint, b bigint")

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [
            similar(shingles(words_of(x.as_py()), k), shingles(words_of(y.as_py()), k), percent)
            for x, y in zip(batch.column(2), batch.column(3), strict=True)
        ]
        return pa.RecordBatch.from_arrays(list(batch.select([0, 1]).filter(pa.array(good, pa.bool_())).columns), schema=schema)

    return map_batches(full, confirm, "a bigint, b bigint")


def _first_picks(pairs: DataFrame) -> DataFrame:
    """For each node one pair: that with the smallest id among sure ones, else that with the most equal bytes."""
    sure = int(0.9 * HASHES)
    cols = ["a", "ca", "b", "cb", "same"]
    both = pairs.select("a", "ca", "b", "cb", "same", F.col("b").alias("x"), F.col("a").alias("y")).union(
        pairs.select("a", "ca", "b", "cb", "same", F.col("a").alias("x"), F.col("b").alias("y"))
    )
    whole = F.struct(*cols)
    near = F.min(F.when((F.col("same") >= sure) & (F.col("y") < F.col("x")), F.struct("y", whole.alias("p"))))
    best = F.max(F.struct("same", (-F.col("y")).alias("y"), whole.alias("p")))
    return both.groupBy("x").agg(F.coalesce(near["p"], best["p"]).alias("p")).select("p.*").distinct()


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that join two components, with the components' ids as x < y."""
    label = lambda node, name: found.select(F.col("id").alias(node), F.col("component").alias(name))
    labelled = pairs.join(label("a", "x"), "a", "left").join(label("b", "y"), "b", "left")
    x, y = F.coalesce("x", "a"), F.coalesce("y", "b")
    return labelled.select("a", "ca", "b", "cb", "same", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).where("x != y")


def _crowded_links(crowd: DataFrame, found: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, ca, b, cb): pairs that join two components within the regions of ``crowd``, at most one for each two in a chunk.

    A region's nodes are dealt into chunks; those outside its largest component go to every chunk and are
    compared there, one after another, with all the nodes of the chunk by their hashed shingles.
    """
    named = found.select("id", F.col("component").alias("c"))
    rows = crowd.join(named, "id", "left").select("region", "id", "check", F.coalesce("c", "id").alias("c"))
    counts = rows.groupBy("region", "c").agg(F.count("*").alias("n"))
    open_regions = counts.groupBy("region").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    chunks = F.ceil(F.col("total") / CHUNK).cast("int")
    placed = rows.join(open_regions.select("region", "main", chunks.alias("chunks")), "region")
    member = placed.select("region", "id", "check", "c", F.pmod(F.xxhash64("id", "check"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("probe"))
    probes = placed.where("c != main").select("region", "id", "check", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("probe"))
    full = member.union(probes).join(texts, ["id", "check"]).repartition("region", "chunk").sortWithinPartitions("region", "chunk", "probe")
    ddl = "a bigint, ca bigint, b bigint, cb bigint"
    schema = arrow_schema(ddl)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            out = []
            for region, number, probe, i, check, c, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if chunk is None or chunk.key != (region, number):
                    chunk = _Chunk((region, number), percent)
                hashes = shingle_hashes(words_of(text), k)
                if probe:
                    out += chunk.links(i, check, c, hashes)
                else:
                    chunk.add(i, check, c, hashes)
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return full.select("region", "chunk", "probe", "id", "check", "c", "text").mapInArrow(compare, ddl).distinct()


class _Chunk:
    """Nodes of a region with their hashed shingles, to compare others with."""

    def __init__(self, key: tuple[int, int], percent: int) -> None:
        self.key, self.percent = key, percent
        self.nodes: list[tuple[int, int]] = []
        self.components: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.merged: dict[int, int] = {}

    def add(self, i: int, check: int, component: int, hashes: np.ndarray) -> None:
        self.nodes.append((i, check))
        self.components.append(component)
        self.hashes.append(hashes)

    def _root(self, component: int) -> int:
        while component in self.merged:
            component = self.merged[component]
        return component

    def links(self, i: int, check: int, component: int, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """For each other component that the node is similar to a link, smaller id first; they count as one from then on."""
        if not self.nodes:
            return
        if self.hashes:
            self.sizes = np.array([len(h) for h in self.hashes])
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.values, self.which = np.unique(np.concatenate(self.hashes), return_inverse=True)
            self.labels = np.array(self.components)
            self.hashes = []
        own = self._root(component)
        at = np.minimum(np.searchsorted(self.values, hashes), len(self.values) - 1)
        has = np.zeros(len(self.values), np.int64)
        has[at[self.values[at] == hashes]] = 1
        both = np.add.reduceat(has[self.which], self.starts)
        for m in np.flatnonzero(100 * both >= self.percent * (self.sizes + len(hashes) - both)).tolist():
            other = self._root(int(self.labels[m]))
            if other != own:
                self.merged[other] = own
                j, other_check = self.nodes[m]
                yield (i, check, j, other_check) if i < j else (j, other_check, i, check)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``; other columns are ignored.

    Documents whose shingle sets have ``percent`` in 100 of their union in common are linked;
    ``component_id`` is the smallest id reachable over links, ``kept`` marks the rows whose own id that
    is. Null and empty texts, and those of white space only, have no shingles and are alone. Rows that
    repeat an id are each judged by their own text; a row without id has no component and is kept. An empty table gives no rows. Ids are integers.
    """
    signed = materialize(_sign(docs, shingle, id_col, text_col))
    some = signed.where("n > 0 and id is not null")
    first = F.min(F.struct("id", "check"))
    nodes = some.groupBy("key").agg(first.alias("node"), F.first("regions").alias("regions"), F.first("low").alias("low"))
    made = materialize(_candidates(nodes.select("node.*", "regions", "low"), percent))
    pairs = made.where("same >= 0")
    crowd = made.where("same < 0").select(F.col("a").alias("id"), F.col("ca").alias("check"), F.col("b").alias("region"))

    ends = made.select("a", "ca").union(pairs.select("b", "cb")).distinct().toDF("id", "check")
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).withColumn("check", F.xxhash64("text"))
    texts = materialize(text.join(ends, ["id", "check"], "left_semi").dropDuplicates(["id", "check"]))

    links = materialize(_confirm(_first_picks(pairs), texts, shingle, percent))
    found = components(links)
    best = lambda p: p.groupBy("x", "y").agg(F.max_by(F.struct("a", "ca", "b", "cb"), F.struct("same", "a", "b")).alias("p")).select("p.*")
    candidates = (
        lambda: best(_across(pairs, found)),
        lambda: _across(pairs, found).select("a", "ca", "b", "cb"),
        # a part of the crowded regions joins most of what they can join, so the rest moves few texts
        lambda: _crowded_links(crowd.where("pmod(region, 4) = 0"), found, texts, shingle, percent),
        lambda: _crowded_links(crowd.where("pmod(region, 4) != 0"), found, texts, shingle, percent),
    )
    for pick in candidates:
        more = materialize(_confirm(pick(), texts, shingle, percent))
        if more.isEmpty():
            continue
        found = components(found.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    sets = some.groupBy("key").agg(F.min("id").alias("rep"))
    return _label(signed, sets, found, id_col)


def _label(signed: DataFrame, sets: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    classes = sets.join(found, sets["rep"] == found["id"], "left").select("key", F.coalesce("component", "rep").alias("class"))
    joined = signed.join(classes, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no near-duplicate with a smaller id represents, with the columns of ``docs``.

    Of rows that repeat an id all go if one is represented.
    """
    gone = near_duplicates(docs, shingle, percent, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
