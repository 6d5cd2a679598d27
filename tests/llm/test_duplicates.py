"""Near-duplicates, passages, exact strings and decontamination against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from kickframe.llm import decontaminate, graph, minhash_dedup, passage_dedup, queries, substring_exact
from tests.llm import plain
from tests.llm.conftest import SF


def rows(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def words(rng, n, most=5000):
    return [f"w{rng.randrange(most)}" for _ in range(n)]


def edited(rng, w, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else x for x in w]


def test_near_duplicates_query(spark, documents, same):
    same(queries.op3_minhash_dedup(spark, SF), plain.near_duplicate_rows(documents))


def test_near_duplicates_of_many_near_copies(spark, same):
    rng = random.Random(5)
    base = words(rng, 150)
    docs = [(i, " ".join(edited(rng, base, 0.02))) for i in range(120)] + [(200 + i, " ".join(words(rng, 60))) for i in range(40)]
    docs += [(300 + i, " ".join(base)) for i in range(60)] + [(400 + i, " ".join(edited(rng, base, 0.04))) for i in range(60)]
    rng.shuffle(docs)
    same(minhash_dedup.near_duplicates(rows(spark, docs), 4), plain.near_duplicate_rows(docs))


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash_dedup.near_duplicates(odd, 4)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert got.count() == odd.count()
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (6, 1, 5, False), (8, len(plain.shingles("token = abcdef123 " * 30 + "é𝄞 secret:'zzzzzzzz'", 4)), 7, False), (None, 1, None, True)} <= found
    kept = minhash_dedup.keep_first(odd, 4)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == sorted([1, 2, 3, 4, 5, 5, 7, -3, None], key=repr)
    assert minhash_dedup.near_duplicates(none, 4).count() == 0 and minhash_dedup.keep_first(none).count() == 0


def test_near_duplicates_just_at_the_threshold(spark):
    """Recall, measured: every pair at 0.8 to 0.85 of the union is linked, pair by pair without helpers."""
    rng = random.Random(8)
    docs, pairs = [], []
    for k in range(300):
        a = words(rng, 120, 10**6)
        b = list(a)
        while 100 * len(plain.shingles(" ".join(a), 4) & plain.shingles(" ".join(b), 4)) >= 85 * len(plain.shingles(" ".join(a), 4) | plain.shingles(" ".join(b), 4)):
            b[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        both = len(plain.shingles(" ".join(a), 4) & plain.shingles(" ".join(b), 4))
        if 100 * both >= 80 * len(plain.shingles(" ".join(a), 4) | plain.shingles(" ".join(b), 4)):
            pairs.append(2 * k)
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(rows(spark, docs), 4).collect()}
    linked = sum(found[i + 1] == i for i in pairs)
    assert len(pairs) > 100 and linked >= 0.99 * len(pairs)
    assert all(found[2 * k + 1] == 2 * k + 1 for k in range(300) if 2 * k not in pairs)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = plain.components({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in want.items())


def passages_of(df):
    return {r.doc_id: [(p.start, p.end) for p in r.passages] for r in df.collect()}


def test_passages_planted(spark):
    """Every exact or lightly edited copy of a passage is found, in all documents that have it, and clean ones are left alone."""
    rng = random.Random(11)
    shared = [words(rng, n, 10**6) for n in (55, 60, 80, 120, 200)]
    docs, where = [], {}
    for i in range(150):
        w, marks = words(rng, rng.randrange(30, 400), 10**6), []
        if i % 3 == 0:
            p = shared[rng.randrange(5)]
            at = rng.randrange(len(w))
            w[at:at] = edited(rng, p, 0.01) if i % 2 else p
            marks = [(at, at + len(p), tuple(p))]
        docs.append((i, " ".join(w)))
        where[i] = marks
    got = passages_of(passage_dedup.near_passages(rows(spark, docs)))
    for i, marks in where.items():
        if not marks:
            assert got[i] == []
        for a, b, _ in marks if i % 2 == 0 else ():
            assert any(x <= a and y >= b for x, y in got[i]), (i, a, b, got[i])
    light = [i for i, m in where.items() if m and i % 2]
    assert sum(bool(got[i]) for i in light) >= 0.9 * len(light)


def test_passages_query_links(spark, documents):
    """All documents that share a passage, by trying every pair of windows on the shorter texts, are in one component."""
    short = [d for d in documents if len((d[1] or "").split()) < 120]
    found = passage_dedup.near_passages(rows(spark, short)).select("doc_id", "component_id").collect()
    component = {r.doc_id: r.component_id for r in found}
    links = plain.near_passage_links(short)
    joined = sum(component[a] == component[b] for a, b in links)
    assert joined >= 0.98 * len(links)
    # and nothing else: a class has no documents but those of the links
    want = plain.components([i for i, _ in short], links)
    assert all(want[i] == want[c] for i, c in component.items())
    assert queries.op4_passage_dedup(spark, SF).count() == len(documents)


def test_passages_of_odd_rows(odd, none):
    got = passage_dedup.near_passages(odd)
    found = {(r.doc_id, r.n_words, len(r.passages), r.component_id) for r in got.collect()}
    assert got.count() == odd.count()
    assert {(1, 0, 0, 1), (2, 0, 0, 2), (3, 0, 0, 3), (None, 3, 0, None), (7, 92, 1, 7), (8, 92, 1, 7)} <= found
    assert passage_dedup.near_passages(none).count() == 0


def test_compact_windows_are_those_of_the_definition():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        n, width = int(rng.integers(1, 40)), int(rng.integers(1, 10))
        values = rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)
        key = [(int(v) >> 32, i) for i, v in enumerate(values)]
        want = set()
        for p in range(n):
            a = p
            while a and key[a - 1] > key[p]:
                a -= 1
            b = p
            while b < n - 1 and key[b + 1] > key[p]:
                b += 1
            if b - a + 1 >= width:
                want.add((p, a, b))
        assert set(map(tuple, passage_dedup.compact_windows(values, width).T.tolist())) == want


def test_exact_query(spark, documents, same):
    same(queries.op9_substring_exact(spark, SF), plain.repeated_rows(documents))


@pytest.mark.parametrize("together", [2, 20_000])
def test_exact_strings(spark, same, together):
    """Overlapping repeats, periods, repeats within a text and a common passage, with both ways of comparing."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdé", k=n))
    common = letters(260)
    docs = [(i, letters(rng.randrange(300)) + common[rng.randrange(30) : rng.randrange(210, 260)] + letters(rng.randrange(200))) for i in range(60)]
    docs += [(100, "a" * 500), (101, "ab" * 300), (102, common + "x" + common), (103, ""), (104, None), (105, "a" * 199), (106, "a" * 200), (107, common), (108, common)]
    found = substring_exact.repeated(rows(spark, docs), length=200, together=together)
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    same(found.select("doc_id", "n_bytes", size, F.size("spans"), F.sha2("kept", 256)), plain.repeated_rows(docs))


def test_exact_of_odd_rows(odd, none):
    got = {(r.doc_id, r.n_bytes, len(r.spans)) for r in substring_exact.repeated(odd).collect()}
    n = len(("token = abcdef123 " * 30 + "é𝄞 secret:'zzzzzzzz'").encode())
    assert {(1, 0, 0), (2, 0, 0), (3, 3, 0), (7, n, 1), (8, n, 1), (None, 13, 0)} <= got
    assert substring_exact.repeated(odd).count() == odd.count()
    assert substring_exact.repeated(none).count() == 0


def benchmark_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]


def test_decontaminate_query(spark, documents, same):
    bench = benchmark_of(spark)
    same(queries.op8_decontaminate(spark, SF), [plain.decontaminated_row(*d, bench) for d in documents])


def test_decontaminate_blocks_and_odd_rows(spark, odd, none):
    bench = [(1, "one two three"), (2, "TOKEN abcdef123 token"), (3, None), (4, ""), (5, "é𝄞 secret"), (6, "nothing of this"), (2, "TOKEN abcdef123 token"), (None, "word5 word6"), (7, " ".join(f"word{i}" for i in range(50, 90)))]
    items = spark.createDataFrame([(*r, "x") for r in bench], "item_id bigint, text string, doc_id string")
    for block in (30, 8_000_000):
        got = decontaminate.search(odd, items, block_bytes=block)
        found = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got.collect()), key=repr)
        want = []
        for i, text in odd.select("doc_id", "text").collect():
            w = plain.decontaminated_row(i, text, bench)
            own = sorted({str(b) for b, t in bench if b is not None and plain.decontaminated_row(i, text, [(b, t)])[3]})
            want.append((*w[:3], own))
        assert found == sorted(want, key=repr)
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and {5, 6, 7, 8}.isdisjoint(r.doc_id for r in kept.select("doc_id").collect()) and kept.count() == 5
    assert decontaminate.search(none, items).count() == 0
    assert {r.n_words for r in decontaminate.search(odd, items.limit(0)).select("n_words").collect()} >= {0, 3}


def test_passages_without_a_common_neighbour(spark):
    """Two texts share a passage; all others have parts of it that are too short for one and sort between them or before."""
    rng = random.Random(3)
    shared = words(rng, 60, 10**6)
    text = lambda part: " ".join([*words(rng, 40, 10**6), *part, *words(rng, 40, 10**6)])
    docs = [(i, text(shared[o : o + 36])) for i in range(1, 150) for o in [rng.randrange(25)]]
    docs += [(1000, text(shared)), *((1000 + i, text(shared[o : o + 36])) for i in range(1, 150) for o in [rng.randrange(25)]), (2000, text(shared))]
    nodes = spark.createDataFrame([(i, i, t) for i, t in docs], "id bigint, node bigint, text string")
    pairs, found = passage_dedup.passage_pairs(nodes)
    assert any((r.a, r.b) == (1000, 2000) and r.a_start <= 41 and r.a_end >= 99 for r in pairs.collect())
    assert {r.id: r.component for r in found.collect()}[2000] == 1000


@pytest.mark.parametrize("times", [1, 8, 9, 40])
def test_areas_of_a_passage_once_against_many_times(times):
    meetings = [(f, 20 + f, 200 * k + 20 + f, 20 + f, 30 - f) for f in range(2) for k in range(times)]
    want = [(0, 50, 200 * k, 200 * k + 50) for k in range(times)]
    assert sorted(passage_dedup._areas(meetings, 2), key=lambda a: a[2]) == want


def changed(w, *places):
    return [f"y{i}" if i in places else x for i, x in enumerate(w)]


def verified(one, two):
    import numpy as np

    a, b = (passage_dedup.shingle_sequence([x.encode() for x in w], 5) for w in (one, two))
    return [(np.array(p) + (0, 5, 0, 5)).tolist() for p in passage_dedup._passages(a, b, 46, 80)]


@pytest.mark.parametrize(("n", "place"), [(52, 2), (54, 4), (52, 49), (54, 49)])
def test_passages_with_a_change_near_an_end(n, place):
    w = words(random.Random(n), n, 10**6)
    ((a, b, c, d),) = verified(w, changed(w, place))
    assert b - a >= 50 and d - c >= 50


def test_passages_before_a_stretch_of_changes():
    w = words(random.Random(4), 200, 10**6)
    found = verified(w, changed(w, 44, *range(89, 200, 10)))
    assert any(a <= 0 and b >= 89 for a, b, _, _ in found)


def test_passages_are_those_of_every_run():
    """Wherever some pair of stretches on one diagonal passes, what is found covers its shared shingles."""
    import numpy as np

    for seed in range(60):
        rng = random.Random(seed)
        w = words(rng, 110, 10**6 if seed % 3 else 60)
        v = changed(w, *rng.sample(range(110), rng.randrange(3, 14)))
        a, b = (passage_dedup.shingle_sequence([x.encode() for x in t], 5) for t in (w, v))
        found = list(passage_dedup._passages(a, b, 46, 80))
        for i, j, low, high in found:
            assert j - i >= 45 and high - low >= 45 and plain_similar(a[i : j + 1], b[low : high + 1])
        covered = {x for i, j, _, _ in found for x in range(i, j + 1)}
        for i in range(len(a)):
            for j in range(i + 45, len(a)):
                if plain_similar(a[i : j + 1], b[i : j + 1]):
                    assert set((np.flatnonzero(a[i : j + 1] == b[i : j + 1]) + i).tolist()) <= covered


def test_stretches_without_a_passage_are_turned_down_by_one_ranking_of_each_side(monkeypatch):
    """Crowded groups hold mostly such pairs: enough shingles in common, too few of them together."""
    import numpy as np

    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, 1 << 62, 240).astype(np.uint64) for _ in range(2))
    b[::4] = a[::4]
    called = []
    for name in ("unique", "isin"):
        monkeypatch.setattr(np, name, lambda *x, f=getattr(np, name), **y: called.append(f) or f(*x, **y))
    assert list(passage_dedup._passages(a, b, 46, 80)) == []
    assert not called


def test_windows_of_many_texts_are_those_of_each():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(50):
        sizes = rng.integers(1, 30, 6)
        ends = np.cumsum(sizes + 2) - 3
        starts = ends - sizes + 1
        values = rng.integers(0, 40, ends[-1] + 3, np.uint64) << np.uint64(32)
        want = [w + s for s, e in zip(starts, ends, strict=True) for w in passage_dedup.compact_windows(values[s : e + 1], 7).T]
        assert passage_dedup.compact_windows(values, 7, (starts, ends)).T.tolist() == np.array(want).reshape(-1, 3).tolist()


def test_runs_that_cannot_be_widened_are_turned_down_by_counts(monkeypatch):
    """A run that is similar, but too short on one side, and no longer similar with what lies around it."""
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 62, 160).astype(np.uint64) for _ in range(2))
    b[60:80], b[90:111] = a[60:80], a[80:101]
    called = []
    similar = passage_dedup._Fits._similar
    monkeypatch.setattr(passage_dedup._Fits, "_similar", lambda *x: called.append(x) or similar(*x))
    assert list(passage_dedup._passages(a, b, 46, 80)) == []
    assert not called


def test_texts_that_repeat_few_words_have_no_double_values():
    """A passage shares 41 distinct shingles; a window with fewer is compared with nothing."""
    import numpy as np

    none, one = np.zeros(0, np.int64), np.arange(100).astype(np.uint64)
    few = np.tile(np.arange(40), 30).astype(np.uint64)

    def doubles(sequence):
        hashed = [passage_dedup._mix(sequence * f + o) for f, o in zip(passage_dedup._FACTORS, passage_dedup._OFFSETS, strict=True)]
        windows = [passage_dedup.compact_windows(h, 46)[0] for h in hashed]
        place, f = np.concatenate(windows), np.repeat(np.arange(4), [len(w) for w in windows])
        values = np.stack([(h & ~np.uint64(7)) | np.uint64(k) for k, h in enumerate(hashed)]).view(np.int64)
        marks = values[f, place], place, np.ones(len(place), bool), np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        return passage_dedup._doubles(sequence, marks, place.astype(np.int64) * 8 + f, 46, 41)

    assert doubles(few) is None and doubles(none.astype(np.uint64)) is None
    key, _, low, high, probe, _, settled = doubles(one)
    assert len(key) and (high - low >= 45).all() and probe.all() and not settled.any()
    assert passage_dedup._reach(few, 41).tolist() == [len(few)] * len(few)
    assert passage_dedup._reach(one, 41).tolist() == [min(i + 40, 100) for i in range(100)]


def plain_similar(a, b):
    one, two = set(a.tolist()), set(b.tolist())
    return 100 * len(one & two) >= 80 * len(one | two)


def test_texts_that_repeat_themselves_are_turned_down_by_their_distinct_shingles(monkeypatch):
    """Runs of such texts have many shared places, but fewer values in common than any stretch of the least width has to."""
    import numpy as np

    a, b = np.tile(np.arange(50), 20).astype(np.uint64), np.tile(np.arange(25, 63), 25).astype(np.uint64)
    called = []
    of = passage_dedup._RunCounts.of
    monkeypatch.setattr(passage_dedup._RunCounts, "of", lambda *x: called.append(x) or of(*x))
    assert list(passage_dedup._passages(a, b, 46, 80)) == []
    assert not called
    # six words over and over are a passage, also beside others
    six = np.concatenate([np.arange(100, 160), np.tile(np.arange(6), 10)]).astype(np.uint64)
    assert any(j - i >= 45 for i, j, _, _ in passage_dedup._passages(six, np.tile(np.arange(6), 12).astype(np.uint64), 46, 80))


def test_distinct_values_of_stretches():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(40):
        values = rng.integers(0, rng.integers(1, 60), rng.integers(46, 150)).astype(np.uint64)
        assert passage_dedup._distinct(values, 46).tolist() == [len(set(values[i : i + 46].tolist())) for i in range(len(values) - 45)]


def test_double_values_of_many_texts_are_those_of_each():
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 90 if k % 3 else 1 << 40, rng.integers(60, 300)).astype(np.uint64) for k in range(8)]

    def marked(sequence, start):
        hashed = [passage_dedup._mix(sequence * f + o) for f, o in zip(passage_dedup._FACTORS, passage_dedup._OFFSETS, strict=True)]
        windows = [passage_dedup.compact_windows(h, 46)[0] for h in hashed]
        place, f = np.concatenate(windows), np.repeat(np.arange(4), [len(w) for w in windows])
        values = np.stack([(h & ~np.uint64(7)) | np.uint64(k) for k, h in enumerate(hashed)]).view(np.int64)
        some = place % 2 == 0
        return (values[f, place], place + start, some, place % 3, ~some), (place.astype(np.int64) + start) * 8 + f

    want, marks, partners, starts = [], [], [], []
    for k, text in enumerate(texts):
        starts.append(sum(len(x) + 4 for x in texts[:k]))
        found = passage_dedup._doubles(text, *marked(text, 0), 46, 41)
        if found:
            key, place, low, high, *rest = found
            want += zip(key, *(x + starts[-1] for x in (place, low, high)), *rest, strict=True)
        one, two = marked(text, starts[-1])
        marks.append(one)
        partners.append(two)
    starts = np.array(starts)
    # between two texts lie shingles of both
    whole = np.concatenate([np.append(x, rng.integers(0, 90, 4).astype(np.uint64)) for x in texts])
    ends = starts + [len(x) - 1 for x in texts]
    found = passage_dedup._doubles(whole, tuple(map(np.concatenate, zip(*marks, strict=True))), np.concatenate(partners), 46, 41, (starts, ends))
    assert len(want) > 50 and sorted(zip(*found, strict=True)) == sorted(want)


@pytest.mark.parametrize("known", [False, True])
def test_windows_with_a_known_passage_beside_their_place_are_not_compared(monkeypatch, known):
    """Two texts share a passage, and some words further on that a double value was made of; the passage is looked for unless it is known."""
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 62, 130).astype(np.uint64) for _ in range(2))
    b[:60], b[110:118] = a[:60], a[110:118]
    called = []
    verify = passage_dedup._passages
    monkeypatch.setattr(passage_dedup, "_passages", lambda *x: called.append(x) or verify(*x))
    bare = np.ones(130, bool)
    bare[:60] = not known
    chunk = passage_dedup._Seekers((1, 0), 46, 5, 80, 24)
    chunk.alone = True
    chunk.members += [(1, 114, 0, True, None, a, bare.copy()), (2, 114, 0, False, 7, b, bare.copy())]
    assert chunk.among() == (set() if known else {(1, 0, 64, 2, 0, 64)})
    assert len(called) == (not known)


def test_a_passage_that_holds_the_place_is_found_wherever_its_words_are_known():
    """The same passage is known on either side, in different components."""
    import numpy as np

    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 1 << 62, 130).astype(np.uint64) for _ in range(2))
    b[20:90] = a[20:90]
    b[50] = 1
    chunk = passage_dedup._Seekers((1, 0), 46, 5, 80, 24)
    chunk.alone = True
    chunk.members += [(1, 60, 0, True, 5, a, np.zeros(130, bool)), (2, 60, 0, False, 7, b, np.zeros(130, bool))]
    assert chunk.among() == {(1, 20, 94, 2, 20, 94)}


def test_shingles_of_several_slices_are_those_of_each():
    slices = [" ".join(words(random.Random(k), n, 40)).encode() for k, n in enumerate((5, 50, 6, 120))]
    got = passage_dedup._sequences(slices, 5)
    assert [x.tolist() for x in got] == [passage_dedup.shingle_sequence(x.split(), 5).tolist() for x in slices]
    assert passage_dedup._sequences([], 5) == []


def test_crowded_groups_in_several_chunks_give_the_same_components(spark, monkeypatch):
    """Windows of one double value that are dealt out find the same partners as those that are all in one chunk."""
    rng = random.Random(12)
    shared = [words(rng, 70, 10**6) for _ in range(2)]
    text = lambda part: " ".join([*words(rng, 30, 10**6), *part, *words(rng, 30, 10**6)])
    docs = [(i, text(changed(shared[i % 2], *rng.sample(range(70), i % 7)))) for i in range(80)]
    nodes = spark.createDataFrame([(i, i, t) for i, t in docs], "id bigint, node bigint, text string")
    found = []
    for chunk in (1024, 8):
        monkeypatch.setattr(passage_dedup, "CHUNK", chunk)
        found.append(sorted(map(tuple, passage_dedup.passage_pairs(nodes)[1].collect())))
    assert found[0] == found[1] and len({c for _, c in found[0]}) >= 2
