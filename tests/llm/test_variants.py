"""Spelling variants, vector codes and URL filters against plain versions, on odd rows and planted cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from kickframe.llm import spelling, url_filters, vector_codes
from kickframe.llm.url_filters import Rule


def plain_words(rows, letters=7, damage=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                counts[run] += 1
    return counts


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, letters=7, times=2, factor=10, damage=31):
    n = {w: c for w, c in plain_words(rows, letters, damage).items() if c >= times}
    forms, degree = {}, {}
    for w in n:
        about = [v for v in n if near(w, v)]
        degree[w] = len(about)
        best = min(about, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], degree[w], n[forms[w]] if forms[w] else None))
    return out


WORDS = {"abcdefgh": 500, "abcdefg": 40, "abcdefx": 4, "abcdefxy": 40, "bbcdefgh": 50, "abcdeffgh": 5, "aaaaaaaa": 30, "aaaaaaa": 3, "ççççççç": 20, "çççççççç": 2, "ßcdefgh": 2, "zzzzzzzzz": 2, "once": 1, "abcdefghi": 50, "tiedwordx": 30, "tiedwordy": 30, "tiedword": 3}


def test_variants_of_planted_words(spark, same):
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(WORDS.items())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(spelling.variants(df, damage=0), plain_variants(rows, damage=0))
    found = {r["word"]: r for r in spelling.variants(df, damage=0).collect()}
    assert found["tiedword"]["form"] == "tiedwordx"
    assert found["abcdefx"]["form"] == "abcdefg" or found["abcdefx"]["form"] == "abcdefxy"
    assert found["abcdefx"]["root"] == "abcdefgh" or found["abcdefx"]["root"] == "abcdefxy"
    assert found["zzzzzzzzz"]["n_near"] == 0 and found["zzzzzzzzz"]["root"] == "zzzzzzzzz"


def test_variants_of_odd_rows(spark, odd, none, same):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    same(spelling.variants(odd, letters=3), plain_variants(rows, letters=3))
    assert spelling.variants(none).collect() == []


def test_variants_of_long_runs_and_crowds(spark, same):
    """Runs beyond the literal key, of equal beginnings; and a word with more insertions and replacements than any other."""
    long = "lorem" * 40
    rows = [(1, " ".join([long] * 30 + [long[:-1] + "x"] * 2 + [long + "a"] * 3 + ["x" + long[1:]] * 2 + [long[:100] + long[101:]] * 2))]
    rows += [(2, " ".join(w for c in "abcdefghijklmnopqrstuvwxyzàáâ" for w in [f"center{c}"] * 2 + [f"cen{c}ter"] * 2)), (3, "center " * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(spelling.variants(df, letters=6), plain_variants(rows, letters=6))


def test_words_are_handed_on_in_bounded_dictionaries(spark, documents, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    assert {r[0]: r[1] for r in spelling.count_words(df).collect()} == plain_words(documents)


def plain_codes(rows, rounds=4, entries=256):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(4)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[assign(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    coded = [(i, lab, [assign(v, p) for p in range(4)]) for i, v, lab in kept]
    by = Counter()
    for _, lab, parts in coded:
        by[lab] += sum(d for d, _ in parts)
    return [(i, "".join(f"{k:02x}" for _, k in parts), sum(d for d, _ in parts), by[lab], sha) for i, lab, parts in coded]


DDL = "vec_id bigint, embedding array<float>, label int, code string, id string, v int, parts binary, s0 int"
FILL = ("c", "i", 1, bytearray(b"p"), 2)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *FILL) for r in rows], DDL)


@pytest.mark.parametrize("entries", [256, 7, 1])
@pytest.mark.parametrize("spread", [40.0, 0.01, 20000.0])
def test_codes_are_those_of_full_scans(spark, same, monkeypatch, entries, spread):
    import random

    rnd = random.Random(entries)
    values = [[round(rnd.uniform(-1, 1), 2) * spread for _ in range(8)] for _ in range(400)]
    rows = [(i, [float.fromhex(float(x).hex()) for x in v], rnd.choice([1, 2, None])) for i, v in enumerate(values)]
    # ties and repeated rows, and what is dropped
    rows += [(5, values[5], 1), (5, values[5], 1), (None, values[3], None), (900, None, 1), (901, [1.0, None] * 4, 1), (902, [math.nan] * 8, 2), (903, [math.inf] * 8, 2), (904, [0.0] * 8, None)]
    df = vectors(spark, rows)
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    monkeypatch.setattr(vector_codes, "CHUNK", 8 * 64)
    monkeypatch.setattr(vector_codes, "BLOCK", 1000)
    same(vector_codes.encode(df.repartition(3), entries=entries), plain_codes(exact, entries=entries))


def test_most_parts_are_not_looked_at_again():
    """In settled rounds the heaps spare the scan."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (16, 4, 4))
    parts = centres[rng.integers(0, 16, 5000)] + rng.integers(-20, 20, (5000, 4, 4))
    books = centres.transpose(1, 0, 2)
    chunk = vector_codes._Chunk(parts, 16)
    chunk.start(books)
    looked = []
    real = vector_codes._nearest
    vector_codes._nearest = lambda part, book: looked.append(len(part)) or real(part, book)
    try:
        chunk.again(books + 3, np.full((4, 16), 2 * math.sqrt(4 * 9)))
    finally:
        vector_codes._nearest = real
    assert sum(looked) < 2000
    codes, _ = chunk.codes(books + 3)
    want = ["".join(f"{k:02x}" for k in (((p[:, None] - (books + 3)) ** 2).sum(axis=2)).argmin(axis=1)) for p in parts]
    assert codes == want


def test_codes_of_odd_tables(spark):
    assert vector_codes.encode(vectors(spark, [])).collect() == []
    assert vector_codes.encode(vectors(spark, [(1, None, 1)])).collect() == []
    assert [tuple(r)[1:4] for r in vector_codes.encode(vectors(spark, [(1, [1.0] * 4, None)])).collect()] == [("00000000", 0, 0)]
    with pytest.raises(Exception, match="cannot be cut"):
        vector_codes.encode(vectors(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="another length"):
        vector_codes.encode(vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)])).collect()
    with pytest.raises(Exception, match="another length"):
        vector_codes.encode(vectors(spark, [(i, [float(i)] * 4, 1) for i in range(300)] + [(900, [1e30] * 4, 1)])).collect()


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
PAGE = "page_id bigint, url string, host int, path int, rule string, verdict int, rate string, n int, k int, node int"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, 1, 2, "r", 3, "x", 4, 5, 6) for i, u in enumerate(urls)], PAGE)


def no_labels(spark):
    return spark.createDataFrame([], "url string, bad boolean")


def test_rules_and_addresses(spark):
    long = "http://x.org/" + "a" * 100_000 + "/b" * 5000 + "?q"
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "http://example.net/en/1?x": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://B.Example.NET/en/": ("b.example.net", "/en/", "example.net/en/", "allow"), "http://badexample.net/en/1": ("badexample.net", "/en/1", "net/", "block"), "x://example.com/de/1#y": ("example.com", "/de/1", "example.com/de/", "block"),
        "x://example.com/DE/1": ("example.com", "/DE/1", None, "allow"), "http://É.org/fr/a://b": ("É.org", "/fr/a://b", "org/fr/", "allow"), "no address": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://?q": ("", "", None, "allow"), "http://net/": ("net", "/", "net/", "block"), "http://a.net:80/x": ("a.net:80", "/x", None, "allow"), "a://b\n.org/c\nd?": ("b\n.org", "/c\nd", None, "allow"), long: ("x.org", long[len("http://x.org") : -2], None, "allow"),
    }
    got = url_filters.judge(pages(spark, [*cases, *cases]), no_labels(spark), RULES)
    found = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()]
    assert sorted(found) == sorted((i, *want) for i, want in enumerate([*cases.values(), *cases.values()]))
    assert url_filters.judge(pages(spark, []), no_labels(spark), RULES).collect() == []


def test_templates_follow_labels(spark):
    """Variable segments become wildcards, like branches merge, and branches that labels condemn are rejected, also unlabelled urls of them."""
    urls, bad = [], []
    for i in range(300):
        for part, is_bad in (("news", False), ("blog", False), ("win", True)):
            urls.append(f"http://h.com/{part}/{part}{i}/index.html?s=1")
            if i % 3 == 0:
                bad.append((urls[-1], is_bad))
    urls += [f"http://h.com/rare{i}" for i in range(60)] + ["http://other.com/win/1", "http://h.com/win/x/index.html/deep/er/still", "http://h.com/w*n/(a|b)"]
    labelled = spark.createDataFrame([*bad, (None, True), (urls[0], None)], "url string, bad boolean")
    found = {urls[r["page_id"]]: r for r in url_filters.judge(pages(spark, urls), labelled, RULES).collect()}
    assert len(found) == len(urls)
    assert found["http://h.com/news/news7/index.html?s=1"]["template"] == "/(blog|news)/*/index.html"
    assert found["http://h.com/win/win7/index.html?s=1"]["template"] == "/win/*/index.html"
    for url, row in found.items():
        assert row["verdict"] == ("block" if url.startswith("http://h.com/win/") else "allow"), url
    assert found["http://h.com/rare3"]["template"] == "/*"
    assert found["http://h.com/win/x/index.html/deep/er/still"]["template"].endswith("/**")


def test_a_hot_host_of_variable_segments_keeps_few_branches(spark):
    urls = [f"http://hot.com/{i}/{i % 7}" for i in range(3000)] + [f"http://h{i}.com/a" for i in range(50)]
    found = url_filters.judge(pages(spark, urls), no_labels(spark), ()).groupBy("host", "template").count().collect()
    assert {r["template"] for r in found if r["host"] == "hot.com"} == {f"/*/{i}" for i in range(7)}
