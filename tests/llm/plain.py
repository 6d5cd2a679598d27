"""Plain one-process versions of the numbered queries, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def secret_row(doc_id, text) -> tuple:
    spans = secrets(text)
    digest = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    kinds = Counter(s[3] for s in spans)
    return doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(digest.encode()).hexdigest(), digest


def redacted(text: str | None) -> str | None:
    spans = secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for a, _, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def quality_row(doc_id, text) -> tuple:
    """Up to base_failed; see ``other_rules`` for the rest of the verdict."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n, r = len(words), len(repeated)
    return doc_id, n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def other_rules(text: str | None) -> bool:
    """Whether one of the cascade's own rules rejects."""
    _, n, chars, symbols, dups, _, _ = quality_row(None, text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = sum(any(c.isalpha() for c in w) for w in WORD.findall(text or ""))
    return 10 * symbols > n or chars < 2 * n or chars > 40 * n or 2 * dups > len(lines) or 10 * letters < 6 * n


def shingles(text: str | None, k: int) -> set:
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(ids, links) -> dict:
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def near_duplicate_rows(docs, k: int = 4, percent: int = 80) -> list[tuple]:
    sets = [(i, shingles(t, k)) for i, t in docs]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                links.append((i, j))
    found = components([i for i, _ in docs], links)
    return [(i, len(s), found[i], found[i] == i) for i, s in sets]


def decontaminated_row(doc_id, text, benchmark, window: int = 13) -> tuple:
    words = BENCH_WORD.findall((text or "").translate(UPPER))
    hit, items = set(), set()
    for item, body in benchmark:
        own = BENCH_WORD.findall((body or "").translate(UPPER))
        m = min(window, len(own))
        strings = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else ()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in strings:
                hit |= set(range(i, i + m))
                items.add(str(item))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return doc_id, len(words), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(words)


@cache
def tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(text: str | None, name: str, end_id: int) -> list[int]:
    return [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end_id]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def token_file_rows(docs) -> list[tuple]:
    out, at = [], 0
    for i, text in sorted(docs):
        ids = ids_of(text, "word_bpe_49k.json", 2)
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


@cache
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def count_row(doc_id, text) -> tuple:
    n = len(pieces().encode(text or ""))
    return doc_id, len((text or "").encode()), n, n > 4096


def warc_rows(pages) -> list[tuple]:
    bodies = [(i, (html or "").encode()) for i, html in pages]
    first: dict[bytes, int] = {}
    for i, b in bodies:
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in bodies:
        to = first.get(b, i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    return out


def repeated_rows(docs, length: int = 200) -> list[tuple]:
    datas = [(i, (t or "").encode()) for i, t in docs]
    times = Counter(d[j : j + length] for _, d in datas for j in range(len(d) - length + 1))
    out = []
    for i, d in datas:
        gone = bytearray(len(d))
        for j in range(len(d) - length + 1):
            if times[d[j : j + length]] > 1:
                gone[j : j + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def near_passage_links(docs, passage: int = 50, k: int = 5, percent: int = 80) -> set[tuple]:
    """Pairs of documents that have windows of ``passage`` words with enough shingles in common; every window is tried."""
    width, out = passage - k + 1, set()
    sequences = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(UPPER))
        s = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        sequences.append((i, [set(s[j : j + width]) for j in range(len(s) - width + 1)]))
    for x, (i, a) in enumerate(sequences):
        for j, b in sequences[x + 1 :]:
            if any(100 * (both := len(p & q)) >= percent * (len(p) + len(q) - both) > 0 for p in a for q in b):
                out.add((i, j))
    return out
