"""Token ids by the tokenizers library, with equal words encoded once.

The library works on a text word by word after its own pre-tokenization. For texts of plain characters
the words can be found with one regular expression, and the library's ids of a word are remembered, so
that it sees each word once. Any other text (rarer characters, strings of special tokens, an unknown
pre-tokenizer) goes to the library as a whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers; bounds memory, not results.
WORDS = 300_000
#: Stretches without white space that a worker remembers.
STRETCHES = 600_000
#: Length of a word that is remembered, at most.
LONGEST = 200
#: Characters of texts that are looked up together.
TOGETHER = 4_000_000
#: Characters on which the standard library and the tokenizer agree in class, case and normal form.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ſ‐-‧、。ぁ-ゖァ-ヺ一-龥]")
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
#: The words of the two known pre-tokenizers.
_BYTE_LEVEL = re.compile(rf"{_SUFFIX}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_END = re.compile(rf"{_SUFFIX}|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


#: Byte-level alphabet: visible bytes stand for themselves, the others for characters from 256 on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def _known(spec: dict) -> tuple[re.Pattern | None, bool]:
    """(pattern of words, whether in lower case) of a tokenizer's file; None if it is not known."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and norm is None:
        return _BYTE_LEVEL, False
    if pre.get("type") == "Sequence" and norm and norm.get("type") == "Sequence":
        first, steps = pre["pretokenizers"][0], [x["type"] for x in norm["normalizers"]]
        pattern = rf"{_SUFFIX}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == pattern:
            return _WORD_END, True
    return None, False


def _forget(memory: dict, most: int) -> None:
    """Drop the later half of a full memory: what came early is what comes often."""
    if len(memory) > most:
        for key in list(memory)[most // 2 :]:
            del memory[key]


def _alphabet(word: str) -> str:
    """A word in the byte-level alphabet of the library's model."""
    if word.isascii() and not word.isspace():
        return f"Ġ{word[1:]}" if word[0] == " " else word
    return word.encode("utf-8").decode("latin-1").translate(_ALPHABET)


class _Ids:
    """Runs of ids, one after another."""

    def __init__(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        self.lengths, self.flat, self.starts = lengths, flat, np.cumsum(lengths) - lengths

    def and_also(self, more: _Ids) -> _Ids:
        return _Ids(np.append(self.lengths, more.lengths), np.append(self.flat, more.flat))

    def first(self, n: int) -> _Ids:
        return _Ids(self.lengths[:n], self.flat[: int(self.lengths[:n].sum())])


class _Stretches:
    """Remembers the ids of stretches in flat arrays, a tenth of what a dictionary takes."""

    def __init__(self) -> None:
        self.known, self.ids = pa.array([], pa.large_string()), _Ids(np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def find(self, values: pa.Array, make: Callable[[list[str]], _Ids], pool: pa.MemoryPool) -> tuple[np.ndarray, _Ids]:
        """(which, ids): the ids of values[i] are run ``which``[i] of ``ids``."""
        found = pc.index_in(values, value_set=self.known, memory_pool=pool)
        which = pc.fill_null(found, -1).to_numpy().copy()
        if not found.null_count:
            return which, self.ids
        kinds = pc.dictionary_encode(values.filter(found.is_null()), memory_pool=pool)
        which[which < 0] = kinds.indices.to_numpy() + len(self.known)
        fresh = make(kinds.dictionary.to_pylist())
        ids = self.ids.and_also(fresh)
        if len(ids.lengths) > STRETCHES:
            # what came early is what comes often, so that stays
            half = min(len(self.known), STRETCHES // 2)
            self.known, self.ids = pa.concat_arrays([self.known[:half]], pool), self.ids.first(half)
        elif pc.max(pc.binary_length(kinds.dictionary)).as_py() <= LONGEST:
            self.known, self.ids = pa.concat_arrays([self.known, kinds.dictionary], pool), ids
        return which, ids


class Encoder:
    def __init__(self, tokenizer_file: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.library = Tokenizer.from_str(text)
        self.model = self.library.model
        self.pattern, self.lower = _known({k: spec.get(k) for k in ("pre_tokenizer", "normalizer")})
        self.special = [t["content"].lower() for t in spec.get("added_tokens") or ()]
        #: Ids of words, as little-endian 32-bit integers.
        self.words: dict[str, bytes] = {}
        self.stretches = _Stretches()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _lowered(self, text: str) -> str | None:
        """The text as words are found in it; None if it must go to the library as a whole."""
        if self.pattern is None or _OTHER.search(text) or (self.lower and not unicodedata.is_normalized("NFC", text)):
            return None
        low = text.lower()
        if any(s in low for s in self.special):
            return None
        return low if self.lower else text

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, without added special tokens."""
        plain = self._lowered(text)
        if plain is None:
            return self._whole(text)
        return np.frombuffer(self._of_words(self.pattern.findall(plain)), "<u4")

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Where white space always parts words, equal stretches of many texts are looked up once."""
        held: list[str | np.ndarray] = []
        size = 0
        for text in (t.as_py() for t in texts):
            if not self.lower:
                yield self.ids(text)
                continue
            plain = self._lowered(text)
            held.append(self._whole(text) if plain is None else plain)
            size += len(text)
            if size > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, held: list[str | np.ndarray]) -> Iterator[np.ndarray]:
        """The ids of lowered texts; what is ids already passes in its place."""
        plain = [x for x in held if isinstance(x, str)]
        pool = pa.system_memory_pool()  # it gives back what is freed
        stretches = pc.utf8_split_whitespace(pa.array(plain, pa.large_string(), memory_pool=pool), memory_pool=pool)
        which, ids = self.stretches.find(stretches.values, self._of_stretches, pool)
        times = ids.lengths[which]
        ends = np.cumsum(times)
        at = np.repeat((ids.starts[which] - ends + times).astype(np.int32), times)
        at += np.arange(len(at), dtype=np.int32)
        flat = ids.flat[at]
        cuts = iter(np.append(0, ends)[stretches.offsets.to_numpy()].tolist())
        a = next(cuts)
        for x in held:
            if isinstance(x, str):
                b = next(cuts)
                yield flat[a:b]
                a = b
            else:
                yield x

    def _of_stretches(self, stretches: list[str]) -> _Ids:
        """The ids of stretches without white space, by the library's model."""
        lengths, flat = [], array("I")
        for stretch in stretches:
            before = len(flat)
            for word in (stretch,) if stretch.isalpha() else self.pattern.findall(stretch):
                flat.extend([t.id for t in self.model.tokenize(_alphabet(word))])
            lengths.append(len(flat) - before)
        return _Ids(np.array(lengths, np.int64), np.array(flat, np.uint32))

    def _of_words(self, words: list[str]) -> bytes:
        parts = list(map(self.words.get, words))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = self._word(words[i])
        return b"".join(parts)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(_alphabet(word))]).tobytes()
            if len(word) <= LONGEST:
                if len(self.words) > WORDS:
                    _forget(self.words, WORDS)
                self.words[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)
