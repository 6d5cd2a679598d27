"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a piece of text form a doubly linked list; a heap holds the adjacent pairs that the
vocabulary can merge, by rank and then by place. The best pair is popped and merged until none is left:
the count is the initial symbols minus the merges, and no identifiers are made.

Vocabulary entries never have the space mark after another character, and characters that belong to no
longer entry (line ends, mostly) never merge, so a text falls into chunks that are counted one by one;
equal chunks are counted once per worker as long as they are remembered.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import map_batches, text_of

MARK = "▁"
#: Chunks that a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 200_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class HeapCounter:
    """Counts what a byte-pair model with byte fallback makes of a text; ``ranks`` is lowest first."""

    def __init__(self, ranks: dict[str, float]) -> None:
        self.ranks = ranks
        longer = {c for piece in ranks if len(piece) > 1 for c in piece}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in ranks):
            raise ValueError("the vocabulary merges across the space mark")
        self.cuts_lines = "\n" not in longer
        self.line_end = self._single("\n")
        self.plain: dict[str, int] = {}
        self.marked: dict[str, int] = {}

    def _single(self, c: str) -> int:
        return 1 if c in self.ranks else len(c.encode("utf-8", "surrogatepass"))

    def merges(self, symbols: list[str]) -> int:
        """Merges made in a list of symbols."""
        ranks, n = self.ranks, len(symbols)
        symbols, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapify(heap)
        made = 0
        while heap:
            _, i, j, length = heappop(heap)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != length:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            made += 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    rank = ranks.get(symbols[a] + symbols[b])
                    if rank is not None:
                        heappush(heap, (rank, a, b, len(symbols[a]) + len(symbols[b])))
        return made

    def chunk(self, chunk: str) -> int:
        return sum(map(self._single, chunk)) - self.merges(list(chunk))

    def _remembered(self, memory: dict[str, int], key: str, chunk: str) -> int:
        n = memory.get(key)
        if n is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            n = memory[key] = self.chunk(chunk)
        return n

    def _line(self, line: str, first: bool) -> int:
        if "  " in line or MARK in line or (not first and line.startswith(" ")) or line.endswith(" ") or (first and line.startswith(" ")):
            marked = (MARK if first else "") + line.replace(" ", MARK)
            return sum(self._remembered(self.plain, c, c) for c in _CHUNK.findall(marked))
        words = line.split(" ")
        total = 0
        if not first:
            total = self._remembered(self.plain, words[0], words[0]) if words[0] else 0
            words = words[1:]
        marked = self.marked
        for w in words:
            n = marked.get(w)
            total += self._remembered(marked, w, MARK + w) if n is None else n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts_lines:
            return self._line(text, True)
        lines = text.split("\n")
        return self.line_end * (len(lines) - 1) + sum(self._line(x, i == 0) for i, x in enumerate(lines))


@lru_cache(maxsize=4)
def counter(model_file: str) -> HeapCounter:
    """The counter of a sentencepiece model of byte-pair kind; only its vocabulary is read."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i)
    return HeapCounter({model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not special(i)})


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each whole text, one row per input row; other columns are ignored.

    ``model_file`` must exist on every executor. Null and empty texts have no bytes and no tokens;
    repeated rows give repeated counts; an empty table gives no rows.
    """

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(model_file).count
        tokens = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=[id_col, "n_bytes", "n_tokens"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(rows, counted, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint")
