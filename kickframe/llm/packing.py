"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two: as many of the greatest length
as fit, then the binary digits of the rest. A piece is a training sequence of its own, so no sequence
crosses documents and none needs padding; sequences of equal length share a bucket, and their ids are
numbered bucket by bucket. Rows are cut where they lie; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, text_of
from kickframe.llm.encoder import encoder

LONGEST = 1024


def cuts(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; lengths are powers of two up to ``longest``, longest first."""
    whole, rest = divmod(n, longest)
    out, at = [(i * longest, longest) for i in range(whole)], whole * longest
    bit = longest >> 1
    while rest:
        if rest & bit:
            out.append((at, bit))
            at += bit
            rest ^= bit
        bit >>= 1
    return out


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset); other columns are ignored.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers, ``start`` the document's ids
    before it, ``doc_tokens`` all its ids with ``end_id``. ``sequence_id`` has the bucket (the length's
    power) in its highest bits, then the task and the piece's number there, so each piece, also of
    repeated rows, has its own. A null or empty text is the end id alone; an empty table gives no rows.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the greatest length must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).ids
        task = TaskContext.get().partitionId() << 32
        made = 0
        for batch in batches:
            which, starts, lengths, ids, totals, sequences = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for start, length in cuts(len(tokens), longest):
                    which.append(row)
                    starts.append(start)
                    lengths.append(length)
                    ids.append(tokens[start : start + length].tobytes())
                    totals.append(len(tokens))
                    sequences.append((length.bit_length() - 1 << 58) | task | made)
                    made += 1
            columns = [batch.column(0).take(pa.array(which, pa.int64())), starts, lengths, ids, totals, sequences, [0] * len(which)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(cut, ddl)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces with one folder per length."""
    pieces.write.partitionBy("length").parquet(path)
