"""Ordered folds: operators whose next row depends on a state that built-in windows cannot carry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class _Lists(dict):
    """The columns of a batch as lists, each made when a step first reads it."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch

    def __missing__(self, name: str) -> list:
        column = self.batch.column(self.batch.schema.get_field_index(name))
        plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_float64(column.type))
        # the same numbers, without an object of Arrow for each
        self[name] = made = column.to_numpy().tolist() if plain else column.to_pylist()
        return made


class _Row:
    """One row of a batch, by column name."""

    __slots__ = ("at", "lists")

    def __init__(self, lists: _Lists) -> None:
        self.lists = lists

    def __getitem__(self, name: str) -> Any:
        return self.lists[name][self.at]


def _runs(lists: _Lists, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of the places of a batch with one key."""
    start, last = 0, None
    for at, own in enumerate(zip(*(lists[k] for k in keys), strict=True)):
        if at and own != last:
            yield last, start, at
            start = at
        last = own
    yield last, start, at + 1


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], init: Callable[[], Any], step: Callable[..., tuple], out_ddl: str, steps: Callable[..., list[tuple]] | None = None) -> DataFrame:
    """``df`` with the columns of ``out_ddl``, made row by row in ``order`` within ``keys``.

    ``step(state, row)`` gets the mutable state that ``init`` made for the key and the row, whose columns it
    reads by name, and returns the new columns' values; a row is valid for that step only. Rows are hashed by key, sorted in their partition by Spark (spilling
    as needed) and streamed: only one state is held, however many rows a key has. Of a stream the states are
    kept from batch to batch.

    ``steps(state, lists, start, end)``, if given, takes the rows of a key that a batch holds at once: it gets the columns'
    lists and the range of places in them, and returns what ``step`` would for each place. Where a batch ends must not
    matter; a stream goes by ``step``.
    """
    if df.isStreaming:
        from kickframe.streaming.live import fold

        return fold(df, keys, order, init, step, out_ddl)
    new = StructType.fromDDL(out_ddl)
    schema = StructType(df.schema.fields + new.fields)
    arrow = to_arrow_schema(schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, started = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = _Lists(batch)
            row, made = _Row(lists), []
            if steps is not None:
                for own, start, end in _runs(lists, keys):
                    if not started or own != key:
                        key, state, started = own, init(), True
                    made += steps(state, lists, start, end)
            else:
                for row.at, own in enumerate(zip(*(lists[k] for k in keys), strict=True)):
                    if not started or own != key:
                        key, state, started = own, init(), True
                    made.append(step(state, row))
            added = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(arrow)[len(names) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, arrow, strict=False)], *added], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
