"""Structured Streaming forms of the ordered operators: windows, sessions, deduplication and state by key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from kickframe.operators import control


def window_counts(rows: DataFrame, time: str, late: str, length: str, key: str, value: str) -> DataFrame:
    """n and total per tumbling window and key; rows later than ``late`` behind the newest are dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(rows: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    """n per session of a key, which ends after ``gap`` without a row."""
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def dedupe(rows: DataFrame, time: str, late: str, ids: list[str]) -> DataFrame:
    """Rows whose id has not come before within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


class _Fold(StatefulProcessor):
    """One pickled state per key; a batch's rows are taken in order."""

    def __init__(self, order: list[str], init: Callable[[], Any], step: Callable[..., tuple], names: list[str], new: list[str]) -> None:
        self.order, self.start, self.step, self.names, self.row = order, init, step, names, Row(*names, *new)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "data binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        state = pickle.loads(held[0]) if held else self.start()
        # nulls first, as Spark sorts them
        batch = sorted(rows, key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False, 0) for c in self.order])
        made = []
        for row in batch:
            values = {c: row[c] for c in self.names}
            made.append(self.row(*values.values(), *self.step(state, values)))
        self.state.update((pickle.dumps(state),))
        yield from made

    def close(self) -> None:
        pass


def fold(rows: DataFrame, keys: list[str], order: list[str], init: Callable[[], Any], step: Callable[..., tuple], out_ddl: str) -> DataFrame:
    """The streaming form of an ordered fold: ``rows`` with the columns of ``out_ddl``, the state kept per key over batches.

    Rows of a batch are taken in order; one that comes in a later batch than its successors is taken when it
    comes. A key's rows of one batch are held at once, which the source's limit per batch bounds. Needs the
    RocksDB state store.
    """
    new = StructType.fromDDL(out_ddl)
    schema = StructType(rows.schema.fields + new.fields)
    processor = _Fold(order, init, step, rows.columns, new.names)
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", "none")


def smooth(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.12) -> DataFrame:
    """(key, order, smooth): an exponential average kept per key over batches."""
    return control.ema(rows.select(key, order, value), [key], [order], value, alpha).select(key, order, "smooth")


def remove_version(spark: SparkSession, path: str, number: int) -> None:
    """Delete a version of a table that batches write, if it is there."""
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{number}")
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if number >= 0 and store.exists(old):
        store.delete(old, True)


def keep_table(feed: DataFrame, path: str, key: str, kind: str, version: str, checkpoint: str) -> Any:
    """Start a query that keeps a table below ``path`` by a stream of INSERT and DELETE changes; each batch writes its next version.

    A batch that is run again after a failure reads the version before it and writes the same one once more; versions
    before the last two are removed.
    """
    columns = [c for c in feed.columns if c not in (kind, version)]

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = batch.select(columns).schema
        old = spark.read.schema(schema).parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], schema)
        changes(old, batch, key, kind, version).write.mode("overwrite").parquet(f"{path}/{number}")
        remove_version(spark, path, number - 2)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(old: DataFrame, batch: DataFrame, key: str, kind: str, version: str) -> DataFrame:
    """A table after a batch of INSERT and DELETE changes: the last change of each key counts, inserts of known keys are ignored.

    Meant for foreachBatch: the stream's sink rewrites the table with the result.
    """
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
    gone = last.where(F.col(kind) == "DELETE").select(key)
    fresh = last.where(F.col(kind) == "INSERT").select(old.columns).join(old.select(key), key, "left_anti")
    return old.join(gone, key, "left_anti").unionByName(fresh)
