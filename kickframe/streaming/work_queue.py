"""A staged work queue over a stream: items go through named stages, failures are tried again, and a batch run twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kickframe.streaming.live import remove_version

QUEUED, DEAD = "queued", "error"
_FIELDS = "status string, tries int, error string, since bigint"


def _worked(items: DataFrame, stages: list[tuple[str, Callable[[dict], dict]]], final: str, tries: int, number: int) -> DataFrame:
    """``items`` after one step each: the next stage's changes and status, or one more failure."""
    names, schema = items.columns, items.schema
    after = {QUEUED: 0} | {name: k + 1 for k, (name, _) in enumerate(stages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in zip(*[batch[n].tolist() for n in names], strict=True):
                item = {n: None if not isinstance(v, (list, dict)) and pd.isna(v) else v for n, v in zip(names, values, strict=True)}
                step = after[item["status"]]
                try:
                    change = stages[step][1](dict(item)) or {}
                    item |= {k: v for k, v in change.items() if k in item}
                    item |= {"status": stages[step][0] if step + 1 < len(stages) else final, "tries": 0, "error": None, "since": number}
                except Exception as failed:  # noqa: BLE001 whatever a stage raises is the item's failure
                    item |= {"tries": item["tries"] + 1, "error": f"{type(failed).__name__}: {failed}"}
                    if item["tries"] >= tries:
                        item |= {"status": DEAD, "since": number}
                out.append([item[n] for n in names])
            yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})

    return items.mapInPandas(run, schema)


def step(queue: DataFrame, fresh: DataFrame, key: str, stages: list[tuple[str, Callable[[dict], dict]]], final: str = "review", tries: int = 3, number: int = 0) -> DataFrame:
    """The queue after one batch: new items come in as queued, and each item that is neither ``final`` nor dead is worked on once.

    A stage gets the item as a dict and returns the columns it changes; what it raises is noted, and after ``tries``
    failures in a row the item is dead. Items whose key is known, and further ones of one key in a batch, are ignored
    (the first by its columns stays); one without key is not taken in.
    """
    payload = [c for c in fresh.columns if c != key]
    one = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*payload)).alias("p")).select(key, "p.*") if payload else fresh.where(F.col(key).isNotNull()).distinct()
    new = one.join(queue.select(key), key, "left_anti").select("*", F.lit(QUEUED).alias("status"), F.lit(0).alias("tries"), F.lit(None).cast("string").alias("error"), F.lit(number).cast("bigint").alias("since"))
    whole = queue.unionByName(new.select(queue.columns))
    idle = F.col("status").isin(final, DEAD)
    return whole.where(idle).unionByName(_worked(whole.where(~idle), stages, final, tries, number))


def run_queue(feed: DataFrame, path: str, checkpoint: str, key: str, stages: list[tuple[str, Callable[[dict], dict]]], final: str = "review", tries: int = 3, rounds: int = 1) -> StreamingQuery:
    """Start a query that keeps the queue below ``path`` by a stream of new items; each batch takes ``rounds`` steps.

    Batch n reads version n - 1 and writes version n, so one that is run again after a failure does the same once more
    (a stage may then see an item twice); versions before the last two are removed.
    """
    schema = StructType([*feed.schema.fields, *StructType.fromDDL(_FIELDS).fields])

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = spark.read.schema(schema).parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], schema)
        for k in range(rounds):
            now = step(now, batch if k == 0 else batch.limit(0), key, stages, final, tries, number)
        now.write.mode("overwrite").parquet(f"{path}/{number}")
        remove_version(spark, path, number - 2)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
