"""Appends that return their rows with the keys they were given, without gaps or collisions between writers."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that a writer waits for another one to say how many keys it has taken.
PATIENCE = 30.0
_ROW_BITS = 33


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _taken(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(number of the next claim, first free key) by the claims so far."""
    store, target = _files(spark, folder)
    if not store.exists(target):
        return 0, 0
    numbers = [int(f.getPath().getName()) for f in store.listStatus(target) if f.getPath().getName().isdigit()]
    if not numbers:
        return 0, 0
    last = _files(spark, f"{folder}/{max(numbers):012d}")[1]
    began = time.monotonic()
    while True:
        if store.getFileStatus(last).getLen() >= 20:
            stream = store.open(last)
            try:
                return max(numbers) + 1, int(bytes(stream.readNBytes(20)).decode())
            finally:
                stream.close()
        if time.monotonic() - began > PATIENCE:
            raise RuntimeError(f"the writer of {last} has claimed keys and not said how many")
        time.sleep(0.05)


def claim_keys(spark: SparkSession, path: str, n: int) -> int:
    """The first of ``n`` keys that no other writer of the table at ``path`` gets.

    A claim is a numbered file that only one writer can create; it holds the first key after it.
    """
    folder = f"{path.rstrip('/')}/_keys"
    while True:
        number, first = _taken(spark, folder)
        store, target = _files(spark, f"{folder}/{number:012d}")
        try:
            out = store.create(target, False)
        except Py4JJavaError as taken:
            if not store.exists(target):
                raise taken
            continue
        out.write(bytearray(f"{first + n:020d}".encode()))
        out.close()
        return first


def insert_returning(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Append ``rows`` to the table at ``path`` and return them as written, with a new ``key``.

    Keys count on from those given before, without gaps, whichever writers append at once. The rows are written
    once without keys and numbered by their place there, so a task that runs again numbers alike; then a single claim
    takes as many keys as there are rows. An append is a folder of its own, which appears whole. No rows take no keys.
    """
    if key in rows.columns:
        raise ValueError(f"the rows already have a column {key}")
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}/_staged/{time.time_ns()}-{spark.sparkContext.applicationId}"
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(staged)
    held = spark.read.schema(placed.schema).parquet(staged)
    # one row for each task that wrote
    task = F.shiftright("__at", _ROW_BITS)
    sizes = sorted((r[0], r[1]) for r in held.groupBy(task).count().collect())
    total = sum(n for _, n in sizes)
    if not total:
        return rows.limit(0).withColumn(key, F.lit(0).cast("bigint")).select(key, *rows.columns)
    first, starts = claim_keys(spark, path, total), []
    for t, n in sizes:
        starts.append((t, first))
        first += n
    offsets = F.broadcast(spark.createDataFrame(starts, "__task bigint, __first bigint"))  # as many rows as tasks
    keyed = held.join(offsets, task == F.col("__task")).select((F.col("__first") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)).alias(key), *rows.columns)
    target = f"{path.rstrip('/')}/append={starts[0][1]:020d}"
    keyed.write.parquet(target)
    store, where = _files(spark, staged)
    store.delete(where, True)
    return spark.read.schema(keyed.schema).parquet(target)


def read_appends(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows appended to the table at ``path``."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path.rstrip('/')}/append=*").drop("append")
