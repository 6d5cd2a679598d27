"""Streams of several batches: state that is kept, late rows that are dropped, and a table kept by changes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kickframe.operators import control, tracking
from kickframe.session import ROCKSDB
from kickframe.streaming import live


@pytest.fixture
def feed(spark, tmp_path):
    """A function that writes each list of rows as a file and reads the files as a stream, one a batch, in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def make(schema, *batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            import time

            time.sleep(1.1 if i + 1 < len(batches) else 0)  # the source orders files by time
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def drained(df, tmp_path, mode="append"):
    run = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_state_is_kept_over_batches(spark, feed, tmp_path):
    rows = [("a" if i % 3 else "b", i, float(i * i % 50)) for i in range(30)]
    stream = feed("k string, t int, x double", rows[:11], rows[11:20], rows[20:])
    got = drained(control.kalman(stream, ["k"], ["t"], ["x"]), tmp_path)
    want = control.kalman(spark.createDataFrame(rows, "k string, t int, x double"), ["k"], ["t"], ["x"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_tracks_go_on_over_batches(spark, feed, tmp_path):
    schema = "clip string, t int, det int, x1 double, y1 double, x2 double, y2 double, v string"
    rows = [("c", t, d, 100.0 * d + t, 0.0, 100.0 * d + t + 40, 40.0, "team0") for t in range(6) for d in range(3)]
    stream = feed(schema, rows[:7], rows[7:])
    got = drained(tracking.track(stream, ["clip"], "t", ["det"], vote="v", min_votes=2), tmp_path).select("t", "det", "track_id", "label").collect()
    assert len(got) == 18 and all(r.track_id == r.det + 1 for r in got)
    assert all((r.label == "team0") == (r.t > 0) for r in got)


def test_late_rows_are_dropped(feed, tmp_path):
    day = datetime(2024, 1, 1)
    at = lambda minutes: day + timedelta(minutes=minutes)
    stream = feed("ts timestamp, key string, x double", [(at(0), "a", 1.0), (at(5), "a", 1.0), (at(200), "a", 1.0)], [(at(210), "a", 1.0)], [(at(6), "a", 100.0), (at(195), "a", 1.0), (at(400), "a", 1.0)], [(at(600), "a", 1.0)])
    counts = live.window_counts(stream, "ts", "30 minutes", "60 minutes", "key", "x").select(F.date_format("window.start", "HH:mm").alias("start"), "n", "total")
    got = {r.start: (r.n, r.total) for r in drained(counts, tmp_path).collect()}
    # the watermark that a batch moves drops rows from the batch after the next on: the row of minute 6 came after the watermark had passed its window; that of minute 195 did not
    assert got["00:00"] == (2, 2.0) and got["03:00"] == (3, 3.0)


def test_a_table_is_kept_by_changes(spark, feed, tmp_path):
    stream = feed("id int, name string, kind string, version int", [(1, "a", "INSERT", 1), (2, "b", "INSERT", 1), (3, "c", "INSERT", 1)], [(2, "b", "DELETE", 2), (4, "d", "INSERT", 2), (1, "other", "INSERT", 2)], [(5, "e", "INSERT", 3)])
    run = live.keep_table(stream, str(tmp_path / "table"), "id", "kind", "version", str(tmp_path / "state"))
    run.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table" / "1")).collect())) == [(1, "a"), (3, "c"), (4, "d")]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table" / "2")).collect())) == [(1, "a"), (3, "c"), (4, "d"), (5, "e")]
    assert not (tmp_path / "table" / "0").exists()


def test_a_fold_is_the_same_on_a_stream_and_a_table(spark, feed, tmp_path):
    """Nulls stay nulls, NaN stays NaN, and integers beside nulls stay integers."""
    from kickframe.operators.folds import ordered_fold

    def make():
        def step(state, row):
            state.append(repr((row["x"], row["n"])))
            return (" ".join(state),)

        return step

    rows = [("a", 1, 1.5, 3), ("a", 2, float("nan"), None), ("a", 3, None, 2**60 + 1), ("b", 1, None, None), ("a", 4, 2.0, 4)]
    schema = "k string, t int, x double, n bigint"
    fold = lambda df: ordered_fold(df, ["k"], ["t"], list, make(), "seen string").select("k", "t", "seen")
    want = sorted(map(tuple, fold(spark.createDataFrame(rows, schema)).collect()))
    assert want[3][2].endswith(f"(nan, None) (None, {2**60 + 1}) (2.0, 4)")
    assert sorted(map(tuple, drained(fold(feed(schema, rows[:2], rows[2:])), tmp_path).collect())) == want
