"""Timers over several batches, by event time and by the clock, and from another working folder."""

import os
import subprocess
import sys
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from kickframe.session import ROCKSDB
from kickframe.streaming import timers

DAY = datetime(2024, 1, 1)


def at(s):
    return DAY + timedelta(seconds=s)


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def make(schema, *batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.1 if i + 1 < len(batches) else 0)  # the source orders files by time
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def drained(df, tmp_path):
    run = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted(map(tuple, df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()))


PAUSES = [
    # armed and left alone; cut short; fired before the next row of the same batch; ended by a row at the very end; armed anew
    [("a", at(0), 5.0), ("b", at(0), 5.0), ("b", at(3), 0.0), ("c", at(0), 2.0), ("c", at(10), None), ("d", at(0), 4.0), ("d", at(4), 0.0), ("e", at(1), 9.0), ("f", None, 3.0)],
    [("e", at(6), 20.0), ("g", at(20), 1.5), ("a", at(30), -1.0)],
    [("h", at(100), 0.0)],
]
FIRED = [("a", at(0), at(5)), ("c", at(0), at(2)), ("d", at(0), at(4)), ("e", at(6), at(26)), ("g", at(20), at(21.5))]


def test_pauses_end_once_whatever_the_batches(spark, feed, tmp_path):
    schema = "k string, t timestamp, delay double"
    stream = feed(schema, *PAUSES)
    assert drained(timers.resume_after(stream, ["k"], "t", "delay"), tmp_path) == FIRED
    table = spark.createDataFrame([r for b in PAUSES for r in b], schema)
    assert sorted(map(tuple, timers.resume_after(table, ["k"], "t", "delay").collect())) == FIRED


def test_pauses_by_the_clock(spark, feed, tmp_path):
    """Of three viewers one goes on by hand in a later batch, before the delay is over."""
    stream = feed("k string, t timestamp, delay double", [("a", at(0), 2.0), ("b", at(0), 3600.0), ("c", at(0), None)])
    out = timers.resume_after(stream, ["k"], "t", "delay", late=None)
    run = out.writeStream.format("memory").queryName("clocked").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):  # each trigger is a batch, so the query never has nothing to do
            if any(p["numInputRows"] for p in run.recentProgress):
                break
            time.sleep(0.5)
        spark.createDataFrame([("b", at(1), 0.0)], "k string, t timestamp, delay double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(60):
            time.sleep(0.5)
            rows = spark.table("clocked").collect()
            if rows:
                break
        time.sleep(3)
        rows = spark.table("clocked").collect()
    finally:
        run.stop()
    assert [r["k"] for r in rows] == ["a"] and (rows[0]["due"] - rows[0]["since"]).total_seconds() == 2


def test_recordings_are_saved_by_hand_or_by_themselves(feed, tmp_path):
    stream = feed(
        "k string, t timestamp, event string, value double",
        [("auto", at(0), "start", 100.0), ("auto", at(5), "adjust", 4.0), ("hand", at(0), "start", 50.0), ("hand", at(7), "save", None), ("none", at(0), "start", 1.0), ("lone", at(3), "save", None)],
        [("none", at(9), "cancel", None), ("short", at(10), "start", 8.0), ("short", at(10.5), "adjust", -20.0), ("short", at(12), "save", None), ("again", at(10), "start", 1.0), ("again", at(20), "start", 2.0), ("auto", at(31), "save", None)],
        [("end", at(500), "cancel", None)],
    )
    assert drained(timers.recordings(stream, ["k"], "t"), tmp_path) == [("again", 2.0, 32.0, "auto"), ("auto", 100.0, 134.0, "auto"), ("hand", 50.0, 57.0, "manual"), ("short", 8.0, 9.0, "manual")]


def test_stateful_streams_run_from_any_folder(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})\nimport __spark_entry__ as e\nfrom kickframe.session import local_session\nprint('ROWS', e.queries()['stream_pauses'](local_session(2, 2), '/root/testdata/sf0.001').count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in done.stdout and not done.stdout.startswith("ROWS 0"), done.stderr[-2000:]
