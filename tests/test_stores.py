"""Frames by seek offsets, inserts that return their rows, and the staged queue."""

import threading

import pytest

from kickframe.operators import inserts
from kickframe.sources import frames
from kickframe.streaming import work_queue


@pytest.fixture
def footage(tmp_path):
    folder = tmp_path / "footage"
    folder.mkdir()
    for name, n, more in (("a.raw", 25, 5), ("b.raw", 3, 0), ("empty.raw", 0, 0), ("short.raw", 0, 7), (".hidden", 2, 0)):
        (folder / name).write_bytes(b"".join(bytes([i]) * 12 for i in range(n)) + b"x" * more)
    return folder


def found(df):
    rows = sorted((r["source"].rsplit("/", 1)[1], r["frame_idx"], bytes(r["pixels"])) for r in df.collect())
    assert all(p == bytes([i]) * 12 for _, i, p in rows)
    return [(s, i) for s, i, _ in rows]


def test_frames_from_a_time_on(spark, footage):
    read = lambda path, **kw: frames.read_frames(spark, str(path), 2, 2, fps=10, **kw)
    assert found(read(footage)) == [("a.raw", i) for i in range(25)] + [("b.raw", i) for i in range(3)]
    assert found(read(footage, start=0.2, duration=0.5)) == [("a.raw", i) for i in range(2, 7)] + [("b.raw", 2)]
    assert found(read(footage / "a.raw", start=2.0, duration=0.3, tail=2)) == [("a.raw", i) for i in range(20, 25)]
    assert found(read(footage / "a.raw", start=-5, duration=0.2)) == [("a.raw", 0), ("a.raw", 1)]
    assert found(read(footage / "a.raw", start=99)) == found(read(footage / "empty.raw")) == found(read(footage / "short.raw")) == []
    assert found(read(f"file://{footage}/b.raw")) == [("b.raw", i) for i in range(3)]


def test_frames_are_dealt_by_offset(spark, footage):
    spark.dataSource.register(frames.RawFrames)
    df = spark.read.format("raw_frames").option("width", 2).option("height", 2).option("fps", 10).option("taskBytes", 60).load(str(footage / "a.raw"))
    assert df.rdd.getNumPartitions() == 5 and found(df) == [("a.raw", i) for i in range(25)]


def test_a_file_that_ends_early_ends_its_frames(footage):
    reader = frames._FrameReader({"path": str(footage / "a.raw"), "width": "2", "height": "2"})
    part = reader.partitions()[0]
    (footage / "a.raw").write_bytes(b"".join(bytes([i]) * 12 for i in range(4)) + b"xx")
    assert [r[1] for r in reader.read(part)] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="above 0"):
        frames._FrameReader({"path": "x", "width": "0", "height": "2"})


def test_inserts_return_what_they_wrote(spark, tmp_path):
    path = str(tmp_path / "notes")
    first = inserts.insert_returning(spark.createDataFrame([("a",), ("b",), (None,)], "note string").repartition(3), path)
    assert first.columns == ["id", "note"] and sorted(r["id"] for r in first.collect()) == [0, 1, 2]
    assert inserts.insert_returning(spark.createDataFrame([], "note string"), path).collect() == []
    second = inserts.insert_returning(spark.createDataFrame([("c",)], "note string"), path)
    assert [tuple(r) for r in second.collect()] == [(3, "c")]
    every = inserts.read_appends(spark, path, "id bigint, note string").collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, [*first.collect(), *second.collect()]))
    with pytest.raises(ValueError, match="already"):
        inserts.insert_returning(first, path)


def test_writers_at_once_get_keys_of_their_own(spark, tmp_path):
    path, got, failed = str(tmp_path / "notes"), {}, []

    def write(w):
        try:
            for k in range(2):
                rows = spark.range(w * 10 + k + 5).selectExpr(f"{w} AS writer", f"{k} AS turn", "id AS n").repartition(3)
                got[w, k] = [tuple(r) for r in inserts.insert_returning(rows, path).collect()]
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not failed
    keys = sorted(r[0] for rows in got.values() for r in rows)
    assert keys == list(range(len(keys))) and len(keys) == sum(w * 10 + k + 5 for w in range(3) for k in range(2))
    assert sorted(map(tuple, inserts.read_appends(spark, path, "id bigint, writer int, turn int, n bigint").collect())) == sorted(r for rows in got.values() for r in rows)


def stages():
    def extract(item):
        if item["file"] == "broken":
            raise OSError("no frame")
        if item["file"] == "shaky" and item["tries"] < 1:
            raise OSError("try again")
        return {"frame": item["file"] + ".jpg"}

    def calibrate(item):
        if item["frame"] == "dark.jpg":
            raise ValueError("no pitch")
        return {"confidence": 0.5, "unknown": 1}

    return [("extracting", extract), ("calibrating", calibrate)]


ITEM = "id int, file string, frame string, confidence double"


def items(spark, *rows):
    return spark.createDataFrame([(i, f, None, None) for i, f in rows], ITEM)


def test_queue_moves_on_and_gives_up(spark):
    empty = spark.createDataFrame([], ITEM + ", " + work_queue._FIELDS)
    state = empty
    batches = [items(spark, (1, "good"), (2, "broken"), (None, "lost")), items(spark, (1, "other"), (3, "shaky"), (4, "dark"), (4, "dark")), *[items(spark)] * 4]
    history = []
    for number, fresh in enumerate(batches):
        state = spark.createDataFrame(work_queue.step(state, fresh, "id", stages(), tries=2, number=number).collect(), state.schema)
        history.append({r["id"]: r["status"] for r in state.collect()})
    assert history[0] == {1: "extracting", 2: "queued"}
    assert history[1] == {1: "review", 2: "error", 3: "queued", 4: "extracting"}
    assert history[2] == {1: "review", 2: "error", 3: "extracting", 4: "extracting"}
    assert history[3] == history[5] == {1: "review", 2: "error", 3: "review", 4: "error"}
    last = {r["id"]: r for r in state.collect()}
    assert last[1]["frame"] == "good.jpg" and last[1]["confidence"] == 0.5 and last[1]["since"] == 1
    assert last[2]["error"] == "OSError: no frame" and last[4]["error"] == "ValueError: no pitch" and last[3]["error"] is None


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    import shutil
    import time

    for k, rows in enumerate([[(1, "good"), (2, "broken")], [(3, "shaky")], [(5, "good")]]):
        items(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k < 2 else 0)
    feed = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path, checkpoint = str(tmp_path / "queue"), tmp_path / "state"
    work_queue.run_queue(feed, path, str(checkpoint), "id", stages(), tries=2, rounds=2).awaitTermination()
    before = sorted(map(tuple, spark.read.parquet(f"{path}/2").collect()))
    assert {r[0]: r[4] for r in before} == {1: "review", 2: "error", 3: "review", 5: "review"}
    assert not (tmp_path / "queue" / "0").exists() and (tmp_path / "queue" / "1").exists()
    # as after a failure between the write of the batch and its commit
    for f in (checkpoint / "commits").glob("*2*"):
        f.unlink()
    shutil.rmtree(tmp_path / "queue" / "2")
    work_queue.run_queue(feed, path, str(checkpoint), "id", stages(), tries=2, rounds=2).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{path}/2").collect())) == before
