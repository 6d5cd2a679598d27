"""Streams over the events, run until what is there is read; the sink is a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.operators import control, inserts
from kickframe.plans import state_queries  # noqa: F401 (registers the SQL of kalman_2d)
from kickframe.plans.registry import ORACLE_SQL, query, table
from kickframe.session import ROCKSDB
from kickframe.streaming import live, timers, work_queue


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if shared is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='kickframe-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drained(out: DataFrame, mode: str) -> DataFrame:
    """What the stream has put out after reading all there is."""
    spark, folder = out.sparkSession, _folder(out.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = f"{folder}/rows"
    if mode == "append":
        sink = out.writeStream.format("parquet").option("path", path)
    else:
        sink = out.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    run = sink.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    counts = live.window_counts(_stream(spark, sf_dir), "ts", "1 hour", "6 hours", "event_type", "value")
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
    return _drained(flat, "complete")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    found = live.sessions(_stream(spark, sf_dir), "ts", "1 hour", "2 hours", "user_id")
    return _drained(found.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "complete")


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    twice = _stream(spark, sf_dir)
    twice = twice.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _drained(live.dedupe(twice, "ts", "400 days", ["event_id"]).select("event_id", "user_id"), "append")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT user_id, rn, event_id, value AS s FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, r.event_id, s + 0.12 * (r.value - s) FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT user_id, event_id, round(s, 6) AS smooth FROM f""")
def stream_ema(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "value")
    return _drained(live.smooth(rows, "user_id", "event_id", "value"), "append").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query(ORACLE_SQL["kalman_2d"])
def stream_kalman(spark, sf_dir):
    """The filter of kalman_2d over a stream; what a key's first row shows is always measured."""
    seen = F.col("event_type") != "error"
    e = _stream(spark, sf_dir).select("event_id", "user_id", "value", (F.col("event_id") % 97).cast("double").alias("y"), seen.alias("seen"))
    found = control.kalman(e, ["user_id"], ["event_id"], ["value", "y"], seen="seen", first_seen=True)
    return _drained(found, "append").select("event_id", *[F.round(n, 6).alias(n) for n in ("est_0", "vel_0", "est_1", "vel_1")], "missed")


@query("SELECT event_id, user_id FROM events WHERE event_id % 5 <> 0")
def stream_changes(spark, sf_dir):
    """A table kept by a stream of inserts and deletes: every row is inserted, every fifth deleted again."""
    kinds = F.array(F.struct(F.lit("INSERT").alias("kind"), F.lit(1).alias("version")), F.struct(F.lit("DELETE").alias("kind"), F.lit(2).alias("version")))
    feed = _stream(spark, sf_dir).select("event_id", "user_id", F.explode(kinds).alias("c")).where("c.version = 1 or event_id % 5 = 0").select("event_id", "user_id", "c.kind", "c.version")
    folder = _folder(spark)
    run = live.keep_table(feed, f"{folder}/table", "event_id", "kind", "version", f"{folder}/state")
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    return spark.read.parquet(f"{folder}/table/{last}")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_id % 4 * 600 AS delay FROM events), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(delay AS VARCHAR)) AS next FROM e)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since, strftime(ts + to_seconds(delay), '%Y-%m-%d %H:%M:%S') AS due FROM n
WHERE delay > 0 AND CASE WHEN next IS NULL THEN ts + to_seconds(delay) <= (SELECT max(ts) FROM events) ELSE next >= ts + to_seconds(delay) END""")
def stream_pauses(spark, sf_dir):
    """Pauses of up to half an hour that end by themselves; those that would end after the newest row have not yet."""
    rows = _stream(spark, sf_dir).select("user_id", "ts", (F.col("event_id") % 4 * 600).alias("delay"))
    found = _drained(timers.resume_after(rows, ["user_id"], "ts", "delay", late="0 seconds"), "append")
    return found.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("since", "due")])


def _extract(item):
    if item["event_id"] % 7 == 0:
        raise OSError("no frame")
    return {"frame": f"{item['event_id']}.jpg"}


def _calibrate(item):
    if item["event_id"] % 5 == 0 and item["tries"] < 1:
        raise OSError("try again")
    return {"confidence": item["event_id"] % 100 / 100}


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id || '.jpg' END AS frame, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 100 / 100.0::DOUBLE END AS confidence,
CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'review' END AS status, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS tries, CASE WHEN event_id % 7 = 0 THEN 'OSError: no frame' END AS error FROM events""")
def stream_queue(spark, sf_dir):
    """Every event is an item of a queue of two stages; one in seven cannot be worked on, one in five only at the second try."""
    none = lambda kind: F.lit(None).cast(kind)
    feed = _stream(spark, sf_dir).select("event_id", none("string").alias("frame"), none("double").alias("confidence"))
    folder = _folder(spark)
    run = work_queue.run_queue(feed, f"{folder}/queue", f"{folder}/state", "event_id", [("extracting", _extract), ("calibrating", _calibrate)], tries=2, rounds=4)
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/queue/{run.lastProgress['batchId']}").select("event_id", "frame", "confidence", "status", "tries", "error")


@query("SELECT c_mktsegment, count(*) AS n, sum(c_custkey) AS keys, (SELECT count(*) FROM customer) AS given, (SELECT count(*) - 1 FROM customer) AS last FROM customer GROUP BY c_mktsegment")
def insert_returning(spark, sf_dir):
    """Customers appended in two inserts; keys are as many as rows, from 0 on without a gap."""
    path, rows = f"{_folder(spark)}/table", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    written = [inserts.insert_returning(rows.where(f"c_custkey % 3 {sign} 0"), path) for sign in ("=", "<>")]
    both = written[0].unionByName(written[1])
    keys = both.agg(F.countDistinct("id").alias("given"), F.max("id").alias("last"))
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).crossJoin(F.broadcast(keys))  # one row
