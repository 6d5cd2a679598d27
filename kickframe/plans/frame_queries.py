"""Detections and shapes over the line items, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions import shapes
from kickframe.operators import frames, series
from kickframe.plans.analytic_queries import _B, _boxes
from kickframe.plans.registry import query, table

_FAR = "sqrt(pow((x1 + x2) / 2 - px, 2) + pow((y1 + y2) / 2 - py, 2)) > 150"


@query(f"""SELECT frame, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS n FROM (
SELECT *, CASE WHEN px IS NOT NULL AND {_FAR} THEN conf * 0.3 ELSE conf END AS score FROM (SELECT *, CASE WHEN frame % 4 > 0 THEN frame % 300 END AS px, CASE WHEN frame % 4 > 0 THEN frame % 200 END AS py FROM {_B} b
WHERE id % 3 > 0 AND conf >= 0.92 AND (x2 - x1) * (y2 - y1) <= 18432) c) d) e WHERE n = 1""")
def best_ball(spark, sf_dir):
    k = F.col("frame")
    b = _boxes(spark, sf_dir).withColumns({"kind": F.when(F.col("id") % 3 > 0, "ball").otherwise("person"), "px": F.when(k % 4 > 0, (k % 300).cast("double")), "py": F.when(k % 4 > 0, (k % 200).cast("double"))})
    return frames.best_ball(b, "frame", "kind", "conf", ("px", "py"), least=0.92).select("frame", "id", F.round("score", 6).alias("score"))


_AT = "l_partkey % 150 / 100.0 - 0.25 AS x, l_suppkey * 7 % 130 / 100.0 - 0.15 AS y"


@query(f"SELECT l_orderkey, round(least(greatest(x, 0.0), 1.0), 6) AS x, round(least(greatest(y, 0.0), 1.0), 6) AS y FROM (SELECT l_orderkey, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT l_orderkey, {_AT} FROM lineitem) a) b WHERE x BETWEEN -0.1 AND 1.1 AND y BETWEEN -0.1 AND 1.1")
def on_pitch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = li.select("l_orderkey", (F.col("l_partkey") % 150 / 100.0 - 0.25).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 130 / 100.0 - 0.15).cast("double").alias("y"))
    return frames.on_pitch(at, "x", "y", 0.1).select("l_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT CASE WHEN o_totalprice < 1000 THEN 'no_players' WHEN o_orderstatus = 'P' THEN 'no_image' WHEN o_custkey % 5 = 0 THEN 'no_file' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def skip_counters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return frames.skip_counts(o, {"no_players": F.col("o_totalprice") < 1000, "no_image": F.col("o_orderstatus") == "P", "no_file": F.col("o_custkey") % 5 == 0})


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM events")
def frame_sampling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", frames.sampled(F.col("event_id"), F.col("value"), 5).alias("seen"))
    return series.hold_last(e, ["user_id"], ["event_id"], F.col("seen")).select("event_id", "held")


@query("SELECT event_id FROM events WHERE event_type = 'click' OR event_id % 3 = 0")
def thinned_negatives(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "click")
    return frames.thin_negatives(e, "event_id", "hit").select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8, 2) AS feature, round_even(l_quantity / 4, 1) AS since FROM lineitem")
def rounding_rules(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 8).cast("double").alias("feature"), (F.col("l_quantity") / 4).cast("double").alias("since"))
    return frames.rounded(li, {"feature": 2, "since": 1})


@query("SELECT o_orderkey, round(CAST(o_custkey AS DOUBLE) / (o_orderkey % 50 + 1), 6) AS rate, round((100000 - o_custkey) / (CAST(o_custkey AS DOUBLE) / (o_orderkey % 50 + 1)), 4) AS eta FROM orders WHERE o_custkey > 0")
def progress_eta(spark, sf_dir):
    rate, eta = frames.progress(F.col("o_custkey").cast("double"), F.lit(100000), F.col("o_orderkey") % 50 + 1)
    return table(spark, sf_dir, "orders").where("o_custkey > 0").select("o_orderkey", F.round(rate, 6).alias("rate"), F.round(eta, 4).alias("eta"))


@query("SELECT event_id, count(*) OVER w >= 5 AND sum(CASE WHEN event_type = 'view' THEN 2 ELSE 0 END) OVER w >= 6 AS ready FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def bootstrap_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("found", F.when(F.col("event_type") == "view", 2).otherwise(0))
    return frames.bootstrap_ready(e, ["user_id"], ["event_id"], "found", frames=5, least=6).select("event_id", "ready")


@query("SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_orderkey = c.c_custkey * 2")
def stem_equi_join(spark, sf_dir):
    """Images by order, labels by customer: names with folders and endings of their own, one stem."""
    images = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("images/frame.v2_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("image"))
    labels = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("labels/val/frame.v2_"), (F.col("c_custkey") * 2).cast("string"), F.lit(".txt")).alias("label"))
    return frames.stem_join(images, labels, "image", "label").select("o_orderkey", "c_custkey")


@query("SELECT c_custkey, c_nationkey FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 40) AS n FROM customer) a WHERE n = 1")
def single_or_none(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("part", F.col("c_custkey") % 40)
    return frames.single(c, ["c_nationkey", "c_mktsegment", "part"]).select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 125")
def first_125(spark, sf_dir):
    return frames.first_rows(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 125).select("o_orderkey")


_T = "CASE WHEN near > far THEN least(greatest((y - far) / (near - far), 0.0), 1.0) ELSE 0.5 END"


@query(f"SELECT c_custkey, round(0.016 + 0.026 * ({_T}), 6) AS rx, round(0.032 + 0.036 * ({_T}), 6) AS ry, round(0.016 + 0.026 * least(greatest(y, 0.0), 1.0), 6) AS plain FROM (SELECT c_custkey, c_custkey % 130 / 100.0::DOUBLE - 0.1 AS y, 0.2::DOUBLE AS far, 0.2 + c_nationkey % 3 / 4.0::DOUBLE AS near FROM customer) a")
def perspective_radius(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 130 / 100.0 - 0.1).alias("y"), F.lit(0.2).alias("far"), (0.2 + F.col("c_nationkey") % 3 / 4.0).alias("near"))
    rx, ry = shapes.perspective_radius(shapes.depth(F.col("y"), F.col("far"), F.col("near")))
    plain, _ = shapes.perspective_radius(shapes.depth(F.col("y")))
    return c.select("c_custkey", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), F.round(plain, 6).alias("plain"))


@query("""SELECT event_id, CASE WHEN value > mark + 1 THEN value END AS quick, greatest(mark + 1, mark + elapsed - 2) AS recorded, coalesce(given, greatest(mark - 2, 0.0)) AS context, coalesce(given, mark + 1.5) AS removed, coalesce(given, mark + 5) AS clip_end
FROM (SELECT event_id, value, CAST(event_id % 60 AS DOUBLE) AS mark, CAST(event_id % 7 AS DOUBLE) AS elapsed, CASE WHEN event_id % 4 = 0 THEN value END AS given FROM events) a""")
def clip_end_rules(spark, sf_dir):
    k = F.col("event_id")
    mark, given = (k % 60).cast("double"), F.when(k % 4 == 0, F.col("value"))
    context, removed, end = shapes.clip_defaults(mark, given, given, given)
    return table(spark, sf_dir, "events").select("event_id", shapes.quick_end(F.col("value"), mark).alias("quick"), shapes.recorder_end(mark, (k % 7).cast("double"), F.lit(-2.0)).alias("recorded"), context.alias("context"), removed.alias("removed"), end.alias("clip_end"))


@query("""SELECT event_id, round((ax + bx) / 2, 6) AS mid_x, round((ay + b_y) / 2, 6) AS mid_y, round(atan2(b_y - ay, bx - ax), 6) AS angle, round(greatest(sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)), 0.03), 6) AS length, round(least(greatest(ax * 4, 0.15), 0.9 * pi()), 6) AS width, round(greatest(ay / 10, 0.015), 6) AS radius, round(bx + 0.1, 6) AS moved_x
FROM (SELECT event_id, event_id % 100 / 100.0::DOUBLE AS ax, event_id % 37 / 37.0::DOUBLE AS ay, event_id % 101 / 100.0::DOUBLE AS bx, event_id % 41 / 37.0::DOUBLE AS b_y FROM events) a""")
def shape_edit_clamps(spark, sf_dir):
    k = F.col("event_id")
    ax, ay, bx, by = k % 100 / 100.0, k % 37 / 37.0, k % 101 / 100.0, k % 41 / 37.0
    mx, my = shapes.curve_control(ax, ay, bx, by)
    angle, length, width = shapes.cone(ax, ay, bx, by, ax * 4)
    points = shapes.moved(F.array(F.struct(ax.alias("x"), ay.alias("y")), F.struct(bx.alias("x"), by.alias("y"))), F.lit(0.1), F.lit(0.0))
    named = {"mid_x": mx, "mid_y": my, "angle": angle, "length": length, "width": width, "radius": shapes.radius(ay / 10), "moved_x": points[1]["x"]}
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in named.items()])


def _shapes(spark, sf_dir):
    """Line items 3 and 6 connect the highlights before them."""
    li = table(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("frame"), number.alias("id"), F.when(number % 3 == 0, "connector").otherwise("highlight").alias("type"), (number - 2).alias("from_id"), (number - 1).alias("to_id"), "l_partkey").groupBy("frame", "id", "type", "from_id", "to_id").agg(F.min("l_partkey").alias("pos"))


@query("""WITH s AS (SELECT l_orderkey AS frame, l_linenumber AS id, min(l_partkey) AS pos FROM lineitem GROUP BY 1, 2)
SELECT c.frame, c.id, a.pos AS start, b.pos AS "end" FROM s c JOIN s a ON a.frame = c.frame AND a.id = c.id - 2 JOIN s b ON b.frame = c.frame AND b.id = c.id - 1 WHERE c.id % 3 = 0 AND a.id % 3 > 0 AND b.id % 3 > 0""")
def connectors(spark, sf_dir):
    return shapes.connected(_shapes(spark, sf_dir), ["frame"])


@query(f"""WITH s AS (SELECT frame, id, x1 / 300 AS x, y1 / 200 AS y, conf / 8 AS rx, conf / 9 AS ry FROM {_B} b),
m AS (SELECT o_orderkey AS frame, o_custkey AS click, s.id, round(sqrt(pow(s.x * 640 - o_custkey % 100 / 100.0::DOUBLE * 640, 2) + pow(s.y * 360 - o_custkey % 90 / 90.0::DOUBLE * 360, 2)), 9) AS d, greatest(rx * 640, ry * 360) * 1.8 + 20 AS reach FROM orders JOIN s ON s.frame = o_orderkey)
SELECT frame, click, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY frame, click ORDER BY d, id) AS n FROM m WHERE d <= reach) a WHERE n = 1""")
def nearest_in_reach(spark, sf_dir):
    s = _boxes(spark, sf_dir).select("frame", "id", (F.col("x1") / 300).alias("x"), (F.col("y1") / 200).alias("y"), (F.col("conf") / 8).alias("rx"), (F.col("conf") / 9).alias("ry"))
    k = F.col("o_custkey")
    clicks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), k.alias("click"), (k % 100 / 100.0).alias("x"), (k % 90 / 90.0).alias("y"))
    return shapes.nearest_in_reach(clicks, s, ["frame"], "click", "id", 640.0, 360.0).withColumn("distance", F.round("distance", 6))
