"""Boxes, clusters and tracks over the line items, the events and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import aggregates, boxes, cluster, tracking
from kickframe.plans.registry import query, table

#: One box per line item, numbered within its order.
_B = """(SELECT frame, id, x1, y1, x1 + w AS x2, y1 + h AS y2, conf FROM (
SELECT l_orderkey AS frame, CAST(l_partkey % 300 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 200 AS DOUBLE) AS y1, l_quantity * 4 AS w, l_quantity * 6 AS h, 1 - l_discount AS conf,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS id FROM lineitem) a)"""


def _boxes(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.row_number().over(w).cast("bigint"))
    x1, y1 = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") * 7 % 200).cast("double")
    return li.select(F.col("l_orderkey").alias("frame"), "id", x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity") * 4).alias("x2"), (y1 + F.col("l_quantity") * 6).alias("y2"), (1 - F.col("l_discount")).alias("conf"))


def _structs(spark, sf_dir):
    return _boxes(spark, sf_dir).select("frame", "id", F.struct("x1", "y1", "x2", "y2", "conf", "id").alias("box"))


def _iou_sql(a: str, b: str) -> str:
    both = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda c: f"({c}.x2 - {c}.x1) * ({c}.y2 - {c}.y1)"
    return f"({both}) / ({area(a)} + {area(b)} - {both})"


@query(f"SELECT * FROM (SELECT a.frame, a.id AS a, b.id AS b, round({_iou_sql('a', 'b')}, 6) AS iou FROM {_B} a JOIN {_B} b ON a.frame = b.frame AND a.id < b.id) x WHERE iou > 0.0000005")
def iou_pairs(spark, sf_dir):
    return boxes.pairs_iou(_structs(spark, sf_dir), "frame", "box", "id").select("frame", "a", "b", F.round("iou", 6).alias("iou")).where("iou > 0.0000005")


def _nms_sql(hit: str) -> str:
    return f"""WITH l AS (SELECT frame, list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf, id := id) ORDER BY conf DESC, id) AS bs FROM {_B} b GROUP BY frame)
SELECT frame, array_to_string(list_transform(kept, lambda k: CAST(k.id AS VARCHAR)), ',') AS kept FROM (
SELECT frame, list_reduce(list_transform(bs, lambda b: [b]), lambda acc, n: CASE WHEN len(list_filter(acc, lambda k: {hit})) > 0 THEN acc ELSE list_concat(acc, n) END) AS kept FROM l) r"""


_HIT = _iou_sql("k", "n[1]") + " >= 0.55"
_NEAR = "sqrt(pow((k.x1 + k.x2 - n[1].x1 - n[1].x2) / 2, 2) + pow((k.y1 + k.y2 - n[1].y1 - n[1].y2) / 2, 2)) <= 0.35 * greatest(1.0, least(k.y2 - k.y1, n[1].y2 - n[1].y1))"


def _kept_ids(df):
    return df.select("frame", F.array_join(F.transform("kept", lambda b: b["id"].cast("string")), ",").alias("kept"))


@query(_nms_sql(_HIT))
def nms_greedy(spark, sf_dir):
    return _kept_ids(boxes.suppress(_structs(spark, sf_dir), "frame", "box"))


@query(_nms_sql(f"({_HIT}) OR ({_NEAR})"))
def nms_people(spark, sf_dir):
    return _kept_ids(boxes.suppress(_structs(spark, sf_dir), "frame", "box", centre_share=0.35))


@query("""SELECT p_partkey, CAST(x AS INTEGER) AS x FROM (SELECT p_partkey, unnest(list_distinct(list_concat(generate_series(0, greatest(0, 400 + p_size * 10 - 320), 256), [CAST(greatest(0, 400 + p_size * 10 - 320) AS BIGINT)]))) AS x FROM part) a""")
def tile_grid(spark, sf_dir):
    starts = boxes.tile_starts(400 + F.col("p_size") * 10, F.lit(320))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(starts).alias("x"))


@query(f"""WITH s AS (SELECT frame, count(*) < 3 OR quantile_cont((x2 - x1) * (y2 - y1), 0.5) / (960 * 540) < 0.02 AS second FROM {_B} b GROUP BY frame),
a AS (SELECT b.*, 1 AS pass FROM {_B} b UNION ALL SELECT b.frame, b.id + 100, b.x1 + 2, b.y1 + 2, b.x2 + 2, b.y2 + 2, b.conf - 0.05, 2 FROM {_B} b JOIN s ON s.frame = b.frame AND s.second WHERE b.id % 2 = 1)
SELECT frame, count(*) AS boxes, CAST(sum(CASE WHEN pass = 2 THEN 1 ELSE 0 END) AS BIGINT) AS second_pass FROM a GROUP BY frame""")
def two_pass_merge(spark, sf_dir):
    """A second pass, here shifted copies of odd boxes, joins the first where that found few or small boxes."""
    b = _boxes(spark, sf_dir)
    derived = boxes.with_derived(b)
    second = boxes.needs_second_pass(derived, "frame", "area", 960.0, 540.0, few=3, small=0.02).where("second").select("frame")
    again = b.where("id % 2 = 1").join(second, "frame", "left_semi").select("frame", (F.col("id") + 100).alias("id"), *[(F.col(c) + 2).alias(c) for c in ("x1", "y1", "x2", "y2")], (F.col("conf") - 0.05).alias("conf"))
    both = b.withColumn("pass", F.lit(1)).unionByName(again.withColumn("pass", F.lit(2)))
    return both.groupBy("frame").agg(F.count("*").alias("boxes"), F.sum(F.when(F.col("pass") == 2, 1).otherwise(0)).alias("second_pass"))


_AREA = "(x2 - x1) * (y2 - y1)"


@query(f"SELECT frame, id, {_AREA} / (960 * 540) >= 8e-5 + (0.05 - 8e-5) * pow(least(greatest((y1 + y2) / 2 / 540, 0.0), 1.0), 2) AS large, {_AREA} <= 960 * 540 * 0.02 AS small, (y1 + y2) / 2 > 0.5 * 540 AND {_AREA} > 0.001 * 960 * 540 AS bottom FROM {_B} b")
def box_filters(spark, sf_dir):
    d = boxes.with_derived(_boxes(spark, sf_dir))
    a, cy = F.col("area"), F.col("cy")
    # a shorter view puts its bottom where the boxes are
    return d.select("frame", "id", boxes.large_enough(a, cy, 960.0, 540.0, near=0.05).alias("large"), boxes.small_enough(a, 960.0, 540.0).alias("small"), ((cy > 0.5 * 540) & (a > 0.001 * 960 * 540)).alias("bottom"))


_C = "(SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS x, CAST(c_custkey % 50 + 1 AS DOUBLE) AS h FROM customer)"


def _cust(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 50 + 1).cast("double").alias("h"))


def _islands(eps: str, keys: str = "k", source: str = _C, order: str = "x, id") -> str:
    return f"""(SELECT *, CASE WHEN count(*) OVER (PARTITION BY {keys}, i) = 1 THEN -1 ELSE i END AS cluster FROM (SELECT *, sum(g) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS i FROM (
SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY {keys} ORDER BY {order}) > {eps} THEN 1 ELSE 0 END AS g FROM {source} s) a) b)"""


@query(f"SELECT id, CAST(cluster AS BIGINT) AS cluster FROM {_islands('60')} c")
def dbscan1d(spark, sf_dir):
    return cluster.dbscan_pairs(_cust(spark, sf_dir), ["k"], "x", ["id"], 60.0).select("id", "cluster")


@query(f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY k ORDER BY x RANGE BETWEEN 150 PRECEDING AND 150 FOLLOWING) >= 4 AS core FROM {_C} s),
d AS (SELECT *, max(CASE WHEN core THEN x END) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
e AS (SELECT *, sum(CASE WHEN core AND (before IS NULL OR x - before > 150) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS c FROM d),
f AS (SELECT a.id, b.c, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x), b.x, b.id) AS n FROM e a JOIN e b ON a.k = b.k AND b.core AND abs(a.x - b.x) <= 150)
SELECT e.id, CAST(coalesce(f.c, 0) - 1 AS BIGINT) AS cluster FROM e LEFT JOIN f ON f.id = e.id AND f.n = 1""")
def dbscan1d_general(spark, sf_dir):
    return cluster.dbscan_line(_cust(spark, sf_dir), ["k"], "x", ["id"], 150.0, 4).select("id", "cluster")


def _best_sql(eps: str, score: str, least: int, keys: str = "k", source: str = _C, order: str = "x, id") -> str:
    return f"""(SELECT e.*, coalesce(centre, mx) AS centre_, coalesce(n, 1) AS size_, coalesce(mean_size, mh) AS mean_ FROM (
SELECT {keys}, avg(x) AS mx, avg(h) AS mh, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_clusters FROM {_islands(eps, keys, source, order)} z GROUP BY {keys}) e LEFT JOIN (
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, first) AS r FROM (SELECT {keys}, cluster, count(*) AS n, avg(x) AS centre, stddev_pop(x) AS std, avg(h) AS mean_size, sum(h) AS total, min(id) AS first FROM {_islands(eps, keys, source, order)} y WHERE cluster >= 0 GROUP BY {keys}, cluster HAVING count(*) >= {least}) q) t USING ({keys}) WHERE r = 1 OR r IS NULL)"""


@query(f"SELECT k, round(centre_, 4) AS centre, CAST(size_ AS BIGINT) AS size, n_clusters FROM {_best_sql('60', 'n / (std + 1)', 3)} b")
def action_cluster(spark, sf_dir):
    placed = cluster.dbscan_pairs(_cust(spark, sf_dir), ["k"], "x", ["id"], 60.0)
    return cluster.best(placed, ["k"], "x", "h", "id", "by_spread", 3).select("k", F.round("centre", 4).alias("centre"), "size", "n_clusters")


@query(f"SELECT k, round(centre_, 4) AS centre, CAST(size_ AS BIGINT) AS size, round(mean_, 4) AS mean_size, n_clusters FROM {_best_sql('60', 'total', 2)} b")
def best_cluster(spark, sf_dir):
    placed = cluster.dbscan_pairs(_cust(spark, sf_dir), ["k"], "x", ["id"], 60.0)
    return cluster.best(placed, ["k"], "x", "h", "id", "by_height", 2).select("k", F.round("centre", 4).alias("centre"), "size", F.round("mean_size", 4).alias("mean_size"), "n_clusters")


@query("SELECT k, " + ", ".join(f"round(max(CASE WHEN eps = {e} THEN centre_ END), 4) AS centre_eps{e}, CAST(max(CASE WHEN eps = {e} THEN size_ END) AS BIGINT) AS size_eps{e}" for e in (20, 60, 120)) + f" FROM {_best_sql('eps', 'total', 2, 'k, eps', f'(SELECT c.*, unnest([20, 60, 120]) AS eps FROM {_C} c)')} b GROUP BY k")
def eps_sweep_pivot(spark, sf_dir):
    out = cluster.sweep(_cust(spark, sf_dir), ["k"], "x", "h", "id", [20, 60, 120], "by_height", 2)
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("centre") else F.col(c) for c in out.columns])


@query(f"""SELECT k, round(centre_, 4) AS centre, CAST(size_ AS BIGINT) AS size FROM {_best_sql('30', 'total', 2, 'k', f'(SELECT k, id, x, h, unnest(generate_series(1, CAST(floor(h / m * 3) AS BIGINT) + 1)) AS copy FROM (SELECT *, max(h) OVER (PARTITION BY k) AS m FROM {_C} c) d)', 'x, id, copy')} b""")
def weighted_replicate_cluster(spark, sf_dir):
    copies = cluster.replicate(_cust(spark, sf_dir), ["k"], "h")
    placed = cluster.dbscan_pairs(copies, ["k"], "x", ["id", "copy"], 30.0)
    return cluster.best(placed, ["k"], "x", "h", "id", "by_height", 2).select("k", F.round("centre", 4).alias("centre"), "size")


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("feature"))


_CENTRES = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(3)]
_D = ", ".join(f"sqrt(s - 2 * CAST(embedding[{k + 1}] AS DOUBLE) + 1) AS d{k}" for k in range(3))
_NEAREST = f"""(SELECT *, least(d0, d1, d2) AS best, list_sort([d0, d1, d2])[2] - least(d0, d1, d2) AS margin, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS i FROM (
SELECT vec_id, label, {_D} FROM (SELECT vec_id, label, embedding, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS s FROM embeddings) a) b)"""


@query(f"SELECT vec_id, round(best, 5) AS d0, round(margin, 5) AS margin, CAST(CASE WHEN best <= 6 AND margin >= 0.05 THEN i ELSE -1 END AS INTEGER) AS assigned FROM {_NEAREST} n")
def nearest_centre_margin(spark, sf_dir):
    out = cluster.nearest_centre(_embedded(spark, sf_dir).withColumnRenamed("label", "gold"), "feature", _CENTRES)
    return out.select("vec_id", F.round("d0", 5).alias("d0"), F.round("margin", 5).alias("margin"), F.coalesce("label", F.lit(-1)).alias("assigned"))


@query(f"SELECT round(avg(margin), 5) AS mean_margin, round(quantile_cont(margin, 0.1), 5) AS p10 FROM {_NEAREST} n")
def margin_percentile(spark, sf_dir):
    out = cluster.nearest_centre(_embedded(spark, sf_dir).withColumnRenamed("label", "gold"), "feature", _CENTRES)
    return out.agg(F.round(F.avg("margin"), 5).alias("mean_margin"), F.round(F.percentile("margin", F.lit(0.1)), 5).alias("p10"))


_PERMS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


@query("SELECT CAST(plan AS INTEGER) AS plan, round(hits / total, 6) AS accuracy FROM (SELECT plan, hits, total, row_number() OVER (ORDER BY hits DESC, plan) AS r FROM (" + " UNION ALL ".join(f"SELECT {i} AS plan, CAST(sum(CASE WHEN " + " OR ".join(f"(i = {p} AND label % 3 = {g})" for p, g in enumerate(perm)) + f" THEN 1 ELSE 0 END) AS DOUBLE) AS hits, count(*) AS total FROM {_NEAREST} n" for i, perm in enumerate(_PERMS)) + ") a) b WHERE r = 1")
def permutation_mapping_accuracy(spark, sf_dir):
    out = cluster.nearest_centre(_embedded(spark, sf_dir).withColumn("gold", F.col("label") % 3).drop("label"), "feature", _CENTRES, float("inf"), float("-inf"))
    return aggregates.mapping_accuracy(out, "label", "gold", 3).select("plan", F.round("accuracy", 6).alias("accuracy"))


@query()
def kmeans_lloyd(spark, sf_dir):
    """Lloyd's rounds from fixed centres; the first numbers of each centre."""
    centres = cluster.lloyd(_embedded(spark, sf_dir), "feature", _CENTRES)
    return spark.createDataFrame([(k, *[round(v, 5) for v in c[:4]]) for k, c in enumerate(centres)], "label int, c0 double, c1 double, c2 double, c3 double")


def _tracked(spark, sf_dir, **kwargs):
    """A box's number in its order as the frame of a clip of fifty orders, so clips grow in number with the data, not in length."""
    b = _boxes(spark, sf_dir).select(F.expr("frame div 50").alias("clip"), F.col("id").alias("t"), F.col("frame").alias("det"), "x1", "y1", "x2", "y2").withColumn("vote", F.when(F.col("det") % 4 != 0, F.concat(F.lit("team"), (F.col("det") % 2).cast("string"))))
    return tracking.track(b, ["clip"], "t", ["det"], vote="vote", **kwargs).select("clip", "t", "det", "track_id", "label")


@query()
def iou_tracker(spark, sf_dir):
    return _tracked(spark, sf_dir)


@query()
def label_tracker(spark, sf_dir):
    return _tracked(spark, sf_dir, forget=30, reuse_new=False, min_votes=6, ratio=0.6)
