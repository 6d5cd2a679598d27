"""Joins, row changes and set operations over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import relational as r
from kickframe.plans.registry import query, table


@query("SELECT c_custkey, n_name AS country FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON c_nationkey = n_nationkey")
def left_join_nested(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    return r.left_nested(c, n, c["c_nationkey"] == n["n_nationkey"], "nation", ["n_name"]).select("c_custkey", F.col("nation.n_name").alias("country"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT o_orderkey, n_name, l_partkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey")
def dependent_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c, n, li = (table(spark, sf_dir, t) for t in ("customer", "nation", "lineitem"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(li, li.l_orderkey == o.o_orderkey)  # nations are a fixed table
    return joined.select("o_orderkey", "n_name", "l_partkey")


@query("SELECT c_custkey AS id, o_orderstatus AS role FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def outer_fallback(spark, sf_dir):
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    roles = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("role"))
    return r.left_or_only(profiles, roles, "id", "role")


_NEW = "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_orderkey % 3 AS version FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'Y', 5 FROM orders WHERE o_orderkey % 20 = 0 UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'Z', 1 FROM orders WHERE o_orderkey % 50 = 0"


@query(f"WITH n AS ({_NEW}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS k FROM n) a WHERE k = 1) SELECT o_orderkey, o_custkey, o_orderstatus FROM l UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)")
def upsert_latest(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    change = lambda d, s, v: d.select("o_orderkey", "o_custkey", F.lit(s).alias("o_orderstatus"), v.cast("bigint").alias("version"))
    k = F.col("o_orderkey")
    new = change(old.where(k % 10 == 0), "X", k % 3).union(change(old.where(k % 20 == 0), "Y", F.lit(5))).union(change(old.where(k % 50 == 0).withColumn("o_orderkey", k + 10000000), "Z", F.lit(1)))
    return r.upsert(old, new, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_key(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return r.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def update_patch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("P").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    return r.patch(o, changes, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT min(c_mktsegment) FROM customer))")
def role_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    first = c.agg(F.min("c_mktsegment").alias("m"))
    roles = c.join(F.broadcast(first), c.c_mktsegment == first.m).select(F.col("c_custkey").alias("o_custkey"), F.lit("coach").alias("role"))  # one row
    return r.visible(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), roles, "o_custkey", F.col("o_orderstatus") == "F").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderdate >= TIMESTAMP '1998-01-01'")
def link_validity(spark, sf_dir):
    links = table(spark, sf_dir, "orders").withColumn("expires_at", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")))
    return r.unexpired(links, "expires_at", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 5, 9, 300)")
def listed_rows(spark, sf_dir):
    link = spark.range(1).select(F.array(*[F.lit(v).cast("bigint") for v in (1, 5, 9, 300)]).alias("annotation_ids"))
    return r.listed(table(spark, sf_dir, "orders").select("o_orderkey"), link, "o_orderkey", "annotation_ids")


def _shape(id_: str, kind: str, value=None, start: str | None = None, end: str | None = None):
    value = F.lit(None) if value is None else value
    return F.struct(F.lit(id_).alias("id"), F.lit(kind).alias("type"), value.cast("int").alias("value"), F.lit(start).cast("string").alias("fromId"), F.lit(end).cast("string").alias("toId"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'b,d' ELSE 'a,b,c' END AS left_over, CAST(greatest(o_orderkey % 5, o_orderkey % 3) + 1 AS INTEGER) AS next_number FROM orders")
def shape_edits(spark, sf_dir):
    k = F.col("o_orderkey")
    shapes = F.array(_shape("a", "number", k % 5), _shape("b", "highlight"), _shape("c", "connector", None, "a", "b"), _shape("d", "number", k % 3))
    s = table(spark, sf_dir, "orders").select("o_orderkey", shapes.alias("shapes"))
    kept = r.cascade_delete(F.col("shapes"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("d"))
    return s.select("o_orderkey", F.array_join(F.transform(kept, lambda x: x["id"]), ",").alias("left_over"), r.next_number(F.col("shapes")).alias("next_number"))


@query("SELECT l_orderkey, coalesce(min_by(l_returnflag, l_partkey) FILTER (WHERE l_quantity > 40), 'cw') AS choice, count(*) FILTER (WHERE l_quantity > 40) = 0 AS fallback FROM (SELECT l_orderkey, l_partkey, max(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) a GROUP BY l_orderkey")
def first_success(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_quantity").alias("l_quantity"))
    return r.first_success(li, ["l_orderkey"], "l_partkey", "l_returnflag", F.col("l_quantity") > 40, "cw")


_GRID = "SELECT CAST(y AS INTEGER) AS dyaw, CAST(p AS INTEGER) AS dpitch FROM (SELECT unnest(generate_series(-18, 18, 6)) AS y) a, (SELECT unnest(generate_series(-8, 8, 4)) AS p) b"


@query(f"""SELECT n_nationkey, dyaw, dpitch, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, dyaw, dpitch) AS k FROM (
SELECT n_nationkey, dyaw, dpitch, 0.45::DOUBLE * (1 - abs(dyaw - (n_nationkey % 13 - 6)) / 30.0::DOUBLE) + 0.55::DOUBLE * (1 - abs(dpitch - (n_nationkey % 7 - 3)) / 12.0::DOUBLE) AS score FROM nation, ({_GRID}) g) a) b WHERE k = 1""")
def grid_search_best(spark, sf_dir):
    yaw = spark.range(-18, 19, 6).select(F.col("id").cast("int").alias("dyaw"))
    grid = yaw.crossJoin(spark.range(-8, 9, 4).select(F.col("id").cast("int").alias("dpitch")))  # 35 constant rows
    k = F.col("n_nationkey")
    score = 0.45 * (1 - F.abs(F.col("dyaw") - (k % 13 - 6)) / 30.0) + 0.55 * (1 - F.abs(F.col("dpitch") - (k % 7 - 3)) / 12.0)
    return r.best_of_grid(table(spark, sf_dir, "nation"), grid, ["n_nationkey"], score, ["dyaw", "dpitch"]).select("n_nationkey", "dyaw", "dpitch", F.round("score", 6).alias("score"))


@query(f"""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey AS DOUBLE) WHEN best > 0 THEN CAST(dyaw AS DOUBLE) ELSE 0.0 END AS start_yaw FROM (
SELECT n_nationkey, dyaw, best, row_number() OVER (PARTITION BY n_nationkey ORDER BY best DESC, dyaw) AS k FROM (SELECT n_nationkey, dyaw, (n_nationkey * 7 + dyaw + 18) % 11 * (1 - abs(dyaw) / 18.0::DOUBLE) AS best FROM nation, (SELECT DISTINCT dyaw FROM ({_GRID}) g) h) a) b WHERE k = 1""")
def warm_start_choice(spark, sf_dir):
    """A sure ball wins; else the scan direction with the most players near the middle; else 0."""
    grid = spark.range(-18, 19, 6).select(F.col("id").cast("int").alias("dyaw"))
    k = F.col("n_nationkey")
    score = (k * 7 + F.col("dyaw") + 18) % 11 * (1 - F.abs("dyaw") / 18.0)
    best = r.best_of_grid(table(spark, sf_dir, "nation"), grid, ["n_nationkey"], score, ["dyaw"])
    return best.select("n_nationkey", F.when(k % 4 == 0, k.cast("double")).when(F.col("score") > 0, F.col("dyaw").cast("double")).otherwise(0.0).alias("start_yaw"))


@query("SELECT event_id, 'a' AS split FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'b' FROM events WHERE event_id % 3 = 0")
def union_all(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return e.where("event_id % 2 = 0").withColumn("split", F.lit("a")).unionByName(e.where("event_id % 3 = 0").withColumn("split", F.lit("b")))


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("event_type = 'purchase'").select("user_id"))


@query("""SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS together, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_first FROM (
SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0), []) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1), []) AS b FROM events GROUP BY user_id) s""")
def array_set_ops(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sets = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select("user_id", joined(F.array_union("a", "b")).alias("together"), joined(F.array_except("a", "b")).alias("only_first"))


@query("""SELECT event_id, round(stop, 3) AS stop, round(next_start, 3) AS next_start, place FROM (SELECT event_id, t + 10 AS stop, greatest(0.0, lead(t) OVER w - 2) AS next_start, row_number() OVER w AS place FROM (
SELECT event_id, user_id, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events) a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) b""")
def reel_schedule(spark, sf_dir):
    from kickframe.operators import series

    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).withColumn("none", F.lit(None).cast("double"))
    out = series.reel(e, ["user_id"], ["t", "event_id"], "t", "none", 10.0, 2.0)
    return out.select("event_id", F.round("stop", 3).alias("stop"), F.round("next_start", 3).alias("next_start"), "place")


@query("SELECT event_id, round(least(c, t), 6) AS c, round(t, 6) AS t, round(greatest(s, t), 6) AS s, round(greatest(e, greatest(s, t)), 6) AS e FROM (SELECT event_id, value AS t, event_id % 100 + 0.5::DOUBLE AS c, event_id % 70 + 0.5::DOUBLE AS s, event_id % 90 + 0.5::DOUBLE AS e FROM events) a")
def ordered_constraints(spark, sf_dir):
    from kickframe.operators import series

    k = F.col("event_id")
    points = series.ordered_points(k % 100 + 0.5, F.col("value"), k % 70 + 0.5, k % 90 + 0.5)
    return table(spark, sf_dir, "events").select("event_id", *[F.round(p, 6).alias(n) for p, n in zip(points, "ctse", strict=True)])
