"""Grouped summaries over the line items of an order, taken as the boxes of a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import aggregates as a
from kickframe.operators import evaluate
from kickframe.plans.registry import query, table

#: x from 0 to 959, y from 0 to 539, height from the quantity; rows of a frame in a total order.
_P = "(SELECT l_orderkey AS frame, CAST(l_partkey % 960 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 540 AS DOUBLE) AS y, l_quantity AS h, l_partkey AS id, l_extendedprice AS price, l_discount, l_tax, l_linenumber FROM lineitem)"
_ORDER = "id, price, l_discount, l_tax, l_linenumber"


def _points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 960).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 540).cast("double").alias("y"), F.col("l_quantity").alias("h"), F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("price"), "l_discount", "l_tax", "l_linenumber")


def _r(df, keys, *names, places=6):
    return df.select(*keys, *[(F.round(n, places) + F.lit(0.0)).alias(n) for n in names])


@query(f"SELECT frame, CAST(count_if(y BETWEEN 108 AND 513) AS BIGINT) AS n, round(avg(CASE WHEN y BETWEEN 108 AND 513 THEN x END), 6) AS cx, round(avg(CASE WHEN y BETWEEN 108 AND 513 THEN y END), 6) AS cy FROM {_P} p GROUP BY frame")
def band_centroid(spark, sf_dir):
    return _r(a.centroid(_points(spark, sf_dir), ["frame"], "x", "y", F.col("y").between(108, 513)), ["frame", "n"], "cx", "cy")


@query(f"""SELECT frame, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x, id, price, l_tax) AS l, row_number() OVER (PARTITION BY frame ORDER BY x DESC, id DESC, price DESC, l_tax DESC) AS r, count(*) OVER (PARTITION BY frame) AS k, h - 25 AS vx FROM {_P} p) q
WHERE NOT (k > 3 AND ((l = 1 AND vx >= -3) OR (r = 1 AND vx <= 3))) GROUP BY frame""")
def trimmed_centroid(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _r(a.trimmed_centroid(p.withColumn("vx", F.col("h") - 25), ["frame"], "x", "y", ["id", "price", "l_tax"], "vx"), ["frame", "n"], "cx", "cy")


@query(f"""SELECT frame, round(sum(w * x) / sum(w), 5) AS cx, round(sum(w * y) / sum(w), 5) AS cy FROM (SELECT *, exp(-((x - mx) * (x - mx) + (y - my) * (y - my)) / (2 * 240.0 * 240.0)) AS w FROM (
SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY frame) AS mx, quantile_cont(y, 0.5) OVER (PARTITION BY frame) AS my FROM {_P} p) q) r GROUP BY frame""")
def gaussian_centroid(spark, sf_dir):
    return _r(a.gaussian_centroid(_points(spark, sf_dir), ["frame"], "x", "y", 240.0), ["frame"], "cx", "cy", places=5)


@query(f"SELECT frame, round(sum(h * x) / sum(h), 6) AS weighted FROM {_P} p GROUP BY frame")
def weighted_mean(spark, sf_dir):
    return _r(a.weighted_mean(_points(spark, sf_dir), ["frame"], "h", "x"), ["frame"], "weighted")


@query(f"SELECT frame, count(*) AS n, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std, round(max(h), 6) AS most FROM {_P} p GROUP BY frame")
def mean_std_max(spark, sf_dir):
    return _r(a.spread(_points(spark, sf_dir), ["frame"], "h"), ["frame", "n"], "mean", "std", "most")


@query(f"SELECT frame, round(avg(CASE WHEN x < 480 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM {_P} p GROUP BY frame")
def cond_fraction(spark, sf_dir):
    return _r(a.share_below(_points(spark, sf_dir), ["frame"], "x", 480.0), ["frame"], "share")


@query(f"SELECT frame, round(coalesce(avg(CASE WHEN x < m THEN h END), 0) - coalesce(avg(CASE WHEN x >= m THEN h END), 0), 6) + 0.0 AS gradient FROM (SELECT *, avg(x) OVER (PARTITION BY frame) AS m FROM {_P} p) q GROUP BY frame")
def size_gradient(spark, sf_dir):
    return _r(a.size_gradient(_points(spark, sf_dir), ["frame"], "x", "h"), ["frame"], "gradient")


@query(f"""SELECT frame, max(CASE WHEN l = 1 THEN x END) AS largest, max(CASE WHEN n = 1 THEN x END) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY h DESC, {_ORDER}) AS l, row_number() OVER (PARTITION BY frame ORDER BY abs(x - 480.25), {_ORDER}) AS n FROM {_P} p) q GROUP BY frame""")
def argmax_pick(spark, sf_dir):
    return a.extreme_rows(_points(spark, sf_dir), ["frame"], "h", _ORDER.split(", "), "x", 480.25)


@query(f"""SELECT frame, CAST(count_if(s < 1.0::DOUBLE / 3) AS BIGINT) AS left_third, CAST(count_if(s >= 1.0::DOUBLE / 3 AND s < 2.0::DOUBLE / 3) AS BIGINT) AS mid_third, CAST(count_if(s >= 2.0::DOUBLE / 3) AS BIGINT) AS right_third FROM (
SELECT frame, (x - min(x) OVER w) / CASE WHEN max(x) OVER w = min(x) OVER w THEN 1.0 ELSE max(x) OVER w - min(x) OVER w END AS s FROM {_P} p WINDOW w AS (PARTITION BY frame)) q GROUP BY frame""")
def thirds_histogram(spark, sf_dir):
    return a.thirds(_points(spark, sf_dir), ["frame"], "x")


@query(f"SELECT frame, round(stddev_pop(x), 6) AS top_std FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY h DESC, {_ORDER}) AS n FROM {_P} p) q WHERE n <= 5 GROUP BY frame")
def top5_std(spark, sf_dir):
    return _r(a.top_std(_points(spark, sf_dir), ["frame"], [F.desc("h"), *_ORDER.split(", ")], "x", 5), ["frame"], "top_std")


@query(f"SELECT frame, id, h, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY h DESC, {_ORDER}) AS n FROM {_P} p) q WHERE n <= 6 AND h >= 10")
def topk_then_filter(spark, sf_dir):
    top = a.top_k(_points(spark, sf_dir), ["frame"], [F.desc("h"), *_ORDER.split(", ")], 6)
    return top.where("h >= 10").select("frame", "id", "h", "rank")


@query(f"SELECT frame, id, price FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY price DESC, h, id) AS n FROM {_P} p) q WHERE n = 1")
def best_per_group(spark, sf_dir):
    return a.top_k(_points(spark, sf_dir), ["frame"], [F.desc("price"), F.col("h"), F.col("id")], 1).select("frame", "id", "price")


@query("SELECT l_returnflag, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(100 * avg(CASE WHEN abs(e) < 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS within_10, round(100 * avg(CASE WHEN abs(e) < 20 THEN 1.0::DOUBLE ELSE 0 END), 4) AS within_20 FROM (SELECT l_returnflag, l_quantity - l_extendedprice / 2000 AS e FROM lineitem) a GROUP BY l_returnflag")
def rmse_mae_pct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 2000)
    e = F.col("l_quantity") - F.col("p")
    shares = evaluate.within_share(e, [10.0, 20.0])
    out = li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), *shares)
    return _r(out, ["l_returnflag", "n"], "rmse", "mae", "within_10", "within_20", places=4)


@query("SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS baseline_rmse FROM lineitem GROUP BY l_returnflag")
def baseline_rmse(spark, sf_dir):
    return _r(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.stddev_pop("l_quantity").alias("baseline_rmse")), ["l_returnflag"], "baseline_rmse")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr_l_quantity, round(corr(l_discount, l_extendedprice), 6) AS corr_l_discount, round(corr(l_tax, l_extendedprice), 6) AS corr_l_tax FROM lineitem")
def corr_features(spark, sf_dir):
    out = a.column_correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return _r(out, [], *out.columns)


@query("SELECT l_returnflag, bin, n, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * (50.0::DOUBLE / 18)), 8) AS density FROM (SELECT l_returnflag, CAST(least(floor(l_quantity / (50.0::DOUBLE / 18)), 17) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2) a")
def histogram_density(spark, sf_dir):
    out = a.histogram_density(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 0.0, 50.0, 18)
    return _r(out, ["l_returnflag", "bin", "n"], "density", places=8)



@query("""SELECT o_orderstatus, round(u, 4) AS URGENT, round(h, 4) AS HIGH, round((coalesce(u, 0) + coalesce(h, 0)) / nullif((u IS NOT NULL)::INT + (h IS NOT NULL)::INT, 0), 4) AS mean, CAST((u IS NOT NULL)::INT + (h IS NOT NULL)::INT AS BIGINT) AS valid FROM (
SELECT o_orderstatus, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS u, avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS h FROM orders GROUP BY o_orderstatus) a""")
def approach_clip_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')").withColumn("clip", F.substring("o_orderpriority", 3, 10))
    means = o.groupBy("o_orderstatus", "clip").agg(F.avg("o_totalprice").alias("rmse"))
    everyone = table(spark, sf_dir, "orders").select("o_orderstatus").distinct()
    wide = a.matrix(everyone.join(means, "o_orderstatus", "left"), "o_orderstatus", "clip", ["URGENT", "HIGH"], "rmse")
    return wide.select("o_orderstatus", F.round("URGENT", 4).alias("URGENT"), F.round("HIGH", 4).alias("HIGH"), F.round("mean", 4).alias("mean"), "valid")


@query("""SELECT o_orderstatus, round(sqrt(avg(rmse * rmse)), 4) AS by_segment, round(sqrt(sum(rmse * rmse * n) / sum(n)), 4) AS by_row, round(avg(mae), 4) AS mae FROM (
SELECT o_orderstatus, o_orderpriority, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM (SELECT *, o_totalprice - 150000 AS e FROM orders) a GROUP BY 1, 2 HAVING count(*) >= 50) b GROUP BY o_orderstatus""")
def overall_two_weightings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("base", F.lit(150000.0))
    by = evaluate.errors(o, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "base").where("n >= 50")
    square = F.col("rmse") * F.col("rmse")
    out = by.groupBy("o_orderstatus").agg(F.sqrt(F.avg(square)).alias("by_segment"), F.sqrt(F.sum(square * F.col("n")) / F.sum("n")).alias("by_row"), F.avg("mae").alias("mae"))
    return _r(out, ["o_orderstatus"], "by_segment", "by_row", "mae", places=4)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def mode_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("""SELECT sequence, min(page_id) AS recorded_at, CAST(sum(size) AS BIGINT) AS total, sum(size) < 20000 AS test_clip, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS files FROM (
SELECT page_id, length(html) AS size, coalesce(nullif(regexp_extract(url, '([0-9])[^0-9]*$', 1), ''), 'none') AS sequence FROM pages) a GROUP BY sequence""")
def files_grouped_by_seq(spark, sf_dir):
    from kickframe.functions.text import found

    p = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("size"))
    key = F.coalesce(found(F.col("url"), r"([0-9])[^0-9]*$"), F.lit("none"))
    out = a.recordings(p, key, "page_id", "size", "page_id", 20000)
    return out.select("sequence", "recorded_at", "total", "test_clip", F.array_join(F.transform("files", lambda f: f["page_id"].cast("string")), ",").alias("files"))


@query("SELECT grp, CAST(sum(n) AS BIGINT) AS n FROM (SELECT r_name AS grp, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name) a GROUP BY ROLLUP (grp)")
def rollup_counts(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # both are dimension tables of fixed size
    return joined.rollup(F.col("r_name").alias("grp")).agg(F.count("*").alias("n"))
