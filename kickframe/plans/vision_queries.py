"""Robust fits, hulls, masks and pictures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions import geometry, shapes, text
from kickframe.operators import cluster, homography, hulls, masks, pictures, relational, series, sliced
from kickframe.plans.registry import query, table

_H = ("1 + s / 1000", "0.02", "5 + s", "0.01", "1.1", "-3.0", "0.00001 * (s % 7)", "0.00002")
_W = f"(({_H[6]}) * x + {_H[7]} * y + 1)"
_PLANTED = f"""(SELECT *, (({_H[0]}) * x + {_H[1]} * y + {_H[2]}) / {_W} + CASE WHEN wrong THEN 80 + l_partkey % 300 ELSE 0 END AS u, ({_H[3]} * x + {_H[4]} * y + {_H[5]}) / {_W} - CASE WHEN wrong THEN 60 + l_orderkey % 90 ELSE 0 END AS v FROM (
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, CAST(l_suppkey % 50 AS DOUBLE) AS s, CAST(l_partkey % 960 AS DOUBLE) AS x, CAST(l_orderkey * 7 % 540 AS DOUBLE) AS y, (l_orderkey + l_linenumber) % 10 < 3 AS wrong FROM lineitem) a)"""


@query(f"""SELECT l_suppkey, count(*) AS n, count(*) FILTER (NOT wrong) AS inliers, {", ".join(f"round(CAST(any_value({h}) AS DOUBLE), 6) + 0.0 AS h{i}" for i, h in enumerate(_H))} FROM {_PLANTED} p GROUP BY l_suppkey""")
def homography_fit(spark, sf_dir):
    """Each supplier's own view, found again among three wrong points in ten."""
    s, x, y = (F.col("l_suppkey") % 50).cast("double"), (F.col("l_partkey") % 960).cast("double"), (F.col("l_orderkey") * 7 % 540).cast("double")
    wrong = (F.col("l_orderkey") + F.col("l_linenumber")) % 10 < 3
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", s.alias("s"), x.alias("x"), y.alias("y"), wrong.alias("wrong"), "l_partkey", "l_orderkey", F.xxhash64("l_orderkey", "l_linenumber").alias("id"))
    w = 0.00001 * (F.col("s") % 7) * F.col("x") + 0.00002 * F.col("y") + 1
    u = ((1 + F.col("s") / 1000) * F.col("x") + 0.02 * F.col("y") + 5 + F.col("s")) / w + F.when(F.col("wrong"), 80 + F.col("l_partkey") % 300).otherwise(F.lit(0))
    v = (0.01 * F.col("x") + 1.1 * F.col("y") - 3.0) / w - F.when(F.col("wrong"), 60 + F.col("l_orderkey") % 90).otherwise(F.lit(0))
    found = homography.fit(rows.withColumns({"u": u, "v": v}), ["l_suppkey"], "id")
    return found.select("l_suppkey", "n", "inliers", *[(F.round(F.col("h")[i], 6) + F.lit(0.0)).alias(f"h{i}") for i in range(8)])


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS o, l_partkey % 960 AS x, l_suppkey * 7 % 540 AS y FROM lineitem),
e AS (SELECT a.o, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM p a JOIN p b ON a.o = b.o AND (a.x <> b.x OR a.y <> b.y)),
c AS (SELECT e.*, (qx - ax) * (p.y - ay) - (qy - ay) * (p.x - ax) AS side, (p.x - ax) * (p.x - qx) + (p.y - ay) * (p.y - qy) AS along FROM e JOIN p USING (o)),
h AS (SELECT o, ax, ay, qx, qy FROM c GROUP BY ALL HAVING min(side) >= 0 AND max(CASE WHEN side = 0 THEN along ELSE 0 END) <= 0)
SELECT p.o AS l_orderkey, greatest(coalesce(any_value(n), 0), 1) AS corners, CAST(coalesce(any_value(area), 0) AS BIGINT) AS double_area FROM p LEFT JOIN (SELECT o, count(*) AS n, sum(ax * qy - ay * qx) AS area FROM h GROUP BY o) q USING (o) GROUP BY p.o""")
def convex_hull(spark, sf_dir):
    """Corners and twice the area of the hull of each order's points."""
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 960).alias("x"), (F.col("l_suppkey") * 7 % 540).alias("y"))
    h = F.col("hull")
    turned = F.concat(F.slice(h, 2, F.size(h) - 1), F.slice(h, 1, 1))
    area = F.aggregate(F.zip_with(h, turned, lambda a, b: a["x"] * b["y"] - a["y"] * b["x"]), F.lit(0.0), lambda s, v: s + v)
    return hulls.convex_hull(points, ["l_orderkey"]).select("l_orderkey", F.size(h).cast("bigint").alias("corners"), area.cast("bigint").alias("double_area"))


@query("""WITH c AS (SELECT c_custkey, k, CAST((c_custkey * 37 + k * 450) % 2880 AS DOUBLE) AS x, CAST(700 + (c_custkey * k) % 300 AS DOUBLE) AS y FROM customer, range(4) t(k)),
e AS (SELECT a.c_custkey, a.k, a.x, a.y, CASE WHEN abs(b.x - a.x) <= 1440 THEN b.x WHEN b.x > a.x THEN b.x - 2880 ELSE b.x + 2880 END AS tx, b.y AS ty FROM c a JOIN c b ON b.c_custkey = a.c_custkey AND b.k = (a.k + 1) % 4),
d AS (SELECT c_custkey, x + i / 10.0::DOUBLE * (tx - x) AS x, y + i / 10.0::DOUBLE * (ty - y) AS y FROM e, range(10) r(i))
SELECT c_custkey, count(*) AS n, round(sum(x - floor(x / 2880) * 2880), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM d GROUP BY c_custkey""")
def outline_points(spark, sf_dir):
    """Points along the edges of a polygon that may cross the seam."""
    k = F.col("c_custkey")
    corner = lambda i: F.struct(((k * 37 + i * 450) % 2880).cast("double").alias("x"), (700 + (k * i) % 300).cast("double").alias("y"))
    points = table(spark, sf_dir, "customer").select("c_custkey", F.explode(hulls.densify(F.array(*[corner(F.lit(i)) for i in range(4)]), 2880.0, 10)).alias("p"))
    return points.groupBy("c_custkey").agg(F.count("*").alias("n"), F.round(F.sum("p.x"), 4).alias("sum_x"), F.round(F.sum("p.y"), 4).alias("sum_y"))


_CORNERS = "(SELECT n_nationkey AS n, k, CAST((n_nationkey * 13 + k * 31 + 3) % 110 - 6 AS INTEGER) AS x, CAST((n_nationkey * 7 + k * k * 11) % 54 AS INTEGER) AS y FROM nation, range(5) t(k) WHERE n_nationkey % 6 <> 5)"
_EDGES = f"(SELECT a.n, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM {_CORNERS} a JOIN {_CORNERS} b ON a.n = b.n AND b.k = (a.k + 1) % 5)"
#: Whether (px, py) is inside by the even-odd rule, or on an edge, counted over the edges e of its polygon.
_SET = """count(*) FILTER ((y0 <= py) <> (y1 <= py) AND px < x0 + (py - y0) * (x1 - x0) / CAST(CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END AS DOUBLE)) % 2 = 1
OR count(*) FILTER ((x1 - x0) * (py - y0) = (y1 - y0) * (px - x0) AND px BETWEEN least(x0, x1) AND greatest(x0, x1) AND py BETWEEN least(y0, y1) AND greatest(y0, y1)) > 0"""


def _masks(spark, sf_dir):
    n = F.col("n_nationkey")
    corner = lambda k: F.struct(((n * 13 + k * 31 + 3) % 110 - 6).alias("x"), ((n * 7 + k * k * 11) % 54).alias("y"))
    polygons = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").select(n.alias("n"), F.array(*[corner(k) for k in range(5)]).alias("poly"))
    return masks.mask_runs(polygons, ["n"], "poly", 96, 54)


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 25 AS n, l_partkey % 120 - 12 + l_discount AS x, l_orderkey % 60 - 3 + l_tax AS y FROM lineitem),
q AS (SELECT *, CAST(least(greatest(round_even(x, 0), 0), 95) AS INTEGER) AS px, CAST(least(greatest(round_even(y, 0), 0), 53) AS INTEGER) AS py FROM p),
s AS (SELECT n, px, py, {_SET} AS is_set FROM (SELECT DISTINCT n, px, py FROM q) d JOIN {_EDGES} e USING (n) GROUP BY n, px, py)
SELECT l_orderkey, l_linenumber FROM q LEFT JOIN s USING (n, px, py) WHERE coalesce(is_set, true)""")
def mask_membership(spark, sf_dir):
    """Points whose pixel is set in their polygon's mask; every sixth polygon is missing, and its points stay."""
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 25).alias("n"), (F.col("l_partkey") % 120 - 12 + F.col("l_discount")).alias("x"), (F.col("l_orderkey") % 60 - 3 + F.col("l_tax")).alias("y"))
    return masks.keep_in_mask(points, _masks(spark, sf_dir), ["n"], "x", "y", 96, 54).select("l_orderkey", "l_linenumber")


@query(f"""WITH g AS (SELECT n, px, py, {_SET} AS is_set FROM {_EDGES} e, range(96) a(px), range(54) b(py) GROUP BY n, px, py),
m AS (SELECT n, count(*) AS c, 0.5::DOUBLE * (abs(avg(px) - 48) / 48 + abs(avg(py) - 27) / 27) AS o FROM g WHERE is_set GROUP BY n)
SELECT n, round(c / 5184.0::DOUBLE, 8) AS coverage, round(CASE WHEN c >= 50 THEN o ELSE 1 END, 8) AS off_centre, round(CASE WHEN c >= 50 THEN 0.45 * c / 5184.0::DOUBLE + 0.55 * greatest(0, 1 - o) ELSE 0 END, 8) AS score FROM m""")
def mask_coverage(spark, sf_dir):
    found = masks.mask_view(_masks(spark, sf_dir), ["n"], 96, 54)
    return found.select("n", F.round("coverage", 8).alias("coverage"), F.round("offset", 8).alias("off_centre"), F.round("score", 8).alias("score"))


_STRIPS = "(SELECT l_suppkey, l_partkey % 256 AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem)"


@query(f"""SELECT l_suppkey, CAST(i // 16 AS INTEGER) AS y, CAST(count(*) AS INTEGER) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75
FROM {_STRIPS} s WHERE i < c // 16 * 16 AND i % 16 BETWEEN 2 AND 12 GROUP BY l_suppkey, i // 16""")
def strip_statistics(spark, sf_dir):
    """Statistics of the rows of a strip of each supplier's picture, whose pixels are its line items."""
    order = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    hexed = F.array_join(F.transform(order, lambda s: F.lpad(F.hex(s["l_partkey"] % 256), 2, "0")), "")
    packed = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.unhex(hexed).alias("pixels")).withColumn("width", F.lit(16))
    found = pictures.row_statistics(packed, ["l_suppkey"], "pixels", "width", 2, 13)
    return found.select("l_suppkey", "y", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "median", "p75")])


_RGB = "(SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey * 11 % 256 AS INTEGER) AS g, CAST(l_orderkey * 5 % 256 AS INTEGER) AS b FROM lineitem)"


@query(f"""WITH m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM {_RGB} c),
h AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN hi = r THEN 60.0::DOUBLE * (g - b) / d WHEN hi = g THEN 120 + 60.0::DOUBLE * (b - r) / d ELSE 240 + 60.0::DOUBLE * (r - g) / d END AS t FROM m),
o AS (SELECT *, CAST(CAST(floor(CASE WHEN t < 0 THEN t + 360 ELSE t END / 2 + 0.5) AS BIGINT) % 180 AS INTEGER) AS hue, CAST(CASE WHEN hi = 0 THEN 0 ELSE floor(255.0::DOUBLE * d / hi + 0.5) END AS INTEGER) AS saturation FROM h)
SELECT l_orderkey, l_linenumber, hue, saturation, hi AS value, g - r > 20 AND g - b > 20 AS green, hue BETWEEN 35 AND 95 AND saturation >= 40 AND hi >= 15 AS grass FROM o""")
def colour_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") * 11 % 256).cast("int").alias("g"), (F.col("l_orderkey") * 5 % 256).cast("int").alias("b"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    h, s, v = pictures.hue_saturation_value(r, g, b)
    seen = rows.select("l_orderkey", "l_linenumber", h.alias("hue"), s.alias("saturation"), v.alias("value"), pictures.is_green(r, g, b).alias("green"))
    return seen.withColumn("grass", pictures.within(F.col("hue"), F.col("saturation"), F.col("value"), (35, 40, 15), (95, 255, 255)))


def _bright_boxes():
    """A stand-in for a model: the box of each grey value of a tile, but of what its inner edges may cut."""
    import numpy as np
    import pandas as pd

    def find(batch):
        out = []
        for tile, data, w, h in zip(batch["tile"], batch["pixels"], batch["width"], batch["height"], strict=True):
            picture = np.frombuffer(data, np.uint8).reshape(h, w)
            x0, y0 = tile["x1"], tile["y1"]
            for value in np.unique(picture[picture > 0]).tolist():
                ys, xs = np.nonzero(picture == value)
                a, b, c, d = int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1
                cut = (a == 0 and x0 > 0) or (b == 0 and y0 > 0) or (c == w and x0 + w < 96) or (d == h and y0 + h < 54)
                if not cut:
                    out.append((tile, float(a), float(b), float(c), float(d), value / 255))
        return pd.DataFrame(out, columns=["tile", "x1", "y1", "x2", "y2", "conf"])

    return find


@query("SELECT s_suppkey, k, CAST((k - 1) * 32 + s_suppkey * 7 % 27 AS INTEGER) AS x1, CAST((s_suppkey * 5 + k * 11) % 51 AS INTEGER) AS y1, CAST((k - 1) * 32 + s_suppkey * 7 % 27 + 5 AS INTEGER) AS x2, CAST((s_suppkey * 5 + k * 11) % 51 + 3 AS INTEGER) AS y2 FROM supplier, range(1, 4) t(k)")
def sliced_boxes(spark, sf_dir):
    """What a stand-in model finds in tiles of pictures with three things each is what is there."""
    s = F.col("s_suppkey")

    def part(k, y):
        """A line's pixels from 32 * (k - 1) on, two hex digits each."""
        left, top = (s * 7 % 27).cast("int"), (s * 5 + k * 11) % 51
        row = F.concat(F.repeat(F.lit("00"), left), F.lit(f"{k * 60:02X}" * 5), F.repeat(F.lit("00"), F.lit(27) - left))
        return F.when((y >= top) & (y < top + 3), row).otherwise(F.lit("00" * 32))

    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(53)), lambda y: F.concat(*[part(k, y) for k in (1, 2, 3)])), "")
    # a small file makes large pictures, which one task would have to make and to cut
    spread = table(spark, sf_dir, "supplier").select("s_suppkey").repartition(spark.sparkContext.defaultParallelism)
    frames = spread.select("s_suppkey", F.unhex(hexed).alias("pixels"), F.lit(96).alias("w"), F.lit(54).alias("h"))
    found = sliced.sliced(frames, ["s_suppkey"], "pixels", "w", "h", _bright_boxes, (40, 40), channels=1, least_tile=16)
    return found.select("s_suppkey", F.round(F.col("conf") * 255 / 60).cast("bigint").alias("k"), *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""WITH v AS (SELECT width, tile, greatest(64, least(tile, width)) AS t FROM (SELECT CAST(p_size * 41 AS INTEGER) AS width, CAST(50 + p_partkey % 1000 AS INTEGER) AS tile FROM part) a),
s AS (SELECT *, greatest(32, t - CAST(floor(t * 0.2) AS INTEGER)) AS step FROM v),
g AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((width - t) / step)) AS BIGINT) + 1)) * step AS x FROM s)
SELECT DISTINCT width, tile, CAST(greatest(0, least(width, x + t) - t) AS INTEGER) AS x1, CAST(least(width, x + t) AS INTEGER) AS x2 FROM g""")
def tile_spans(spark, sf_dir):
    views = table(spark, sf_dir, "part").select((F.col("p_size") * 41).cast("int").alias("width"), (50 + F.col("p_partkey") % 1000).cast("int").alias("tile"))
    # the tile's size is a parameter in the operator; a column does as well
    return views.select("width", "tile", F.explode(sliced._spans(F.col("width"), F.col("tile"), sliced.OVERLAP, sliced.LEAST_TILE)).alias("s")).select("width", "tile", F.col("s.a").cast("int").alias("x1"), F.col("s.b").cast("int").alias("x2")).distinct()


@query()
def kmeans_seeded(spark, sf_dir):
    """Lloyd's rounds from drawn centres; the first numbers of each centre."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("feature"))
    centres = cluster.lloyd(rows, "feature", cluster.seed_centres(rows, "vec_id", "feature", 3, seed=1))
    return spark.createDataFrame([(k, *[round(v, 5) for v in c[:4]]) for k, c in enumerate(centres)], "label int, c0 double, c1 double, c2 double, c3 double")


@query("""SELECT l_orderkey, l_partkey, round(-(l_orderkey % 90 - 45.0::DOUBLE), 6) + 0.0 AS pan, round((l_suppkey % 40 - 20.0::DOUBLE) * 1.2, 6) + 0.0 AS tilt, round(CAST(l_quantity AS DOUBLE) * 1.85, 6) AS fov FROM lineitem""")
def studio_view(spark, sf_dir):
    pan, tilt, fov = geometry.studio_to_view((F.col("l_orderkey") % 90).cast("double") - 45, (F.col("l_suppkey") % 40).cast("double") - 20, F.col("l_quantity").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.round(pan, 6) + F.lit(0.0)).alias("pan"), (F.round(tilt, 6) + F.lit(0.0)).alias("tilt"), F.round(fov, 6).alias("fov"))


_ANCHORS = "(SELECT c_custkey, c_custkey % 200 + 400 AS far, c_custkey * 3 % 500 AS l, 1500 + c_custkey * 7 % 1600 AS r, c_custkey % 300 + 800 AS near FROM customer)"


@query(f"""WITH a AS (SELECT *, (l + r) // 2 AS m, (r - l) / 2.0::DOUBLE AS s FROM {_ANCHORS} x),
p AS (SELECT c_custkey, k AS idx, trunc(m - s * cos(k * pi() / 6)) AS x, trunc(far + s * 0.068 * cos(k * pi() / 6) * cos(k * pi() / 6)) AS y FROM a, range(7) t(k)
UNION ALL SELECT c_custkey, 6 + k, trunc(m + s * cos(k * pi() / 10)), trunc(far + (near - far) * 1.0::DOUBLE * sin(k * pi() / 10)) FROM a, range(1, 10) t(k))
SELECT c_custkey, idx, CAST(least(greatest(x, 0), 2879) AS INTEGER) AS x, CAST(least(greatest(y, 0), 1439) AS INTEGER) AS y FROM p""")
def pitch_polygon(spark, sf_dir):
    k = F.col("c_custkey")
    poly = geometry.half_ellipses(k % 200 + 400, k * 3 % 500, 1500 + k * 7 % 1600, k % 300 + 800, 2880, 1440)
    return table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(poly).alias("at", "p")).select("c_custkey", F.col("at").cast("bigint").alias("idx"), "p.x", "p.y")


_OUTLINE = [(100, 50), (800, 50), (900, 400), (450, 300), (100, 500)]
_ON = " OR ".join(f"(({bx} - {ax}) * (py - {ay}) = ({by} - {ay}) * (px - {ax}) AND px BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND py BETWEEN {min(ay, by)} AND {max(ay, by)})" for (ax, ay), (bx, by) in zip(_OUTLINE, _OUTLINE[1:] + _OUTLINE[:1], strict=True))
_IN = " + ".join(f"CASE WHEN ({ay} > py) <> ({by} > py) AND px < ({bx} - {ax}) * (py - {ay}) / ({by} - {ay}.0::DOUBLE) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_OUTLINE, _OUTLINE[1:] + _OUTLINE[:1], strict=True) if ay != by)


@query(f"SELECT l_orderkey, l_partkey, {_ON} OR ({_IN}) % 2 = 1 AS inside FROM (SELECT l_orderkey, l_partkey, l_partkey * 50 % 1000 AS px, l_suppkey * 50 % 550 AS py FROM lineitem) p")
def point_in_or_on_polygon(spark, sf_dir):
    """Points of a coarse grid, many of them on the outline."""
    x, y = (F.col("l_partkey") * 50 % 1000).cast("double"), (F.col("l_suppkey") * 50 % 550).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", geometry.in_or_on_polygon(x, y, geometry.polygon(_OUTLINE)).alias("inside"))


_CURVE = " OR ".join(f"pow({(1 - t / 20) ** 2!r}::DOUBLE * 100 + {2 * (1 - t / 20) * (t / 20)!r}::DOUBLE * 480 + {(t / 20) ** 2!r}::DOUBLE * 860 - px, 2) + pow({(1 - t / 20) ** 2!r}::DOUBLE * 400 + {2 * (1 - t / 20) * (t / 20)!r}::DOUBLE * 20 + {(t / 20) ** 2!r}::DOUBLE * 400 - py, 2) <= 625" for t in range(21))


@query(f"SELECT l_orderkey, l_partkey, CASE WHEN (px - 300) * (px - 300) + (py - 250) * (py - 250) <= 14400 THEN 'circle' WHEN {_CURVE} THEN 'curve' WHEN pow((px - 480) / 400.0::DOUBLE, 2) + pow((py - 270) / 200.0::DOUBLE, 2) <= 1 THEN 'ellipse' END AS shape FROM (SELECT l_orderkey, l_partkey, CAST(l_partkey % 960 AS DOUBLE) AS px, CAST(l_suppkey * 7 % 540 AS DOUBLE) AS py FROM lineitem) p")
def topmost_shape(spark, sf_dir):
    """Of an ellipse, a curve above it and a circle above both, what a point hits."""
    x, y = (F.col("l_partkey") % 960).cast("double"), (F.col("l_suppkey") * 7 % 540).cast("double")
    at = lambda px, py: F.struct(F.lit(px).alias("x"), F.lit(py).alias("y"))
    hits = [("ellipse", geometry.in_ellipse(x, y, F.lit(480.0), F.lit(270.0), 400.0, 200.0)), ("curve", geometry.near_bezier(x, y, at(100.0, 400.0), at(480.0, 20.0), at(860.0, 400.0), 25.0)), ("circle", geometry.in_circle(x, y, F.lit(300.0), F.lit(250.0), 120.0))]
    listed = F.array(*[F.struct(F.lit(n).alias("id"), h.alias("hit")) for n, h in hits])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", shapes.topmost(listed).alias("shape"))


@query("SELECT c_custkey, list_sort([c_custkey % 5, c_custkey % 7 + 2, c_custkey % 11, c_custkey % 9 + 1]) AS times FROM customer")
def sorted_insert(spark, sf_dir):
    k = F.col("c_custkey")
    one = lambda v: F.struct(v.alias("t"))
    items = F.array_sort(F.array(one(k % 5), one(k % 7 + 2), one(k % 11)))
    added = relational.insert_sorted(items, one(k % 9 + 1), "t")
    return table(spark, sf_dir, "customer").select("c_custkey", F.transform(added, lambda x: x["t"]).alias("times"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def patch_to_null(spark, sf_dir):
    """A change sets the columns it names, to null as well."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    sets = F.when(F.col("o_orderkey") % 14 == 0, F.array(F.lit("o_orderstatus"), F.lit("o_orderpriority"))).otherwise(F.array(F.lit("o_orderstatus")))
    changes = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("P").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"), sets.alias("sets"))
    return relational.patch(o, changes, "o_orderkey", ["o_orderstatus", "o_orderpriority"], "sets")


@query("""WITH p AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN epoch(ts) - 9000 ELSE epoch(ts) END AS t FROM events),
s AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM p), m AS (SELECT event_id AS mark_id, user_id, epoch(ts) - 100 AS mark FROM events WHERE event_type = 'click')
SELECT user_id, mark_id, min(event_id) AS passed_event_id FROM s JOIN m USING (user_id) WHERE mark > prev AND mark <= t AND t - prev > 0 AND t - prev < 40000 GROUP BY user_id, mark_id""")
def first_crossing(spark, sf_dir):
    """Marks passed by positions that often go back; each counts where it is passed first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    positions = e.select("event_id", "user_id", (F.col("us") / 1e6 - F.when(F.col("event_id") % 3 == 0, 9000).otherwise(F.lit(0))).alias("t"))
    marks = e.where("event_type = 'click'").select(F.col("event_id").alias("mark_id"), "user_id", (F.col("us") / 1e6 - 100).alias("mark"))
    return series.first_crossings(positions, marks, ["user_id"], ["event_id"], "t", "mark", "mark_id", 40000.0, 40000.0).select("user_id", "mark_id", "passed_event_id")


_SCANS = """(SELECT c_custkey, (k - 4) * 10 AS yaw, CASE WHEN (c_custkey + k) % 3 > 0 THEN c_custkey * 17 % 1280 + k * 0.5::DOUBLE END AS bx, (c_custkey * 7 + k * 13) % 64 / 64.0::DOUBLE AS conf, (c_custkey + k * 3) % 9 AS n, CASE WHEN (c_custkey + k) % 4 > 0 THEN (c_custkey * 31 + k * 97) % 1280 + 0.5::DOUBLE END AS cx FROM customer, range(9) t(k))"""
_ANGLE = "yaw + degrees(atan(({x} - 640) / 640 * tan(radians(50.0))))"


@query(f"""SELECT c_custkey, round(coalesce(arg_min({_ANGLE.format(x="bx")}, yaw) FILTER (conf >= 0.6 AND abs(bx - 640) / 640 < 0.4), arg_max({_ANGLE.format(x="cx")}, (n * (1 - abs(cx - 640) / 640), {_ANGLE.format(x="cx")})) FILTER (n >= 4 AND cx IS NOT NULL), 0), 6) + 0.0 AS start FROM {_SCANS} s GROUP BY c_custkey""")
def warm_start_scan(spark, sf_dir):
    """Nine directions a customer: a sure ball near the middle, else the best cluster, else straight ahead."""
    c = F.col("c_custkey")
    spread = table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    rows = spread.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    k = F.col("k")
    scans = rows.select(
        "c_custkey",
        ((k - 4) * 10).alias("yaw"),
        F.when((c + k) % 3 > 0, c * 17 % 1280 + k * 0.5).alias("bx"),
        ((c * 7 + k * 13) % 64 / 64.0).alias("conf"),
        ((c + k * 3) % 9).alias("n"),
        F.when((c + k) % 4 > 0, (c * 31 + k * 97) % 1280 + 0.5).alias("cx"),
    )
    found = relational.warm_start(scans, ["c_custkey"], "yaw", ("bx", "conf"), "n", "cx", 100.0, 1280.0)
    return found.select("c_custkey", (F.round("start", 6) + F.lit(0.0)).alias("start"))


@query("""WITH t AS (SELECT c_custkey, k, k % 7 - 3 AS dyaw, k // 7 - 2 AS dpitch, k = 17 AS now, (c_custkey * 13 + k * 29) % 128 / 128.0::DOUBLE AS cov, (c_custkey * 5 + k * 11) % 64 / 128.0::DOUBLE AS o FROM customer, range(35) t(k)),
s AS (SELECT *, 0.45::DOUBLE * cov + 0.55::DOUBLE * (1 - o) AS score FROM t),
b AS (SELECT c_custkey, score AS top, dyaw AS y, dpitch AS p FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, dyaw, dpitch) AS r FROM s WHERE NOT now) x WHERE r = 1)
SELECT c_custkey, CASE WHEN (cov < 0.18 OR o > 0.22) AND top > score THEN y ELSE dyaw END AS dyaw, CASE WHEN (cov < 0.18 OR o > 0.22) AND top > score THEN p ELSE dpitch END AS dpitch FROM s JOIN b USING (c_custkey) WHERE now""")
def guarded_grid_search(spark, sf_dir):
    """The best of 35 views, but only where the present one shows too little or is off the middle."""
    c, k = F.col("c_custkey"), F.col("k")
    # a small file makes many rows, which one task would have to make
    spread = table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    rows = spread.select("c_custkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(34).cast("bigint"))).alias("k"))
    cov, off = (c * 13 + k * 29) % 128 / 128.0, (c * 5 + k * 11) % 64 / 128.0
    tried = rows.select("c_custkey", (k % 7 - 3).alias("dyaw"), (F.floor(k / 7) - 2).alias("dpitch"), (k == 17).alias("now"), cov.alias("cov"), off.alias("o"), (0.45 * cov + 0.55 * (1 - off)).alias("score"))
    return relational.improved(tried, ["c_custkey"], "now", "score", "cov", "o", ["dyaw", "dpitch"], ["dyaw", "dpitch"])


_BOX_SQL = "(SELECT l_orderkey, l_linenumber, CAST(l_partkey % 90 AS DOUBLE) AS ax, CAST(l_suppkey % 50 AS DOUBLE) AS ay, CAST(l_partkey % 90 + l_partkey % 7 * 0.25 AS DOUBLE) AS bx, CAST(l_suppkey % 50 + l_suppkey % 5 * 0.5 AS DOUBLE) AS b_y, l_partkey % 4 * 0.5::DOUBLE AS w, l_suppkey % 3 + 0.25::DOUBLE AS h FROM lineitem)"
_FLOORED = "round(CASE WHEN i > 0 THEN i / (2 * greatest({least}, w * h) - i + {more}) ELSE 0 END, 8) + 0.0"


@query(f"""SELECT l_orderkey, l_linenumber, {_FLOORED.format(least="1.0::DOUBLE", more="0")} AS one, {_FLOORED.format(least="0.0::DOUBLE", more="1e-9::DOUBLE")} AS none, {_FLOORED.format(least="1e-9::DOUBLE", more="1e-9::DOUBLE")} AS slight
FROM (SELECT *, greatest(0, least(ax + w, bx + w) - greatest(ax, bx)) * greatest(0, least(ay + h, b_y + h) - greatest(ay, b_y)) AS i FROM {_BOX_SQL} b) c""")
def iou_floors(spark, sf_dir):
    """The overlap of small boxes by the three ways to count their areas."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    w, h = p % 4 * 0.5, q % 3 + 0.25
    box = lambda x, y: F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + w).cast("double").alias("x2"), (y + h).cast("double").alias("y2"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box(p % 90, q % 50).alias("a"), box(p % 90 + p % 7 * 0.25, q % 50 + q % 5 * 0.5).alias("b"))
    ways = {"one": (1.0, 0.0), "none": (0.0, 1e-9), "slight": (1e-9, 1e-9)}
    return rows.select("l_orderkey", "l_linenumber", *[(F.round(geometry.iou_floored(F.col("a"), F.col("b"), *v), 8) + F.lit(0.0)).alias(n) for n, v in ways.items()])


@query("""SELECT l_orderkey, l_linenumber, least(greatest(l_partkey % 100, l_suppkey % 40 - 15), l_suppkey % 40 + 15)::DOUBLE AS held, (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (
SELECT *, CAST(greatest(0, floor(CAST(l_quantity AS DOUBLE) * 7.25 - 20 + 0.5)) AS BIGINT) AS s FROM lineitem) l""")
def held_and_clock(spark, sf_dir):
    held = geometry.clamp_around((F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 40).cast("double"), 15.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", held.alias("held"), text.clock_rounded(F.col("l_quantity").cast("double") * 7.25 - 20).alias("clock"))
