"""Column functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions import geometry as g
from kickframe.functions import text as x
from kickframe.plans.registry import query, table

#: Pixel coordinates made of the line items, in a view of 960 by 540.
_LI = "(SELECT row_number() OVER () AS ignored, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CAST(l_partkey % 960 AS DOUBLE) AS px, CAST(l_suppkey * 7 % 540 AS DOUBLE) AS py, CAST(l_orderkey % 90 AS DOUBLE) - 45 AS yaw FROM lineitem)"


def _pixels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_partkey") % 960).cast("double").alias("px"), (F.col("l_suppkey") * 7 % 540).cast("double").alias("py"), ((F.col("l_orderkey") % 90).cast("double") - 45).alias("yaw"))


def _r(c, name, places=6):
    # adding zero makes a negative zero positive
    return (F.round(c, places) + F.lit(0.0)).alias(name)


_T = "tan(radians(30.0))"


@query(f"SELECT l_orderkey, l_partkey, round(degrees(atan((px - 480) / 480 * {_T})) + yaw, 6) + 0.0 AS lon FROM {_LI} l")
def pixel_to_lon(spark, sf_dir):
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", _r(g.pixel_to_lon(F.col("px"), 960.0, F.col("yaw"), 60.0), "lon"))


@query(f"SELECT l_orderkey, l_partkey, round(degrees(atan((px - 480) / 480 * {_T})) + yaw, 6) + 0.0 AS lon, round(degrees(atan((py - 270) / 270 * tan(radians(30.0) * (540.0::DOUBLE / 960)))) + 2, 6) + 0.0 AS lat FROM {_LI} l")
def pixel_to_lonlat(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    return p.select("l_orderkey", "l_partkey", _r(g.pixel_to_lon(F.col("px"), 960.0, F.col("yaw"), 60.0), "lon"), _r(g.pixel_to_lat(F.col("py"), 960.0, 540.0, F.lit(2.0), 60.0), "lat"))


@query(f"SELECT l_orderkey, l_partkey, round(yaw + degrees(atan((px / 960 - 0.5) * 2 * {_T})), 6) + 0.0 AS pan, round(5 - degrees(atan((py / 540 - 0.5) * 2 * {_T} * (540.0::DOUBLE / 960))), 6) + 0.0 AS tilt FROM {_LI} l")
def eq_pan_tilt(spark, sf_dir):
    pan, tilt = g.eq_pan_tilt(F.col("px"), F.col("py"), 960.0, 540.0, F.col("yaw"), F.lit(5.0), 60.0)
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", _r(pan, "pan"), _r(tilt, "tilt"))


@query(f"SELECT l_orderkey, l_partkey, round(2 * degrees(atan(l_quantity / 960 * {_T})), 6) AS size_deg FROM {_LI} l")
def angular_size(spark, sf_dir):
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", _r(g.angular_size(F.col("l_quantity"), 960.0, 60.0), "size_deg"))


_V = f"(SELECT *, cos(radians(py / 6 - 45)) * sin(radians(yaw)) AS vx, sin(radians(py / 6 - 45)) AS vy, cos(radians(py / 6 - 45)) * cos(radians(yaw)) AS vz FROM {_LI} l)"


@query(f"SELECT l_orderkey, l_partkey, round(vx, 6) + 0.0 AS x, round(vy, 6) + 0.0 AS y, round(vz, 6) + 0.0 AS z FROM {_V} v")
def unit_vector(spark, sf_dir):
    v = _pixels(spark, sf_dir).withColumn("v", g.unit_vector(F.col("yaw"), F.col("py") / 6 - 45))
    return v.select("l_orderkey", "l_partkey", *[_r(F.col("v")[c], c) for c in "xyz"])


@query(f"""SELECT l_orderkey, l_partkey, CASE WHEN z > 1e-6 THEN round(480 + (480 / tan(radians(50.0))) * rx / z, 4) + 0.0 END AS sx, CASE WHEN z > 1e-6 THEN round(270 - (480 / tan(radians(50.0))) * y / z, 4) + 0.0 END AS sy FROM (
SELECT *, vy * cos(radians(-12.0)) - z1 * sin(radians(-12.0)) AS y, vy * sin(radians(-12.0)) + z1 * cos(radians(-12.0)) AS z FROM (SELECT *, vx * cos(radians(20.0)) - vz * sin(radians(20.0)) AS rx, vx * sin(radians(20.0)) + vz * cos(radians(20.0)) AS z1 FROM {_V} v) a) b""")
def project_point(spark, sf_dir):
    v = _pixels(spark, sf_dir).withColumn("v", g.unit_vector(F.col("yaw"), F.col("py") / 6 - 45))
    sx, sy = g.project(F.col("v"), 20.0, -12.0, 100.0, 960.0, 540.0)
    return v.select("l_orderkey", "l_partkey", _r(sx, "sx", 4), _r(sy, "sy", 4))


_POLY = [(101.5, 50.5), (800.5, 80.5), (900.5, 400.5), (450.5, 300.5), (60.5, 500.5)]
_CROSS = " + ".join(f"CASE WHEN ({ay} > py) <> ({by} > py) AND px < ({bx} - {ax}) * (py - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_POLY, _POLY[1:] + _POLY[:1]))


@query(f"SELECT l_orderkey, l_partkey, ({_CROSS}) % 2 = 1 AS inside FROM {_LI} l")
def point_in_polygon(spark, sf_dir):
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", g.point_in_polygon(F.col("px"), F.col("py"), g.polygon(_POLY)).alias("inside"))


_H = [1.2, 0.1, -30.0, 0.05, 1.5, 12.0, 0.0002, 0.0007, 1.0]


@query(f"SELECT l_orderkey, l_partkey, round((1.2 * px + 0.1 * py - 30) / (0.0002 * px + 0.0007 * py + 1), 5) + 0.0 AS hx, round((0.05 * px + 1.5 * py + 12) / (0.0002 * px + 0.0007 * py + 1), 5) + 0.0 AS hy FROM {_LI} l")
def homography_apply(spark, sf_dir):
    hx, hy = g.homography(F.col("px"), F.col("py"), _H)
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", _r(hx, "hx", 5), _r(hy, "hy", 5))


@query(f"SELECT l_orderkey, l_partkey, round((1 - t) * (1 - t) * 10 + 2 * (1 - t) * t * px + t * t * 900, 6) AS bx FROM (SELECT *, l_quantity / 64 AS t FROM {_LI} l) a")
def bezier_point(spark, sf_dir):
    t = F.col("l_quantity") / 64
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", _r(g.bezier(F.lit(10.0), F.col("px"), F.lit(900.0), t), "bx"))


@query(f"""SELECT l_orderkey, l_partkey, round(sqrt((px - (100 + t * 700)) * (px - (100 + t * 700)) + (py - (50 + t * 400)) * (py - (50 + t * 400))), 5) AS distance FROM (SELECT *, least(greatest(((px - 100) * 700 + (py - 50) * 400) / 650000.0::DOUBLE, 0.0), 1.0) AS t FROM {_LI} l) a""")
def segment_distance(spark, sf_dir):
    ends = [F.lit(v) for v in (100.0, 50.0, 800.0, 450.0)]
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", _r(g.segment_distance(F.col("px"), F.col("py"), *ends), "distance", 5))


@query(f"""SELECT l_orderkey, l_partkey, (px - 480) / 300.5 * ((px - 480) / 300.5) + (py - 270) / 150.5 * ((py - 270) / 150.5) <= 1 AS in_ellipse,
sqrt((px - 480.5) * (px - 480.5) + (py - 270.25) * (py - 270.25)) <= 250 AND abs(atan2(sin(atan2(py - 270.25, px - 480.5) - 0.7), cos(atan2(py - 270.25, px - 480.5) - 0.7))) <= 0.55 AS in_cone FROM {_LI} l""")
def shape_hit_test(spark, sf_dir):
    px, py = F.col("px"), F.col("py")
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", g.in_ellipse(px, py, F.lit(480.0), F.lit(270.0), 300.5, 150.5).alias("in_ellipse"), g.in_cone(px, py, F.lit(480.5), F.lit(270.25), 0.7, 250.0, 1.1).alias("in_cone"))


@query(f"SELECT l_orderkey, l_partkey, round(abs(px - 480) / 480, 6) AS edge, round(least(greatest(100 + (px - 100) / 700 * 50, 100.0), 150.0), 6) AS scaled, round(yaw + least(greatest(10 - yaw, -3.0), 3.0), 6) + 0.0 AS stepped FROM {_LI} l")
def clamps_and_scales(spark, sf_dir):
    return _pixels(spark, sf_dir).select("l_orderkey", "l_partkey", _r(g.edge_distance(F.col("px"), 960.0), "edge"), _r(g.scale_between(F.col("px"), 100, 800, 100, 150), "scaled"), _r(g.soft_step(F.col("yaw"), F.lit(10.0), 3.0), "stepped"))


@query("""SELECT polygon, round((90 - far + 90 - near) / 2 * 1.2, 8) + 0.0 AS tilt, round(least(greatest(abs(near - far) * 1.85, 100.0), 130.0), 8) AS fov FROM (
SELECT polygon, list_sum(list_transform(ys[1:7], lambda v: v / 1440 * 180)) / len(ys[1:7]) AS far, list_sum(list_transform(ys[8:], lambda v: v / 1440 * 180)) / len(ys[8:]) AS near FROM (
SELECT c_custkey // 16 AS polygon, list(CAST(c_custkey * 37 % 1440 AS DOUBLE) ORDER BY c_custkey) AS ys FROM customer GROUP BY c_custkey // 16 HAVING count(*) > 8) b) c""")
def polygon_view(spark, sf_dir):
    """Every customer is a corner of one polygon; one of eight corners or fewer has no near side."""
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 16").alias("polygon"), F.struct("c_custkey", (F.col("c_custkey") * 37 % 1440).cast("double").alias("y")).alias("corner"))
    ys = c.groupBy("polygon").agg(F.transform(F.sort_array(F.collect_list("corner")), lambda s: s["y"]).alias("ys")).where(F.size("ys") > 8)
    tilt, fov = g.polygon_view(F.col("ys"), 1440.0)
    return ys.select("polygon", _r(tilt, "tilt", 8), _r(fov, "fov", 8))


#: Frame names of every kind: whole, exported with a hash, of another camera, without a mark.
_NAME = """CASE WHEN o_orderkey % 7 = 0 THEN 'CAM' ELSE 'VID' END || '_20241028_143616_' || CAST(o_custkey % 7 AS VARCHAR) || '_010_t' || CAST(o_orderkey % 400 AS VARCHAR) || '_yaw' ||
CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END || CAST(o_orderkey % 45 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '_neg' ELSE '_det' END ||
CASE WHEN o_orderkey % 3 = 0 THEN '_jpg.rf.0af3.jpg' WHEN o_orderkey % 3 = 1 THEN '.jpg' ELSE '' END"""
_FRAME = "'^(VID_[0-9]+_[0-9]+_[0-9]+_[0-9]+)_t([0-9]+)_yaw([+-]?[0-9]+)_(det|neg)'"


@query(f"""SELECT o_orderkey, nullif(regexp_extract(s, {_FRAME}, 1), '') AS clip, CAST(nullif(regexp_extract(s, {_FRAME}, 2), '') AS DOUBLE) AS t, CAST(nullif(regexp_extract(s, {_FRAME}, 3), '') AS DOUBLE) AS yaw
FROM (SELECT o_orderkey, regexp_replace(regexp_replace({_NAME}, '[.][^./]*$', ''), '_jpg[.]rf[.][a-f0-9]+$', '') AS s FROM orders) a""")
def regex_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_NAME.replace('AS VARCHAR', 'AS STRING')} AS name")
    return o.select("o_orderkey", x.parse_frame_name(F.col("name")).alias("p")).select("o_orderkey", "p.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST(floor(epoch(CAST(o_orderdate AS TIMESTAMP)) / 60) AS BIGINT) AS VARCHAR) END AS sequence FROM orders""")
def sequence_of_file(spark, sf_dir):
    """Files named by number, and some that are known only by the time of their last change."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 < 3, F.concat(F.lit("VID_00_"), F.lpad((k % 1000).cast("string"), 3, "0"), F.when(k % 2 == 0, ".insv").otherwise(""))).otherwise(F.concat(F.lit("clip"), k.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", x.sequence_key(name, F.col("o_orderdate").cast("timestamp")).alias("sequence"))


_URL = """CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(page_id AS VARCHAR), 11, 'aZ_-') || '&t=3' WHEN 1 THEN 'https://youtu.be/' || lpad(CAST(page_id AS VARCHAR), 11, 'b')
WHEN 2 THEN 'http://youtube.com/embed/' || lpad(CAST(page_id AS VARCHAR), 11, '-9') WHEN 3 THEN 'https://example.org/watch?v=' || lpad(CAST(page_id AS VARCHAR), 11, 'c') ELSE url END"""


@query(f"""SELECT page_id, coalesce(nullif(regexp_extract(u, 'youtube[.]com/watch[?]v=([a-zA-Z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(u, 'youtu[.]be/([a-zA-Z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(u, 'youtube[.]com/embed/([a-zA-Z0-9_-]{{11}})', 1), '')) AS video_id
FROM (SELECT page_id, {_URL} AS u FROM pages) a""")
def url_video_id(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_URL.replace('AS VARCHAR', 'AS STRING')} AS u")
    return pages.select("page_id", x.video_id(F.col("u")).alias("video_id"))


@query("SELECT p_partkey, regexp_replace(p_name || ' É.' || p_brand, '[^\\p{L}\\p{N}_\\-]', '_', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.slug(F.concat("p_name", F.lit(" É."), "p_brand")).alias("slug"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || '  ' || p_brand), '\\s+', '_', 'g') AS slug FROM part")
def place_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.place_slug(F.concat("p_name", F.lit("  "), "p_brand")).alias("slug"))


@query("SELECT o_orderkey, CAST(CAST(floor(floor(o_totalprice / 100) / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(o_totalprice / 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM orders")
def time_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", x.clock(F.col("o_totalprice") / 100).alias("clock"))


@query("SELECT o_orderkey, CASE WHEN m < 1 THEN '~' || CAST(CAST(floor(m * 60) AS BIGINT) AS VARCHAR) || 's' ELSE '~' || CAST(CAST(floor(m) AS BIGINT) AS VARCHAR) || 'min' END AS duration FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / 170.0 AS m FROM orders) a")
def size_to_duration(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", x.size_to_duration(F.col("o_custkey").cast("double")).alias("duration"))


_LABEL = "CASE o_orderkey % 6 WHEN 0 THEN 'goal_home' WHEN 1 THEN 'shot_away' WHEN 2 THEN 'tactical' WHEN 3 THEN 'setpiece_home' WHEN 4 THEN 'other' ELSE 'tactical_x' END"


def _labelled(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    label = F.when(k == 0, "goal_home").when(k == 1, "shot_away").when(k == 2, "tactical").when(k == 3, "setpiece_home").when(k == 4, "other").otherwise("tactical_x")
    return table(spark, sf_dir, "orders").withColumn("label", label)


@query(f"SELECT o_orderkey, label, CASE WHEN starts_with(label, 'goal') THEN 'goal' WHEN starts_with(label, 'shot') THEN 'shot' WHEN starts_with(label, 'setpiece') THEN 'setpiece' WHEN label = 'tactical' THEN label END AS grp, CASE WHEN label LIKE '%\\_home' ESCAPE '\\' THEN 'home' WHEN label LIKE '%\\_away' ESCAPE '\\' THEN 'away' END AS team FROM (SELECT o_orderkey, {_LABEL} AS label FROM orders) a")
def label_case(spark, sf_dir):
    return _labelled(spark, sf_dir).select("o_orderkey", "label", x.label_group(F.col("label")).alias("grp"), x.label_team(F.col("label")).alias("team"))


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_LABEL} AS label FROM orders) a WHERE label NOT LIKE 'shot%'")
def label_prefix_filter(spark, sf_dir):
    """Labels of the groups that are switched on; a label of no group passes."""
    on = {"goal": True, "shot": False, "setpiece": True, "tactical": True}
    group = x.label_group(F.col("label"))
    passes = F.coalesce(*[F.when(group == k, F.lit(v)) for k, v in on.items()], F.lit(True))
    return _labelled(spark, sf_dir).where(passes).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS band, CASE WHEN n < 4 THEN 0.0 ELSE round(least((n - 4) / 12.0::DOUBLE, 1.0), 2) END AS from_points FROM (SELECT o_orderkey, o_orderkey % 100 / 100.0::DOUBLE AS c, o_orderkey % 20 AS n FROM orders) a")
def confidence_bands(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.confidence_band((k % 100) / 100.0).alias("band"), x.points_confidence(k % 20).alias("from_points"))


@query("SELECT o_orderkey, 'c' || CAST(o_custkey AS VARCHAR) || '_t' || CAST(o_orderkey % 400 AS VARCHAR) || '_yaw' || CASE WHEN o_orderkey % 91 - 45 >= 0 THEN '+' ELSE '' END || CAST(o_orderkey % 91 - 45 AS VARCHAR) AS tag, nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE ' ' || o_orderstatus END), '') AS status FROM orders")
def string_building(spark, sf_dir):
    k = F.col("o_orderkey")
    tag = x.signed_tag(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), k % 400, k % 91 - 45)
    return table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("tag"), x.blank_to_null(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderstatus"))).alias("status"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def variant_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, round(degrees(value / 100), 6) AS deg, round(radians(value), 6) AS rad FROM events")
def units_and_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.round(F.degrees(F.col("value") / 100), 6).alias("deg"), F.round(F.radians("value"), 6).alias("rad"))
