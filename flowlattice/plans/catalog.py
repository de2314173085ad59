"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

import uuid

from pyspark.sql import functions as F

from flowlattice.functions import geometry as g, labels
from flowlattice.operators import (
    calibration, crossings, filters, headings as heading_ops, heat, lives, overlaps,
    report, routes as route_ops, scoring, shape, site_rules, tiles, tracker, zones as zone_ops)
from flowlattice.plans import oracle as sql, replay, summary, views
from flowlattice.schemas import SITE_CONFIG
from flowlattice.session import shared_dir
from flowlattice.sources import detections as source, run_files, sinks, site
from flowlattice.streaming import flows, totals, tracks as live_tracks

QUERIES, ORACLES = {}, {}

# Fixed values of the flow queries.
CONF_PER_CLASS = {"truck": 0.15, "bus": 0.20}
LIMITS = {"min_area": 200, "max_width": 60}
EXCLUSION = {"parking": [(320, 100), (360, 100), (360, 130), (320, 130)]}
ZONE_NAMES = list(views.ZONES)


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def kept(spark, folder):
    return filters.filter_detections(
        views.observations(spark, folder), 0.10, CONF_PER_CLASS, LIMITS, EXCLUSION)


def zoned(spark, folder):
    return zone_ops.zone_of_point(kept(spark, folder), views.ZONES)


def lived(spark, folder, first=(), prev=()):
    return lives.with_lives(
        kept(spark, folder), first, prev, total_frames=views.total_frames(spark, folder))


def run_ends(spark, folder):
    """The last frame of every run, from its metadata."""
    return views.runs(spark, folder).withColumnRenamed("total_frames", "last_frame_of_run")


def lived_in_zones(spark, folder):
    return lives.with_lives(zoned(spark, folder), prev=("zone_order",),
                            total_frames=views.total_frames(spark, folder))


def routes_of(spark, folder, rows, **options):
    return route_ops.zone_routes(
        rows, ZONE_NAMES, total_frames=views.total_frames(spark, folder), **options)


def routes(spark, folder, **options):
    return routes_of(spark, folder, lived_in_zones(spark, folder), **options)


def events(spark, folder):
    return route_ops.completed(routes(spark, folder))


@query("od_by_class", sql.q(sql.routes_cte(), """
SELECT run_id, camera_id, origin, destination, cls, count(*) AS cnt, CAST(grouping(cls) AS TINYINT) AS is_total
FROM routes GROUP BY GROUPING SETS ((run_id, camera_id, origin, destination), (run_id, camera_id, origin, destination, cls))"""))
def od_by_class(spark, folder):
    return summary.od_by_class(events(spark, folder))


@query("zone_routes", sql.q(sql.routes_cte(), "SELECT * FROM states"))
def zone_routes(spark, folder):
    return routes(spark, folder)


@query("zone_routes_immediate", sql.q(sql.routes_cte(2, 2, True), "SELECT * FROM states"))
def zone_routes_immediate(spark, folder):
    return routes(spark, folder, min_origin=2, min_dest=2, direct="immediate")


# --- sources and projections -------------------------------------------------------------------

@query("scan_detections", sql.q(sql.DET, "SELECT * FROM det"))
def scan_detections(spark, folder):
    return views.detections(spark, folder)


@query("sample_frames", sql.q(sql.OBS, """
SELECT run_id, camera_id, track_id, frame, CAST(greatest(0, least(399, frame - 1)) AS BIGINT) AS frame_index
FROM obs WHERE frame <= 390 AND (frame - 1) % 5 = 0"""))
def sample_frames(spark, folder):
    rows = source.every_kth_frame(source.first_frames(views.observations(spark, folder), 390), 5)
    index = source.clamped_frame(F.col("frame") - 1, F.lit(400).cast("bigint"))
    return rows.select("run_id", "camera_id", "track_id", "frame", index.alias("frame_index"))


@query("box_features", sql.q(sql.OBS, """
SELECT event_id, CAST(floor((x1+x2)/2.0) AS INTEGER) AS cx, CAST(floor((y1+y2)/2.0) AS INTEGER) AS cy,
 (x1+x2)/2.0::DOUBLE AS mx, (y1+y2)/2.0::DOUBLE AS my,
 CAST(greatest(1, x2-x1) AS BIGINT) AS w, CAST(greatest(1, y2-y1) AS BIGINT) AS h,
 CAST(greatest(1, x2-x1) * greatest(1, y2-y1) AS BIGINT) AS area,
 round(greatest(1, x2-x1) / CAST(greatest(1, y2-y1) AS DOUBLE), 6) AS aspect,
 round(greatest(x2-x1, y2-y1) / CAST(least(x2-x1, y2-y1) AS DOUBLE), 6) AS elongation
FROM obs"""))
def box_features(spark, folder):
    b = g.box()
    (cx, cy), (mx, my), f = g.centroid(b), g.center(b), g.box_features(b)
    return views.observations(spark, folder).select(
        "event_id", cx.alias("cx"), cy.alias("cy"), mx.alias("mx"), my.alias("my"),
        f["w"].alias("w"), f["h"].alias("h"), f["area"].alias("area"),
        F.round(f["aspect"], 6).alias("aspect"), F.round(f["elongation"], 6).alias("elongation"))


@query("class_lookup", """
WITH names AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, '{n}')" for i, n in enumerate(labels.CLASS_NAMES)) + """) t(id, name)),
ids AS (SELECT event_id, CAST(event_id % 95 AS INTEGER) AS class_id,
  0.05 + ((event_id * 7919) % 90) / CAST(100 AS DOUBLE) AS conf FROM events)
SELECT event_id, coalesce(name, '') AS plain, coalesce(name, 'car') AS tracked, coalesce(name, '?') AS calibration,
 CASE class_id WHEN 2 THEN 'car' WHEN 3 THEN 'moto' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' END AS short,
 floor(conf * 100.0) / 100.0 AS conf_floor
FROM ids LEFT JOIN names ON id = class_id""")
def class_lookup(spark, folder):
    class_id = (F.col("event_id") % 95).cast("int")
    conf = F.lit(0.05) + F.pmod(F.col("event_id") * 7919, F.lit(90)) / F.lit(100.0)
    return views.table(spark, folder, "events").select(
        "event_id", *(labels.class_name(class_id, p).alias(p) for p in labels.UNKNOWN_CLASS),
        labels.short_label(class_id).alias("short"),
        labels.floor_confidence(conf).alias("conf_floor"))


@query("crop_to_frame", sql.q(sql.DET, """
SELECT camera_id, frame, det_idx, CAST(trunc(x1 / (1 + det_idx * 0.5::DOUBLE)) AS INTEGER) + 30 AS x1,
 CAST(trunc(y1 / (1 + det_idx * 0.5::DOUBLE)) AS INTEGER) + 7 AS y1,
 CAST(trunc(x2 / (1 + det_idx * 0.5::DOUBLE)) AS INTEGER) + 30 AS x2,
 CAST(trunc(y2 / (1 + det_idx * 0.5::DOUBLE)) AS INTEGER) + 7 AS y2 FROM det"""))
def crop_to_frame(spark, folder):
    scale = F.lit(1.0) + F.col("det_idx") * F.lit(0.5)
    moved = g.crop_to_frame(g.box(), scale, F.lit(30), F.lit(7))
    return views.detections(spark, folder).select(
        "camera_id", "frame", "det_idx", *(c.alias(n) for c, n in zip(moved, ("x1", "y1", "x2", "y2"))))


@query("crop_window", sql.q(sql.DET, """
SELECT camera_id, frame, det_idx,
 CAST(greatest(0, x1 - greatest(24, floor((x2-x1)*0.75))) AS BIGINT) AS cx1,
 CAST(greatest(0, y1 - greatest(24, floor((y2-y1)*0.75))) AS BIGINT) AS cy1,
 CAST(least(240, x2 + greatest(24, floor((x2-x1)*0.75))) AS BIGINT) AS cx2,
 CAST(least(90, y2 + greatest(24, floor((y2-y1)*0.75))) AS BIGINT) AS cy2,
 round(greatest(1.0::DOUBLE, least(4.0::DOUBLE, 160.0::DOUBLE / least(x2-x1, y2-y1))), 6) AS scale FROM det"""))
def crop_window(spark, folder):
    window = g.crop_window(g.box(), F.lit(240), F.lit(90))
    return views.detections(spark, folder).select(
        "camera_id", "frame", "det_idx",
        *(c.cast("bigint").alias(n) for c, n in zip(window, ("cx1", "cy1", "cx2", "cy2"))),
        F.round(g.upscale_factor(g.box()), 6).alias("scale"))


@query("fmt_duration", """
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
 WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text
FROM (SELECT o_orderkey, CAST((o_orderkey * 37) % 9000 AS BIGINT) AS s FROM orders)""")
def fmt_duration(spark, folder):
    return views.table(spark, folder, "orders").select(
        "o_orderkey", labels.duration_text((F.col("o_orderkey") * 37) % 9000).alias("text"))


@query("zone_geometry", """
WITH z AS (SELECT c_custkey AS k, unnest([0,1,2,3,4]) AS i FROM customer),
p AS (SELECT k, i, CASE i WHEN 0 THEN k%50 WHEN 1 THEN k%50+100+k%17 WHEN 2 THEN k%50+120 WHEN 3 THEN k%50+40
   ELSE k%50-20 END AS x,
  CASE i WHEN 0 THEN k%30 WHEN 1 THEN k%30+k%11 WHEN 2 THEN k%30+90 WHEN 3 THEN k%30+60+k%13 ELSE k%30+80 END AS y
  FROM z)
SELECT a.k AS zone_id, abs(sum(a.x*b.y - b.x*a.y))/2.0::DOUBLE AS area,
 CAST(trunc(sum(a.x)/5.0) AS INTEGER) AS label_x, CAST(trunc(sum(a.y)/5.0) AS INTEGER) AS label_y
FROM p a JOIN p b ON a.k = b.k AND b.i = (a.i + 1) % 5 GROUP BY a.k""")
def zone_geometry(spark, folder):
    return zone_ops.zone_geometry(views.drawn_zones(spark, folder)).drop("ring")


# --- filters ---------------------------------------------------------------------------------

@query("filter_detections", sql.q(sql.FLT, "SELECT event_id, cls, conf FROM flt"))
def filter_detections(spark, folder):
    return kept(spark, folder).select("event_id", "cls", "conf")


@query("filter_tracked", sql.q(sql.FLT, "SELECT event_id, cls, conf, track_id FROM flt WHERE event_id % 7 <> 0 AND event_id % 11 <> 0"))
def filter_tracked(spark, folder):
    """Observations of which some have no id yet (null) or a lost one (negative)."""
    given = F.when(F.col("event_id") % 7 == 0, -F.col("track_id") - 1).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("track_id"))
    rows = views.observations(spark, folder).withColumn("track_id", given)
    return filters.filter_tracked(rows, 0.10, CONF_PER_CLASS, LIMITS, EXCLUSION).select("event_id", "cls", "conf", "track_id")


@query("filter_by_settings", sql.q(sql.OBS, """
SELECT event_id FROM obs WHERE cls IN ('car','truck','bus','motorbike')
 AND conf >= CASE WHEN camera_id = 3 THEN {floor}::DOUBLE WHEN camera_id = 1 AND cls = 'bus' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE + camera_id * 0.1::DOUBLE END
 AND (x2-x1)*(y2-y1) >= CASE WHEN camera_id = 3 THEN {least} ELSE 100 * camera_id END
 AND NOT (camera_id = 2 AND (x1+x2)/2.0 BETWEEN 0 AND 200 AND (y1+y2)/2.0 BETWEEN 0 AND 300)""".format(floor=site.SETTING_DEFAULTS["conf_threshold"], least=site.SETTING_DEFAULTS["min_area"])))
def filter_by_settings(spark, folder):
    obs = views.observations(spark, folder)
    cameras = views.runs(spark, folder).select("camera_id").distinct()
    settings = cameras.filter("camera_id <> 3").select(
        "camera_id", (F.lit(0.1) + F.col("camera_id") * F.lit(0.1)).alias("conf_threshold"),
        F.when(F.col("camera_id") == 1, F.create_map(F.lit("bus"), F.lit(0.5))).alias("conf_per_class"),
        (F.col("camera_id") * 100).cast("int").alias("min_area"), F.lit(999999).alias("max_area"),
        *(F.lit(v).alias(n) for n, v in site.SHAPE_DEFAULTS.items()))
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
                     for x, y in ((0, 0), (200, 0), (200, 300), (0, 300))))
    closed = cameras.filter("camera_id = 2").select("camera_id", ring.alias("ring"))
    return filters.filter_by_settings(obs, settings, closed, ("camera_id",)).select("event_id")


_EDGES = """(VALUES (0,'D',200,40,320,260), (0,'D',320,260,200,480), (0,'D',200,480,80,260), (0,'D',80,260,200,40),
 (1,'C',150,100,600,100), (1,'C',600,100,600,420), (1,'C',600,420,380,250), (1,'C',380,250,150,420),
 (1,'C',150,420,150,100)) e(zo, z, ex1, ey1, ex2, ey2)"""
SHAPES = {"D": [(200, 40), (320, 260), (200, 480), (80, 260)],
          "C": [(150, 100), (600, 100), (600, 420), (380, 250), (150, 420)]}


def _in_shapes(source_rows, x, y, id_column="event_id"):
    """Rows with the shapes that hold their point, by the even-odd rule over an edge table."""
    return f"""hits AS (SELECT p.*, zo, z,
  sum(CASE WHEN (ey1 > {y}) <> (ey2 > {y}) AND {x} < (ex2-ex1)*({y}-ey1)/(ey2-ey1)::DOUBLE + ex1 THEN 1 ELSE 0 END) % 2 = 1
  OR bool_or(({x}-ex1)*(ey2-ey1) = (ex2-ex1)*({y}-ey1) AND {x} BETWEEN least(ex1,ex2) AND greatest(ex1,ex2)
    AND {y} BETWEEN least(ey1,ey2) AND greatest(ey1,ey2)) AS inside
  FROM {source_rows} p, {_EDGES} GROUP BY ALL)"""


_POINT_SQL = sql.OBS + ", pts AS (SELECT event_id, cx, cy FROM obs), " + _in_shapes("pts", "cx", "cy")


@query("zone_of_point", sql.q(_POINT_SQL, """
SELECT event_id, arg_min(z, zo) FILTER (inside) AS zone, CAST(min(zo) FILTER (inside) AS INTEGER) AS zone_order
FROM hits GROUP BY event_id"""))
def zone_of_point(spark, folder):
    return zone_ops.zone_of_point(views.observations(spark, folder), SHAPES).select(
        "event_id", "zone", "zone_order")


@query("zone_of_point_by_site", sql.q(_POINT_SQL, """
SELECT event_id, arg_min(z, zo) FILTER (inside) AS zone, CAST(min(zo) FILTER (inside) AS INTEGER) AS zone_order
FROM hits GROUP BY event_id"""))
def zone_of_point_by_site(spark, folder):
    """The same through the zones table, joined by run and camera."""
    obs = views.observations(spark, folder)
    sites = obs.select("run_id", "camera_id").distinct()
    shapes = F.array(*(F.struct(
        F.lit(i).alias("zone_order"), F.lit(n).alias("zone"), F.array(*(
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring)).alias("ring"))
        for i, (n, ring) in enumerate(SHAPES.items())))
    zones = sites.select("run_id", "camera_id", F.inline(shapes))
    return zone_ops.zone_of_point(obs, zones).select("event_id", "zone", "zone_order")


@query("zone_of_point_raster", sql.q(sql.OBS, """
SELECT event_id, CASE WHEN NOT (cx BETWEEN 0 AND 639 AND cy BETWEEN 0 AND 479) THEN NULL
 WHEN cx <= 120 THEN 'W' WHEN cx BETWEEN 560 AND 700 THEN 'E' WHEN cy <= 90 THEN 'N' WHEN cy >= 400 THEN 'S' END AS zone
FROM obs"""))
def zone_of_point_raster(spark, folder):
    obs = views.observations(spark, folder)
    rings = F.array(*(F.struct(
        F.lit(i).alias("zone_order"), F.lit(n).alias("zone"), F.array(*(
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring)).alias("ring"))
        for i, (n, ring) in enumerate(views.ZONES.items())))
    zones = obs.select("run_id", "camera_id").distinct().select("run_id", "camera_id", F.inline(rings))
    return zone_ops.zone_of_point_raster(obs, zones, 640, 480).select("event_id", "zone")


@query("boxes_touching_zone", sql.q(
    sql.OBS + """, pts AS (SELECT event_id, unnest([x1,x2,x2,x1]) AS px, unnest([y1,y1,y2,y2]) AS py FROM obs), """
    + _in_shapes("pts", "px", "py"), "SELECT DISTINCT event_id FROM hits WHERE inside AND z = 'D'"))
def boxes_touching_zone(spark, folder):
    return filters.boxes_touching(views.observations(spark, folder), SHAPES["D"]).select("event_id")


@query("filter_roi", sql.q(
    sql.OBS + ", pts AS (SELECT event_id, (x1+x2)/2.0::DOUBLE AS mx, (y1+y2)/2.0::DOUBLE AS my FROM obs), "
    + _in_shapes("pts", "mx", "my"), "SELECT DISTINCT event_id FROM hits WHERE inside"))
def filter_roi(spark, folder):
    return filters.filter_roi(views.observations(spark, folder), SHAPES).select("event_id")


@query("sample_constraints", sql.q(sql.DET, """
SELECT camera_id, frame, det_idx FROM det WHERE det_idx % 2 = 0
 OR ((x2-x1) BETWEEN 61 AND 65 AND (x2-x1)/CAST(y2-y1 AS DOUBLE) BETWEEN 1.15 AND 1.25)"""))
def sample_constraints(spark, folder):
    limits = F.when(F.col("det_idx") % 2 == 1, F.struct(
        *(F.lit(v).cast("double").alias(n) for n, v in (
            ("min_area", None), ("max_area", None), ("min_width", 61), ("max_width", 65),
            ("min_height", None), ("max_height", None), ("min_aspect", 1.15), ("max_aspect", 1.25)))))
    rows = views.detections(spark, folder).filter(filters.passes_sample_constraints(g.box(), limits))
    return rows.select("camera_id", "frame", "det_idx")


_SITE = """c AS (SELECT c_custkey AS k, 'site-' || c_custkey AS site_id,
  CASE c_custkey % 7 WHEN 0 THEN 'lines' WHEN 1 THEN 'directions' WHEN 2 THEN 'other' ELSE 'zones' END AS mode,
  c_custkey % 4 AS nz, c_custkey % 3 AS nl, (c_custkey % 13)/10.0::DOUBLE AS conf, 200 + (c_custkey % 5)*100 AS imgsz,
  c_custkey % 9 - 2 AS mina, c_custkey % 11 AS maxa, 32 + (c_custkey % 3)*32 AS sw, 48 + (c_custkey % 4)*16 AS sh,
  (c_custkey % 12)/10.0::DOUBLE AS ov, c_custkey % 3 AS age, c_custkey % 2 AS hits, (c_custkey % 6)/4.0::DOUBLE AS iou
  FROM customer),
zn AS (SELECT c.*, i, 5 + (k*7+i)%20 AS s, 2 + (k+i)%3 AS np FROM c, (VALUES (0),(1),(2)) t(i) WHERE i < nz),
ln AS (SELECT c.*, j, 4 + (k+j)%15 AS len, 1 + (k+j)%2 AS np FROM c, (VALUES (0),(1)) t(j) WHERE j < nl)"""


@query("site_violations", sql.q(_SITE, """
SELECT site_id, rule, subject, CAST(found AS DOUBLE) AS found FROM (
 SELECT site_id, 'unknown_mode' AS rule, mode AS subject, NULL::DOUBLE AS found FROM c WHERE mode = 'other'
 UNION ALL SELECT site_id, 'fewer_than_2_zones', NULL, nz FROM c WHERE mode = 'zones' AND nz < 2
 UNION ALL SELECT site_id, 'no_line', NULL, nl FROM c WHERE mode = 'lines' AND nl < 1
 UNION ALL SELECT site_id, 'conf_threshold_range', NULL, conf FROM c WHERE NOT (conf > 0 AND conf <= 1)
 UNION ALL SELECT site_id, 'imgsz_below_320', NULL, imgsz FROM c WHERE imgsz < 320
 UNION ALL SELECT site_id, 'min_area_negative', NULL, mina FROM c WHERE mina < 0
 UNION ALL SELECT site_id, 'max_area_below_min_area', NULL, maxa FROM c WHERE maxa < mina
 UNION ALL SELECT site_id, 'slice_width_below_64', NULL, sw FROM c WHERE sw < 64
 UNION ALL SELECT site_id, 'slice_height_below_64', NULL, sh FROM c WHERE sh < 64
 UNION ALL SELECT site_id, 'overlap_ratio_range', NULL, ov FROM c WHERE ov > 0.9::DOUBLE
 UNION ALL SELECT site_id, 'max_age_below_1', NULL, age FROM c WHERE age < 1
 UNION ALL SELECT site_id, 'min_hits_below_1', NULL, hits FROM c WHERE hits < 1
 UNION ALL SELECT site_id, 'iou_threshold_range', NULL, iou FROM c WHERE NOT (iou > 0 AND iou <= 1)
 UNION ALL SELECT site_id, 'zone_with_fewer_than_3_points', 'Z' || i, np FROM zn WHERE np < 3
 UNION ALL SELECT site_id, 'zone_area_below_100', 'Z' || i, CASE np WHEN 3 THEN s*s/2.0 ELSE s*s END FROM zn
   WHERE mode = 'zones' AND np >= 3 AND CASE np WHEN 3 THEN s*s/2.0 ELSE s*s END < 100
 UNION ALL SELECT site_id, 'line_with_fewer_than_2_points', 'L' || j, np FROM ln WHERE np < 2
 UNION ALL SELECT site_id, 'line_shorter_than_10', 'L' || j, len FROM ln WHERE mode = 'lines' AND np >= 2 AND len < 10
 UNION ALL SELECT site_id, 'direction_with_fewer_than_2_points', 'D', 1 FROM c WHERE k % 5 = 0
 UNION ALL SELECT site_id, 'point_without_two_coordinates', 'D', NULL FROM c WHERE k % 5 = 1)"""))
def site_violations(spark, folder):
    return site_rules.site_violations(views.site_configs(spark, folder))


def _site_tables(spark, folder):
    """The configurations as they come out of JSON files."""
    configs = views.site_configs(spark, folder)
    return site.site_tables(configs.select(F.from_json(F.to_json(F.struct("*")), SITE_CONFIG).alias("c")).select("c.*"))


@query("site_tables_lines", sql.q(_SITE, """
SELECT site_id, CAST(j AS INTEGER) AS line_order, 'L' || j AS line, 0 AS lx1, 0 AS ly1, CAST(len AS INTEGER) AS lx2, 0 AS ly2,
 15 AS tolerance FROM ln WHERE np >= 2"""))
def site_tables_lines(spark, folder):
    return _site_tables(spark, folder).lines


@query("site_tables_directions", sql.q(_SITE, """
SELECT site_id, CAST(0 AS INTEGER) AS dir_order, 'D' AS direction, CAST(k % 9 AS INTEGER) AS dx, 5 AS dy FROM c WHERE k % 5 > 1"""))
def site_tables_directions(spark, folder):
    return _site_tables(spark, folder).directions


@query("site_tables_zones", sql.q(_SITE, """
SELECT site_id, CAST(i AS INTEGER) AS zone_order, 'Z' || i AS zone, CAST(np AS INTEGER) AS points,
 CASE WHEN np < 3 THEN 0.0::DOUBLE WHEN np = 3 THEN s*s/2.0::DOUBLE ELSE CAST(s*s AS DOUBLE) END AS area FROM zn"""))
def site_tables_zones(spark, folder):
    zones = _site_tables(spark, folder).zones
    return zones.select("site_id", "zone_order", "zone", F.size("ring").alias("points"), g.ring_area(F.col("ring")).cast("double").alias("area"))


@query("site_tables_settings", sql.q(_SITE, f"""
SELECT site_id, mode, conf AS conf_threshold, CAST(imgsz AS INTEGER) AS imgsz, CAST(mina AS INTEGER) AS min_area, CAST(maxa AS INTEGER) AS max_area,
 {site.SETTING_DEFAULTS['min_origin_frames']} AS min_origin_frames, {site.SETTING_DEFAULTS['min_crossing_frames']} AS min_crossing_frames,
 CAST(sw AS INTEGER) AS slice_width, ov AS overlap_ratio, CAST(age AS INTEGER) AS max_age, iou AS iou_threshold FROM c"""))
def site_tables_settings(spark, folder):
    return _site_tables(spark, folder).settings.select(
        "site_id", "mode", "conf_threshold", "imgsz", "min_area", "max_area", "min_origin_frames", "min_crossing_frames",
        "slice_width", "overlap_ratio", "max_age", "iou_threshold")


# --- boxes against boxes, tiles ---------------------------------------------------------------

_IOU = """CASE WHEN least({a}.x2,{b}.x2) > greatest({a}.x1,{b}.x1) AND least({a}.y2,{b}.y2) > greatest({a}.y1,{b}.y1) THEN
 (least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) /
 CAST(({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1)
 - (least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) AS DOUBLE) ELSE 0.0 END"""
_IOS = """CASE WHEN least({a}.x2,{b}.x2) > greatest({a}.x1,{b}.x1) AND least({a}.y2,{b}.y2) > greatest({a}.y1,{b}.y1) THEN
 (least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) /
 CAST(least(({a}.x2-{a}.x1)*({a}.y2-{a}.y1), ({b}.x2-{b}.x1)*({b}.y2-{b}.y1)) AS DOUBLE) ELSE 0.0 END"""


@query("iou_pairs", sql.q(sql.DET, f"""
SELECT a.run_id, a.camera_id, a.frame, a.det_idx AS det_a, b.det_idx AS det_b,
 round({_IOU.format(a='a', b='b')}, 6) AS iou
FROM det a JOIN det b ON a.frame = b.frame AND a.camera_id = b.camera_id AND a.det_idx < b.det_idx
WHERE {_IOU.format(a='a', b='b')} > 0.3"""))
def iou_pairs(spark, folder):
    return overlaps.overlap_pairs(views.detections(spark, folder), 0.3).withColumn("iou", F.round("iou", 6))


def _nms_sql(metric, threshold, by_class=False):
    same = " AND a.cls = b.cls" if by_class else ""
    part = "camera_id, frame" + (", cls" if by_class else "")
    return sql.q(sql.DET + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY conf DESC, det_idx) AS r FROM det),
hit AS (SELECT a.camera_id, a.frame, a.cls, a.r AS ra, b.r AS rb FROM ranked a JOIN ranked b
  ON a.camera_id = b.camera_id AND a.frame = b.frame AND a.r < b.r{same}
  WHERE {metric.format(a='a', b='b')} > {threshold}),
walk(camera_id, frame, cls, r, kept) AS (
 SELECT camera_id, frame, {'cls' if by_class else "''"}, 1, [1]::BIGINT[] FROM ranked WHERE r = 1
 UNION ALL
 SELECT w.camera_id, w.frame, w.cls, w.r + 1,
  CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.camera_id = w.camera_id AND h.frame = w.frame
     {'AND h.cls = w.cls' if by_class else ''} AND h.rb = w.r + 1 AND list_contains(w.kept, h.ra))
   THEN w.kept ELSE list_append(w.kept, w.r + 1) END
 FROM walk w JOIN ranked n ON n.camera_id = w.camera_id AND n.frame = w.frame
  {'AND n.cls = w.cls' if by_class else ''} AND n.r = w.r + 1),
last AS (SELECT camera_id, frame, cls, arg_max(kept, r) AS kept FROM walk GROUP BY ALL)""", f"""
SELECT d.camera_id, d.frame, d.det_idx, d.cls, d.conf FROM ranked d JOIN last l
 ON d.camera_id = l.camera_id AND d.frame = l.frame {'AND d.cls = l.cls' if by_class else ''}
WHERE list_contains(l.kept, d.r)""")


def _kept_boxes(boxes):
    return boxes.select("camera_id", "frame", "det_idx", "cls", "conf")


@query("nms_iou", _nms_sql(_IOU, 0.3))
def nms_iou(spark, folder):
    return _kept_boxes(overlaps.nms(views.detections(spark, folder), 0.3))


@query("nms_ios", _nms_sql(_IOS, 0.5, True))
def nms_ios(spark, folder):
    return _kept_boxes(overlaps.nms(views.detections(spark, folder), 0.5, "ios", class_aware=True))


@query("nms_crowded_frames", _nms_sql(_IOU, 0.3))
def nms_crowded_frames(spark, folder):
    """The same boxes with 64 frames laid side by side as one, so a frame holds some 500 boxes."""
    at = F.pmod("frame", F.lit(64))
    side_by_side = views.detections(spark, folder).select(
        "run_id", "camera_id", F.shiftright("frame", 6).alias("frame"), (at * 8 + F.col("det_idx")).cast("int").alias("det_idx"),
        *((F.col(c) + (at * 400 if c[0] == "x" else 0)).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")), "conf", "cls", at.alias("at"))
    found = overlaps.nms(side_by_side, 0.3)
    return found.select("camera_id", (F.shiftleft("frame", 6) + F.col("at")).alias("frame"),
                        F.pmod("det_idx", F.lit(8)).alias("det_idx"), "cls", "conf")


_TRK = """trk AS (SELECT run_id, camera_id, frame, CAST(det_idx + 1 AS BIGINT) AS track_id,
 x1 + det_idx*3 AS x1, y1 + det_idx*2 AS y1, x2 + det_idx*3 AS x2, y2 + det_idx*2 AS y2 FROM det)"""


@query("attach_class_best_iou", sql.q(f"{sql.DET}, {_TRK}", f"""
SELECT t.camera_id, t.frame, t.track_id, coalesce(arg_max(d.cls, {{'i': {_IOU.format(a='t', b='d')}, 'n': -d.det_idx}})
  FILTER ({_IOU.format(a='t', b='d')} > 0), 'car') AS cls
FROM trk t LEFT JOIN det d ON d.camera_id = t.camera_id AND d.frame = t.frame GROUP BY ALL"""))
def attach_class_best_iou(spark, folder):
    return overlaps.attach_class(views.tracked_boxes(spark, folder), views.detections(spark, folder)).select(
        "camera_id", "frame", "track_id", "cls")


@query("attach_class_first_iou", sql.q(f"{sql.DET}, {_TRK}", f"""
SELECT t.camera_id, t.frame, t.track_id, coalesce(arg_min(d.cls, d.det_idx)
  FILTER ({_IOU.format(a='t', b='d')} > 0.5), 'unknown') AS cls
FROM trk t LEFT JOIN det d ON d.camera_id = t.camera_id AND d.frame = t.frame GROUP BY ALL"""))
def attach_class_first_iou(spark, folder):
    return overlaps.attach_class(
        views.tracked_boxes(spark, folder), views.detections(spark, folder), "first").select(
        "camera_id", "frame", "track_id", "cls")


@query("vehicles_by_class", sql.q(f"{sql.DET}, {_TRK}", f"""
SELECT 'am' AS run_id, camera_id, cls, count(*) AS cnt FROM (
 SELECT camera_id, track_id, arg_min(cls, frame) AS cls FROM (
  SELECT t.camera_id, t.frame, t.track_id, arg_min(d.cls, d.det_idx) FILTER ({_IOU.format(a='t', b='d')} > 0.5) AS cls
  FROM trk t LEFT JOIN det d ON d.camera_id = t.camera_id AND d.frame = t.frame GROUP BY ALL)
 WHERE cls IS NOT NULL GROUP BY ALL) GROUP BY camera_id, cls"""))
def vehicles_by_class(spark, folder):
    return summary.vehicles_by_class(overlaps.attach_class(
        views.tracked_boxes(spark, folder), views.detections(spark, folder), "first"))


_SAMPLES = """smp AS (SELECT camera_id * 1000000 + frame AS sample_id, x1 + 5 AS x1, y1 + 5 AS y1, x2 - 20 AS x2, y2 - 15 AS y2
 FROM det WHERE det_idx = 0), cand AS (SELECT camera_id * 1000000 + frame AS sample_id, * FROM det)"""


def _samples(spark, folder):
    sample_id = F.col("camera_id") * 1000000 + F.col("frame")
    boxes = views.detections(spark, folder).withColumn("sample_id", sample_id)
    samples = boxes.filter("det_idx = 0").select(
        "sample_id", (F.col("x1") + 5).alias("sx1"), (F.col("y1") + 5).alias("sy1"),
        (F.col("x2") - 20).alias("sx2"), (F.col("y2") - 15).alias("sy2"))
    return boxes, samples


@query("match_samples", sql.q(f"{sql.DET}, {_SAMPLES}", f"""
SELECT sample_id, det_idx, round(iou, 6) AS iou, conf, cls FROM (
 SELECT s.sample_id, d.det_idx, {_IOU.format(a='d', b='s')} AS iou, d.conf, d.cls,
  row_number() OVER (PARTITION BY s.sample_id ORDER BY {_IOU.format(a='d', b='s')} DESC, d.conf DESC, d.det_idx) AS r
 FROM cand d JOIN smp s ON d.sample_id = s.sample_id
 WHERE {_IOU.format(a='d', b='s')} >= 0.10
  OR ((d.x1+d.x2)/2.0 BETWEEN s.x1 AND s.x2 AND (d.y1+d.y2)/2.0 BETWEEN s.y1 AND s.y2)
  OR ((s.x1+s.x2)/2.0 BETWEEN d.x1 AND d.x2 AND (s.y1+s.y2)/2.0 BETWEEN d.y1 AND d.y2)) WHERE r = 1"""))
def match_samples(spark, folder):
    return overlaps.match_samples(*_samples(spark, folder)).select(
        "sample_id", "det_idx", F.round("iou", 6).alias("iou"), "conf", "cls")


@query("synthetic_ids", sql.q(sql.DET, """
SELECT camera_id, frame, det_idx, CAST(row_number() OVER (PARTITION BY camera_id, frame ORDER BY det_idx) AS BIGINT) AS track_id
FROM det"""))
def synthetic_ids(spark, folder):
    return overlaps.synthetic_ids(views.detections(spark, folder)).select("camera_id", "frame", "det_idx", "track_id")


_TILES = """tiles AS (SELECT p_partkey AS frame_id, w, h, CAST(tc AS INTEGER) AS tile_col, CAST(tr AS INTEGER) AS tile_row,
  CAST(tc*409 AS INTEGER) AS tx1, CAST(tr*409 AS INTEGER) AS ty1, CAST(least(tc*409+512, w) AS INTEGER) AS tx2,
  CAST(least(tr*409+512, h) AS INTEGER) AS ty2
 FROM (SELECT p_partkey, 320 + (p_partkey % 7)*200 AS w, 240 + (p_partkey % 5)*150 AS h FROM part),
  (SELECT unnest(range(10)) AS tc), (SELECT unnest(range(10)) AS tr) WHERE tc*409 < w AND tr*409 < h)"""


@query("tile_grid", sql.q(_TILES, "SELECT frame_id, tile_col, tile_row, tx1, ty1, tx2, ty2 FROM tiles"))
def tile_grid(spark, folder):
    return tiles.tile_grid(views.frame_sizes(spark, folder)).drop("frame_width", "frame_height")


@query("tiles_of_box", sql.q(sql.OBS, """
SELECT event_id, CAST(tc AS BIGINT) AS tile_col, CAST(tr AS BIGINT) AS tile_row FROM obs,
 (SELECT unnest(range(8)) AS tc), (SELECT unnest(range(8)) AS tr)
WHERE tc*102 < 700 AND tr*102 < 520 AND x2 > tc*102 AND x1 < least(tc*102+128, 700)
 AND y2 > tr*102 AND y1 < least(tr*102+128, 520)"""))
def tiles_of_box(spark, folder):
    return tiles.tiles_of_box(views.observations(spark, folder), *views.FRAME_SIZE, 128, 128, 0.2).select(
        "event_id", "tile_col", "tile_row")


# --- tracks ----------------------------------------------------------------------------------

@query("track_lives", sql.q(sql.LIFE_SUM, """
SELECT v.run_id, v.camera_id, v.track_id, v.life, v.first_frame, v.last_frame, v.n_obs,
 floor(e.f/120.0)*120 - v.last_frame <= 200 AS survives
FROM lives v JOIN ends e ON v.run_id = e.run_id AND v.camera_id = e.camera_id"""))
def track_lives(spark, folder):
    return lives.track_lives(lived(spark, folder), run_ends(spark, folder))


@query("previous_positions", sql.q(sql.LIVED, """
SELECT event_id, life, obs_no, pf AS prev_frame, pcx AS prev_cx, pcy AS prev_cy,
 first_value(cx) OVER l AS first_cx, first_value(cy) OVER l AS first_cy
FROM lived WINDOW l AS (PARTITION BY run_id, camera_id, track_id, life ORDER BY frame)"""))
def previous_positions(spark, folder):
    rows = lived(spark, folder, first=("cx", "cy"), prev=("cx", "cy"))
    return rows.select("event_id", "life", "obs_no", "prev_frame", "prev_cx", "prev_cy", "first_cx", "first_cy")


@query("trails", sql.q(sql.LIVED, """
SELECT run_id, camera_id, track_id, life, count(*) AS points, min(frame) AS from_frame,
 arg_min(cx, frame) AS first_x, arg_max(cy, frame) AS last_y, CAST(sum(cx * (frame % 97)) AS BIGINT) AS mix
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id, life ORDER BY frame DESC) AS back FROM lived)
WHERE back <= 64 GROUP BY ALL"""))
def trails(spark, folder):
    t = F.col("trail")
    mix = F.aggregate(t, F.lit(0).cast("bigint"), lambda s, p: s + p["cx"] * (p["frame"] % 97))
    return shape.trails(lived(spark, folder)).select(
        "run_id", "camera_id", "track_id", "life", F.size(t).cast("bigint").alias("points"),
        t[0]["frame"].alias("from_frame"), t[0]["cx"].alias("first_x"),
        F.element_at(t, -1)["cy"].alias("last_y"), mix.alias("mix"))


_EMA = """boxes AS (SELECT *, x2-x1 AS w, y2-y1 AS h,
  count(*) OVER (PARTITION BY run_id, camera_id, track_id, life) AS n FROM lived),
ema AS (SELECT run_id, camera_id, track_id, life, max(n) AS samples,
  sum(k * w) AS avg_width, sum(k * h) AS avg_height, sum(k * w * h) AS avg_area, sum(k * w / h) AS avg_aspect,
  sum(k * greatest(w, h) / least(w, h)) AS avg_elongation
 FROM (SELECT *, CASE WHEN obs_no = 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, n - obs_no) AS k FROM boxes)
 GROUP BY ALL)"""


@query("shape_ema", sql.q(f"{sql.LIVED}, {_EMA}", """
SELECT run_id, camera_id, track_id, life, samples, round(avg_width, 6) AS avg_width, round(avg_height, 6) AS avg_height,
 round(avg_area, 6) AS avg_area, round(avg_aspect, 6) AS avg_aspect, round(avg_elongation, 6) AS avg_elongation FROM ema"""))
def shape_ema(spark, folder):
    return shape.shape_ema(
        lived(spark, folder), total_frames=views.total_frames(spark, folder)).select(
        "run_id", "camera_id", "track_id", "life", "samples",
        *(F.round(c, 6).alias(c) for c in shape.AVERAGES))


_TRAIL_SQL = """tr AS (SELECT run_id, camera_id, track_id, life,
 count(*) AS trail_length, arg_min(cx, frame) AS first_x, arg_min(cy, frame) AS first_y, arg_max(cx, frame) AS last_x,
 arg_max(cy, frame) AS last_y FROM (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id, life
 ORDER BY frame DESC) AS back FROM lived) WHERE back <= 64 GROUP BY ALL)"""


def _report_sql(ctes, states):
    """The report over `states`: (life, cls, state, origin, direction)."""
    return sql.q(f"{ctes}, {_EMA}, {_TRAIL_SQL}, modes AS ({states})", """
SELECT v.run_id, v.camera_id, v.track_id, s.cls AS class, s.state, s.origin, s.direction,
 first_x, first_y, last_x, last_y, CAST(trail_length AS INTEGER) AS trail_length, v.last_frame AS last_seen_frame,
 round(avg_width, 1) AS avg_width, round(avg_height, 1) AS avg_height, round(avg_area, 1) AS avg_area,
 round(avg_aspect, 2) AS avg_aspect, round(avg_elongation, 2) AS avg_elongation
FROM lives v JOIN ends e USING (run_id, camera_id) JOIN modes s USING (run_id, camera_id, track_id, life)
 JOIN ema USING (run_id, camera_id, track_id, life) JOIN tr USING (run_id, camera_id, track_id, life)
WHERE floor(e.f/120.0)*120 - v.last_frame <= 200""")


def _held(spark, folder, reports):
    return report.track_report(reports, run_ends(spark, folder), lives.EVERY, lives.LIMIT)


def zone_reports(spark, folder):
    return report.life_reports(lived_in_zones(spark, folder), ZONE_NAMES)


@query("track_report", _report_sql(sql.routes_cte(), """
SELECT run_id, camera_id, track_id, life, cls, state, origin, CAST(NULL AS VARCHAR) AS direction FROM states"""))
def track_report(spark, folder):
    return _held(spark, folder, zone_reports(spark, folder))


def filtered(spark, folder):
    """Raw boxes that reach the tracker: vehicles over the usual floors."""
    usual = site.SETTING_DEFAULTS
    return filters.filter_detections(views.detections(spark, folder), usual["conf_threshold"],
                                     limits={name: usual[name] for name in ("min_area", "max_area")})


@query("track_detections")
def track_detections(spark, folder):
    return tracker.track_detections(filtered(spark, folder), total_frames=views.total_frames(spark, folder, "detections"))


@query("detect_frames_stub", """
SELECT CAST(doc_id % 4 AS BIGINT) AS camera_id, doc_id AS frame, CAST(i AS INTEGER) AS det_idx,
 CAST(n % 200 + i*40 AS INTEGER) AS x1, CAST(n % 90 AS INTEGER) AS y1, CAST(n % 200 + i*40 + 60 AS INTEGER) AS x2,
 CAST(n % 90 + 40 AS INTEGER) AS y2, 0.3 + (n % 7) / CAST(10 AS DOUBLE) AS conf,
 CASE i WHEN 0 THEN 'car' ELSE 'truck' END AS cls
FROM (SELECT doc_id, strlen(text) AS n FROM documents), (VALUES (0),(1)) t(i) WHERE i <= n % 2""")
def detect_frames_stub(spark, folder):
    frames = views.table(spark, folder, "documents").select(
        F.lit("am").alias("run_id"), (F.col("doc_id") % 4).alias("camera_id"),
        F.col("doc_id").alias("frame"), F.encode("text", "UTF-8").alias("image"))

    def infer(image, conf):
        n = len(image)
        return [{"bbox": (n % 200 + i * 40, n % 90, n % 200 + i * 40 + 60, n % 90 + 40),
                 "cls_name": "truck" if i else "car", "conf": 0.3 + (n % 7) / 10}
                for i in range(n % 2 + 1)]

    return scoring.detect_frames(frames, infer).drop("run_id")


# --- crossings and headings -------------------------------------------------------------------

LINES = [{"name": "L1", "pt1": (350, 0), "pt2": (350, 520), "tolerance": 60},
         {"name": "L2", "pt1": (0, 242), "pt2": (700, 242), "tolerance": 40}]
DIRECTIONS = {"Norte": ((100, 200), (100, 0)), "Sur": ((100, 0), (100, 200)),
              "Este": ((0, 100), (200, 100)), "Oeste": ((200, 100), (0, 100))}
_LINES_SQL = "(VALUES (0,'L1',350,0,350,520,60), (1,'L2',0,242,700,242,40)) ln(lo, line, ex1, ey1, ex2, ey2, tol)"


def _side(x, y):
    return f"((ex2-ex1)*({y}-ey1) - (ey2-ey1)*({x}-ex1))"


def _near_lines(lines):
    return sql.LIVED + f""",
near AS (SELECT *, CASE WHEN hi > 0 AND lo_ < 0 THEN 0 WHEN hi > 0 THEN 1 WHEN lo_ < 0 THEN -1 ELSE 0 END AS side
 FROM (SELECT l.*, lo, line, ex1, ey1, ex2, ey2, tol,
   abs((ex2-ex1)*(ey1-cy) - (ex1-cx)*(ey2-ey1)) / sqrt(CAST((ex2-ex1)*(ex2-ex1) + (ey2-ey1)*(ey2-ey1) AS DOUBLE)) AS distance,
   greatest({_side('cx','cy')}, {_side('x1','y1')}, {_side('x2','y1')}, {_side('x2','y2')}, {_side('x1','y2')}) AS hi,
   least({_side('cx','cy')}, {_side('x1','y1')}, {_side('x2','y1')}, {_side('x2','y2')}, {_side('x1','y2')}) AS lo_
  FROM lived l, {lines}) WHERE distance <= tol)"""


_NEAR = _near_lines(_LINES_SQL)


@query("line_sides", sql.q(_NEAR, """
SELECT event_id, line, round(distance, 6) AS distance, CAST(side AS INTEGER) AS side FROM near"""))
def line_sides(spark, folder):
    return crossings.near_lines(lived(spark, folder), LINES).select(
        "event_id", "line", F.round("distance", 6).alias("distance"), "side")


_EVENT = "run_id, camera_id, track_id, life, line, direction, cls, frame, line || ' ' || direction AS route"


SETTLED_SQL = _NEAR + """,
q1 AS (SELECT *, lag(side) OVER t AS ps, lag(cy) OVER t AS kcy FROM near WHERE side <> 0
  WINDOW t AS (PARTITION BY run_id, camera_id, track_id, life, line ORDER BY frame)),
q2 AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side THEN 1 ELSE 0 END) OVER
  (PARTITION BY run_id, camera_id, track_id, life, line ORDER BY frame) AS seg FROM q1),
q3 AS (SELECT *, row_number() OVER s AS nth, first_value(CASE WHEN cy > kcy THEN '↓' ELSE '↑' END) OVER s AS direction
  FROM q2 WINDOW s AS (PARTITION BY run_id, camera_id, track_id, life, line, seg ORDER BY frame)),
q4 AS (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id, life, line, direction ORDER BY frame) AS k
  FROM q3 WHERE seg > 1 AND nth = 2)"""


@query("line_crossings_settled", sql.q(SETTLED_SQL, f"SELECT {_EVENT} FROM q4 WHERE k = 1"))
def line_crossings_settled(spark, folder):
    return crossings.line_crossings(
        lived(spark, folder), LINES, 2, total_frames=views.total_frames(spark, folder))


@query("line_crossings_simple", sql.q(sql.LIVED + f""",
x AS (SELECT l.*, lo, line, CASE WHEN cy > pcy THEN '↓' ELSE '↑' END AS direction FROM lived l, {_LINES_SQL}
  WHERE opens = 0 AND abs((ex2-ex1)*(ey1-cy) - (ex1-cx)*(ey2-ey1)) / sqrt(CAST((ex2-ex1)*(ex2-ex1) + (ey2-ey1)*(ey2-ey1) AS DOUBLE)) <= tol
  AND sign({_side('cx','pcy')}) * sign({_side('cx','cy')}) < 0),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id, life, line, direction ORDER BY frame) AS r FROM x)""",
    f"SELECT {_EVENT} FROM k WHERE r = 1"))
def line_crossings_simple(spark, folder):
    return crossings.line_crossings(lived(spark, folder, prev=("cy",)), LINES, semantics="simple")


def _strict_sql(n, anchors, near=_NEAR, n_lines=2):
    side = "side" if anchors == "box" else (
        f"CASE WHEN {_side('cx','cy')} > 0 THEN 1 WHEN {_side('cx','cy')} < 0 THEN -1 ELSE 0 END")
    c = "CASE WHEN p.s > 0 THEN '+' ELSE '-' END"

    def hist(i):
        return f"right(CASE WHEN p.lo = {i} THEN w.h{i} || {c} ELSE w.h{i} END, {n + 1})"

    own = "right(CASE p.lo " + " ".join(f"WHEN {i} THEN w.h{i}" for i in range(n_lines)) + f" END || {c}, {n + 1})"
    counts = (f"p.flips AND length({own}) >= {n} AND replace({own}, {c}, '') = '' "
              "AND NOT list_contains(w.seen, p.line || ' ' || p.direction)")
    key = "run_id, camera_id, track_id, life"
    same = " AND ".join(f"p.{k} = w.{k}" for k in key.split(", "))
    histories = ", ".join(f"h{i}" for i in range(n_lines))
    return sql.q(near + f""",
q AS (SELECT *, CASE WHEN {_side('pcx','pcy')} > 0 THEN 1 ELSE -1 END * s < 0 AS flips,
  CASE WHEN cy > pcy THEN '↓' ELSE '↑' END AS direction,
  row_number() OVER (PARTITION BY {key} ORDER BY frame, lo) AS i
  FROM (SELECT *, {side} AS s FROM near WHERE opens = 0) WHERE s <> 0),
walk({key}, i, {histories}, seen, hit) AS (
 SELECT {key}, 0::BIGINT, {", ".join(["''"] * n_lines)}, []::VARCHAR[], FALSE FROM q WHERE i = 1
 UNION ALL
 SELECT {", ".join("w." + k for k in key.split(", "))}, p.i,
  {", ".join(f"CASE WHEN {counts} THEN '' ELSE {hist(i)} END" for i in range(n_lines))},
  CASE WHEN {counts} THEN list_append(w.seen, p.line || ' ' || p.direction) ELSE w.seen END, {counts}
 FROM walk w JOIN q p ON {same} AND p.i = w.i + 1)""",
        f"SELECT {_EVENT} FROM walk JOIN q USING ({key}, i) WHERE hit")


@query("line_crossings_strict", _strict_sql(2, "center"))
def line_crossings_strict(spark, folder):
    return crossings.line_crossings(
        lived(spark, folder, prev=("cx", "cy")), LINES, 2, "strict", anchors="center",
        total_frames=views.total_frames(spark, folder))


@query("line_crossings_strict_first", _strict_sql(1, "center"))
def line_crossings_strict_first(spark, folder):
    return crossings.line_crossings(
        lived(spark, folder, prev=("cx", "cy")), LINES, 1, "strict", anchors="center",
        total_frames=views.total_frames(spark, folder))


# Lines so narrow that a box is only seen beyond them, which is when the rule counts boxes.
NARROW_LINES = [{"name": "N1", "pt1": (352, 0), "pt2": (352, 520), "tolerance": 10}, {"name": "N2", "pt1": (0, 242), "pt2": (700, 242), "tolerance": 7},
                {"name": "N3", "pt1": (348, 0), "pt2": (348, 520), "tolerance": 10}]
_NARROW = _near_lines("(VALUES (0,'N1',352,0,352,520,10), (1,'N2',0,242,700,242,7), (2,'N3',348,0,348,520,10)) ln(lo, line, ex1, ey1, ex2, ey2, tol)")


@query("line_crossings_strict_box", _strict_sql(1, "box", _NARROW, 3))
def line_crossings_strict_box(spark, folder):
    return crossings.line_crossings(
        lived(spark, folder, prev=("cx", "cy")), NARROW_LINES, 1, "strict", total_frames=views.total_frames(spark, folder))


HEADINGS_SQL = sql.LIVED + """,
f AS (SELECT *, first_value(cx) OVER l AS fx, first_value(cy) OVER l AS fy FROM lived
  WINDOW l AS (PARTITION BY run_id, camera_id, track_id, life ORDER BY frame)),
m AS (SELECT *, CAST(cx - fx AS DOUBLE) AS dx, CAST(cy - fy AS DOUBLE) AS dy FROM f),
s AS (SELECT m.*, d, name, (dx*vx + dy*vy) / (sqrt(dx*dx + dy*dy) * sqrt(CAST(vx*vx + vy*vy AS DOUBLE))) AS score
  FROM m, (VALUES (0,'Norte',0,-200),(1,'Sur',0,200),(2,'Este',200,0),(3,'Oeste',-200,0)) t(d, name, vx, vy)
  WHERE obs_no >= 5 AND sqrt(dx*dx + dy*dy) >= 10),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id, life ORDER BY frame, score DESC, d) AS r
  FROM s WHERE score > 0.5)"""


@query("headings", sql.q(HEADINGS_SQL, """
SELECT run_id, camera_id, track_id, life, name AS direction, round(score, 6) AS score, cls, frame FROM b WHERE r = 1"""))
def headings(spark, folder):
    return heading_ops.headings(
        lived(spark, folder, first=("cx", "cy")), DIRECTIONS,
        total_frames=views.total_frames(spark, folder)).withColumn(
        "score", F.round("score", 6))


@query("gate_counts", sql.q(sql.LIVED + """,
x AS (SELECT l.*, g, gate, gy, pcy < gy AND cy >= gy AS falls FROM lived l, (VALUES (0,'up',260),(1,'down',364)) t(g, gate, gy)
 WHERE cx BETWEEN 0 AND 700 AND pcy IS NOT NULL AND cy BETWEEN gy - 10 AND gy + 10
  AND ((pcy < gy AND cy >= gy) OR (pcy > gy AND cy <= gy))),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id ORDER BY frame, g) AS r FROM x)""", """
SELECT gate, CASE WHEN falls THEN 'DOWN' ELSE 'UP' END AS direction, cls, count(*) AS cnt FROM k WHERE r = 1 GROUP BY ALL"""))
def gate_counts(spark, folder):
    return crossings.gate_counts(crossings.gate_crossings(
        lived(spark, folder, prev=("cy",)), *views.FRAME_SIZE))


# --- reports and counts of lines and directions mode ---------------------------------------------

_LIVES_OF = "SELECT run_id, camera_id, track_id, life, arg_min(cls, frame) AS cls FROM lived GROUP BY ALL"


def heading_reports(spark, folder):
    return report.life_reports(lived(spark, folder, first=("cx", "cy")), directions=DIRECTIONS)


_REPORT_LIVES = """, lives AS (SELECT run_id, camera_id, track_id, life, min(frame) AS first_frame, max(frame) AS last_frame,
  count(*) AS n_obs FROM lived GROUP BY ALL), ends AS (SELECT run_id, camera_id, max(frame) AS f FROM obs GROUP BY ALL)"""


@query("track_report_directions", _report_sql(HEADINGS_SQL + _REPORT_LIVES, f"""
SELECT v.*, CASE WHEN b.name IS NULL THEN 'tracking' ELSE 'done' END AS state, CAST(NULL AS VARCHAR) AS origin, b.name AS direction
FROM ({_LIVES_OF}) v LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (run_id, camera_id, track_id, life)""").replace(
    "SELECT v.*, CASE", "SELECT v.run_id, v.camera_id, v.track_id, v.life, v.cls, CASE"))
def track_report_directions(spark, folder):
    return _held(spark, folder, heading_reports(spark, folder))


@query("track_report_lines", _report_sql(SETTLED_SQL + _REPORT_LIVES, f"""
SELECT v.run_id, v.camera_id, v.track_id, v.life, v.cls, CASE WHEN c.life IS NULL THEN 'new' ELSE 'done' END AS state,
 CAST(NULL AS VARCHAR) AS origin, CAST(NULL AS VARCHAR) AS direction
FROM ({_LIVES_OF}) v LEFT JOIN (SELECT DISTINCT run_id, camera_id, track_id, life FROM q4 WHERE k = 1) c USING (run_id, camera_id, track_id, life)"""))
def track_report_lines(spark, folder):
    rows = lived(spark, folder)
    found = crossings.line_crossings(rows, LINES, 2, total_frames=views.total_frames(spark, folder))
    return _held(spark, folder, report.with_crossings(report.life_reports(rows), found))


@query("heading_counts", sql.q(HEADINGS_SQL, """
SELECT run_id, camera_id, name AS direction, count(*) AS cnt FROM b WHERE r = 1 GROUP BY ALL"""))
def heading_counts(spark, folder):
    return heading_reports(spark, folder).filter("state = 'done'").groupBy("run_id", "camera_id", "direction").agg(F.count(F.lit(1)).alias("cnt"))


@query("crossing_counts", sql.q(SETTLED_SQL, """
SELECT run_id, camera_id, line || ' ' || direction AS route, count(*) AS cnt FROM q4 WHERE k = 1 GROUP BY ALL"""))
def crossing_counts(spark, folder):
    return summary.route_counts(line_crossings_settled(spark, folder), by=("run_id", "camera_id"))


# --- density ---------------------------------------------------------------------------------

_HEAT = sql.LIVED + """, ends AS (SELECT run_id, camera_id, max(frame) AS f FROM obs GROUP BY ALL),
heat AS (SELECT l.run_id, l.camera_id, cx AS x, cy AS y, sum(pow(0.995::DOUBLE, e.f - l.frame)) AS weight
 FROM lived l JOIN ends e ON e.run_id = l.run_id AND e.camera_id = l.camera_id
 WHERE cx BETWEEN 0 AND 699 AND cy BETWEEN 0 AND 519 GROUP BY ALL)"""


def _heat(spark, folder):
    return heat.heat_grid(kept(spark, folder), *views.FRAME_SIZE, ends=run_ends(spark, folder))


@query("heat_grid", sql.q(_HEAT, "SELECT run_id, camera_id, x, y, round(weight, 6) AS weight FROM heat"))
def heat_grid(spark, folder):
    return _heat(spark, folder).withColumn("weight", F.round("weight", 6))


@query("heat_smooth", sql.q(_HEAT + """,
raw AS (SELECT o, exp(-o*o/(2*1.1*1.1)::DOUBLE) AS e FROM (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS o)),
kern AS (SELECT o, e / (SELECT sum(e) FROM raw) AS k FROM raw),
bx AS (SELECT run_id, camera_id, tx AS x, y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, y, weight, k, unnest(CASE
    WHEN x > 0 AND x <= 2 THEN [x + o, -x + o] WHEN x < 699 AND x >= 697 THEN [x + o, 1398 - x + o] ELSE [x + o] END) AS tx
  FROM heat, kern) WHERE tx BETWEEN 0 AND 699 GROUP BY ALL),
by_ AS (SELECT run_id, camera_id, x, ty AS y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, x, weight, k, unnest(CASE
    WHEN y > 0 AND y <= 2 THEN [y + o, -y + o] WHEN y < 519 AND y >= 517 THEN [y + o, 1038 - y + o] ELSE [y + o] END) AS ty
  FROM bx, kern) WHERE ty BETWEEN 0 AND 519 GROUP BY ALL),
peak AS (SELECT run_id, camera_id, greatest(max(weight), 1.0) AS p FROM by_ GROUP BY ALL)""", """
SELECT b.run_id, b.camera_id, x, y, round(weight / p, 6) AS level FROM by_ b
 JOIN peak k ON b.run_id = k.run_id AND b.camera_id = k.camera_id WHERE weight / p > 0.05"""))
def heat_smooth(spark, folder):
    return heat.heat_smooth(_heat(spark, folder), *views.FRAME_SIZE, size=5).withColumn("level", F.round("level", 6))


@query("heat_smooth_wide", sql.q(_HEAT + """,
raw AS (SELECT o, exp(-o*o/(2*5.0*5.0)::DOUBLE) AS e FROM (SELECT CAST(unnest(range(-15, 16)) AS INTEGER) AS o)),
kern AS (SELECT o, e / (SELECT sum(e) FROM raw) AS k FROM raw),
bx AS (SELECT run_id, camera_id, tx AS x, y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, y, weight, k, unnest(CASE
    WHEN x > 0 AND x <= 15 THEN [x + o, -x + o] WHEN x < 699 AND x >= 684 THEN [x + o, 1398 - x + o] ELSE [x + o] END) AS tx
  FROM (SELECT * REPLACE (weight * 40 AS weight) FROM heat), kern) WHERE tx BETWEEN 0 AND 699 GROUP BY ALL),
by_ AS (SELECT run_id, camera_id, x, ty AS y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, x, weight, k, unnest(CASE
    WHEN y > 0 AND y <= 15 THEN [y + o, -y + o] WHEN y < 519 AND y >= 504 THEN [y + o, 1038 - y + o] ELSE [y + o] END) AS ty
  FROM bx, kern) WHERE ty BETWEEN 0 AND 519 GROUP BY ALL),
peak AS (SELECT run_id, camera_id, greatest(max(weight), 1.0) AS p FROM by_ GROUP BY ALL)""", """
SELECT b.run_id, b.camera_id, x, y, round(weight / p, 6) AS level FROM by_ b
 JOIN peak k ON b.run_id = k.run_id AND b.camera_id = k.camera_id WHERE weight / p > 0.05"""))
def heat_smooth_wide(spark, folder):
    return heat.heat_smooth(_heat(spark, folder).withColumn("weight", F.col("weight") * 40), *views.FRAME_SIZE).withColumn("level", F.round("level", 6))


# Single hits spread over 31 by 31 pixels are below the usual cut of 0.05.
FAINT = 0.0005


@query("heat_smooth_31", sql.q(_HEAT + """,
raw AS (SELECT o, exp(-o*o/(2*5.0*5.0)::DOUBLE) AS e FROM (SELECT CAST(unnest(range(-15, 16)) AS INTEGER) AS o)),
kern AS (SELECT o, e / (SELECT sum(e) FROM raw) AS k FROM raw),
bx AS (SELECT run_id, camera_id, tx AS x, y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, y, weight, k, unnest(CASE
    WHEN x > 0 AND x <= 15 THEN [x + o, -x + o] WHEN x < 699 AND x >= 684 THEN [x + o, 1398 - x + o] ELSE [x + o] END) AS tx
  FROM heat, kern) WHERE tx BETWEEN 0 AND 699 GROUP BY ALL),
by_ AS (SELECT run_id, camera_id, x, ty AS y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, x, weight, k, unnest(CASE
    WHEN y > 0 AND y <= 15 THEN [y + o, -y + o] WHEN y < 519 AND y >= 504 THEN [y + o, 1038 - y + o] ELSE [y + o] END) AS ty
  FROM bx, kern) WHERE ty BETWEEN 0 AND 519 GROUP BY ALL),
peak AS (SELECT run_id, camera_id, greatest(max(weight), 1.0) AS p FROM by_ GROUP BY ALL)""", """
SELECT b.run_id, b.camera_id, x, y, round(weight / p, 6) AS level FROM by_ b
 JOIN peak k ON b.run_id = k.run_id AND b.camera_id = k.camera_id WHERE weight / p > 0.0005"""))
def heat_smooth_31(spark, folder):
    return heat.heat_smooth(_heat(spark, folder), *views.FRAME_SIZE, keep=FAINT).withColumn("level", F.round("level", 6))


# --- sites with zones, thresholds, directions and frame sizes of their own -----------------------

def lived_by_site(spark, folder):
    zones = views.cameras(spark, folder).select("run_id", "camera_id", F.inline("zones"))
    return lives.with_lives(zone_ops.zone_of_point(kept(spark, folder), zones), first=("cx", "cy"), prev=("zone_order", "cy"),
                            total_frames=views.total_frames(spark, folder))


@query("zone_routes_by_site", sql.q(sql.routes_cte("(2 + s.camera_id % 3)", "(2 + s.camera_id % 2)", lives=sql.BY_SITE), "SELECT * FROM states"))
def zone_routes_by_site(spark, folder):
    return route_ops.zone_routes(lived_by_site(spark, folder), views.cameras(spark, folder), total_frames=views.total_frames(spark, folder))


_SITE_DIRECTIONS = """(VALUES (0, 0, 'up', 0, 0, -10, -1), (0, 1, 'down', 0, 0, 20, 1), (0, 2, 'right', 30, 0, 0, 5),
 (1, 0, 'left', -40, 0, 0, 0), (1, 1, 'right', 30, 0, 0, 5), (1, 2, 'down', 0, 0, 20, 1), (1, 3, 'up', 0, 0, -10, -1)) t(odd, d, name, ax, bx, ay, by_)"""


@query("headings_by_site", sql.q(sql.LIVED + f""",
f AS (SELECT *, first_value(cx) OVER l AS fx, first_value(cy) OVER l AS fy FROM lived
  WINDOW l AS (PARTITION BY run_id, camera_id, track_id, life ORDER BY frame)),
m AS (SELECT *, CAST(cx - fx AS DOUBLE) AS dx, CAST(cy - fy AS DOUBLE) AS dy FROM f),
v AS (SELECT m.*, d, name, CAST(ax + bx * camera_id AS DOUBLE) AS vx, CAST(ay + by_ * camera_id AS DOUBLE) AS vy
  FROM m JOIN {_SITE_DIRECTIONS} ON odd = camera_id % 2 WHERE obs_no >= greatest(5, 2 + camera_id % 3) AND sqrt(dx*dx + dy*dy) >= 10),
s AS (SELECT *, (dx*vx + dy*vy) / (sqrt(dx*dx + dy*dy) * sqrt(vx*vx + vy*vy)) AS score FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id, life ORDER BY frame, score DESC, d) AS r
  FROM s WHERE score > 0.5)""", """
SELECT run_id, camera_id, track_id, life, name AS direction, round(score, 6) AS score, cls, frame FROM b WHERE r = 1"""))
def headings_by_site(spark, folder):
    return heading_ops.headings(lived_by_site(spark, folder), views.cameras(spark, folder),
                                total_frames=views.total_frames(spark, folder)).withColumn("score", F.round("score", 6))


@query("gate_counts_by_site", sql.q(sql.LIVED + """,
x AS (SELECT l.*, g, gate, gy, pcy < gy AND cy >= gy AS falls FROM (
  SELECT *, CAST(floor((520 - 40 * camera_id) * ratio) AS INTEGER) AS gy FROM lived, (VALUES (0,'up',0.5::DOUBLE),(1,'down',0.7::DOUBLE)) t(g, gate, ratio)) l
 WHERE cx BETWEEN 0 AND 700 - 50 * camera_id AND pcy IS NOT NULL AND cy BETWEEN gy - 10 AND gy + 10
  AND ((pcy < gy AND cy >= gy) OR (pcy > gy AND cy <= gy))),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id, track_id ORDER BY frame, g) AS r FROM x)""", """
SELECT run_id, camera_id, gate, CASE WHEN falls THEN 'DOWN' ELSE 'UP' END AS direction, cls, count(*) AS cnt FROM k WHERE r = 1 GROUP BY ALL"""))
def gate_counts_by_site(spark, folder):
    gates = crossings.gate_crossings(lived_by_site(spark, folder), cameras=views.cameras(spark, folder))
    return crossings.gate_counts(gates, by=("run_id", "camera_id"))


_HEAT_BY_SITE = sql.LIVED + """, ends AS (SELECT run_id, camera_id, max(frame) AS f FROM obs GROUP BY ALL),
heat AS (SELECT l.run_id, l.camera_id, cx AS x, cy AS y, sum(pow(0.995::DOUBLE, e.f - l.frame)) AS weight
 FROM lived l JOIN ends e ON e.run_id = l.run_id AND e.camera_id = l.camera_id
 WHERE cx BETWEEN 0 AND 699 - 50 * l.camera_id AND cy BETWEEN 0 AND 519 - 40 * l.camera_id GROUP BY ALL)"""


def _heat_by_site(spark, folder):
    return heat.heat_grid(kept(spark, folder), ends=run_ends(spark, folder), cameras=views.cameras(spark, folder))


@query("heat_grid_by_site", sql.q(_HEAT_BY_SITE, "SELECT run_id, camera_id, x, y, round(weight, 6) AS weight FROM heat"))
def heat_grid_by_site(spark, folder):
    return _heat_by_site(spark, folder).withColumn("weight", F.round("weight", 6))


@query("heat_smooth_by_site", sql.q(_HEAT_BY_SITE + """,
raw AS (SELECT o, exp(-o*o/(2*5.0*5.0)::DOUBLE) AS e FROM (SELECT CAST(unnest(range(-15, 16)) AS INTEGER) AS o)),
kern AS (SELECT o, e / (SELECT sum(e) FROM raw) AS k FROM raw),
bx AS (SELECT run_id, camera_id, tx AS x, y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, y, weight, k, unnest(CASE
    WHEN x > 0 AND x <= 15 THEN [x + o, -x + o] WHEN x < 699 - 50 * camera_id AND x >= 684 - 50 * camera_id
     THEN [x + o, 1398 - 100 * camera_id - x + o] ELSE [x + o] END) AS tx
  FROM heat, kern) WHERE tx BETWEEN 0 AND 699 - 50 * camera_id GROUP BY ALL),
by_ AS (SELECT run_id, camera_id, x, ty AS y, sum(weight * k) AS weight FROM (
  SELECT run_id, camera_id, x, weight, k, unnest(CASE
    WHEN y > 0 AND y <= 15 THEN [y + o, -y + o] WHEN y < 519 - 40 * camera_id AND y >= 504 - 40 * camera_id
     THEN [y + o, 1038 - 80 * camera_id - y + o] ELSE [y + o] END) AS ty
  FROM bx, kern) WHERE ty BETWEEN 0 AND 519 - 40 * camera_id GROUP BY ALL),
peak AS (SELECT run_id, camera_id, greatest(max(weight), 1.0) AS p FROM by_ GROUP BY ALL)""", """
SELECT b.run_id, b.camera_id, x, y, round(weight / p, 6) AS level FROM by_ b
 JOIN peak k ON b.run_id = k.run_id AND b.camera_id = k.camera_id WHERE weight / p > 0.0005"""))
def heat_smooth_by_site(spark, folder):
    return heat.heat_smooth(_heat_by_site(spark, folder), cameras=views.cameras(spark, folder), keep=FAINT).withColumn(
        "level", F.round("level", 6))


@query("zone_of_point_raster_by_site", sql.q(sql.OBS, """
SELECT event_id, CASE WHEN NOT (cx BETWEEN 0 AND 699 - 50 * camera_id AND cy BETWEEN 0 AND 519 - 40 * camera_id) THEN NULL
 WHEN cx <= 120 + 20 * camera_id THEN 'W' WHEN cx BETWEEN 560 - 10 * camera_id AND 700 THEN 'E'
 WHEN camera_id < 3 AND cy <= 90 + 5 * camera_id THEN 'N' WHEN camera_id < 3 AND cy >= 400 - 10 * camera_id THEN 'S' END AS zone
FROM obs"""))
def zone_of_point_raster_by_site(spark, folder):
    zones = views.cameras(spark, folder).select("run_id", "camera_id", "frame_width", "frame_height", F.inline("zones"))
    return zone_ops.zone_of_point_raster(
        views.observations(spark, folder), zones, F.col("frame_width"), F.col("frame_height")).select("event_id", "zone")


@query("tiles_of_box_by_site", sql.q(sql.OBS, """
SELECT event_id, CAST(tc AS BIGINT) AS tile_col, CAST(tr AS BIGINT) AS tile_row FROM (
 SELECT *, 700 - 50 * camera_id AS w, 520 - 40 * camera_id AS h FROM obs), (SELECT unnest(range(8)) AS tc), (SELECT unnest(range(8)) AS tr)
WHERE tc*102 < w AND tr*102 < h AND x2 > tc*102 AND x1 < least(tc*102+128, w) AND y2 > tr*102 AND y1 < least(tr*102+128, h)"""))
def tiles_of_box_by_site(spark, folder):
    boxes = heat.on_frames(views.observations(spark, folder), views.cameras(spark, folder))
    return tiles.tiles_of_box(boxes, F.col("frame_width"), F.col("frame_height"), 128, 128, 0.2).select("event_id", "tile_col", "tile_row")


# --- aggregates ------------------------------------------------------------------------------

@query("route_counts", sql.q(sql.routes_cte(), "SELECT run_id, camera_id, route, count(*) AS cnt FROM routes GROUP BY ALL"))
def route_counts(spark, folder):
    return summary.route_counts(events(spark, folder), by=("run_id", "camera_id"))


@query("top_routes", sql.q(sql.routes_cte(), """
SELECT *, CAST(row_number() OVER (PARTITION BY run_id, camera_id ORDER BY cnt DESC, route) AS INTEGER) AS rank FROM (
 SELECT run_id, camera_id, route, trim(split_part(route, '→', 1)) AS origin, count(*) AS cnt FROM routes GROUP BY ALL)"""))
def top_routes(spark, folder):
    return summary.top_routes(events(spark, folder)).withColumn("origin", labels.route_origin(F.col("route")))


@query("route_shares", sql.q(sql.routes_cte(), """
SELECT run_id, camera_id, route, count(*) AS cnt,
 round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY run_id, camera_id), 6) AS share,
 round(count(*) / CAST(max(count(*)) OVER (PARTITION BY run_id, camera_id) AS DOUBLE), 6) AS of_largest
FROM routes GROUP BY run_id, camera_id, route"""))
def route_shares(spark, folder):
    return summary.route_shares(events(spark, folder)).withColumns(
        {"share": F.round("share", 6), "of_largest": F.round("of_largest", 6)})


@query("od_rollup", sql.q(sql.routes_cte(), """
SELECT run_id, camera_id, origin, destination, count(*) AS cnt, CAST(grouping(origin, destination) AS BIGINT) AS level
FROM routes GROUP BY GROUPING SETS ((run_id, camera_id, origin, destination), (run_id, camera_id, origin), (run_id, camera_id))"""))
def od_rollup(spark, folder):
    return summary.od_rollup(events(spark, folder))


@query("od_matrix_long", sql.q(sql.routes_cte() + """,
seen AS (SELECT run_id, camera_id, origin AS z FROM routes UNION SELECT run_id, camera_id, destination FROM routes)""", """
SELECT a.run_id, a.camera_id, a.z AS origin, b.z AS destination, count(r.track_id) AS cnt
FROM seen a JOIN seen b USING (run_id, camera_id)
 LEFT JOIN routes r ON r.run_id = a.run_id AND r.camera_id = a.camera_id AND r.origin = a.z AND r.destination = b.z GROUP BY ALL"""))
def od_matrix_long(spark, folder):
    return summary.od_matrix_long(events(spark, folder))


@query("od_matrix", sql.q(sql.routes_cte() + """,
seen AS (SELECT DISTINCT run_id, camera_id, z FROM routes, (VALUES """ + ", ".join(f"('{z}')" for z in sorted(views.ZONES)) + """) t(z))""", """
SELECT a.run_id, a.camera_id, a.z AS origin, """ + ", ".join(
    f"count(r.track_id) FILTER (r.destination = '{z}') AS {z}" for z in sorted(views.ZONES)) + """
FROM seen a LEFT JOIN routes r ON r.run_id = a.run_id AND r.camera_id = a.camera_id AND r.origin = a.z GROUP BY ALL"""))
def od_matrix(spark, folder):
    return summary.od_matrix(events(spark, folder), sorted(views.ZONES))


@query("vehicles_total", sql.q(sql.LIVED, """
SELECT run_id, camera_id, count(DISTINCT (track_id, life)) AS vehicles FROM lived GROUP BY ALL"""))
def vehicles_total(spark, folder):
    return summary.vehicles_total(lived(spark, folder))


_AXIS = sql.FLT + """,
ends AS (SELECT run_id, camera_id, max(frame) AS f FROM obs GROUP BY ALL),
act AS (SELECT x.run_id, x.camera_id, x.frame, count(t.event_id) AS active FROM (
  SELECT run_id, camera_id, unnest(range(1, f + 1)) AS frame FROM ends) x LEFT JOIN flt t USING (run_id, camera_id, frame) GROUP BY ALL)"""


@query("vehicles_sketch", sql.q(sql.LIVED, """
SELECT run_id, camera_id, count(DISTINCT (track_id, life)) AS vehicles, TRUE AS close FROM lived GROUP BY ALL"""))
def vehicles_sketch(spark, folder):
    """Vehicles of a run from sketches per half minute that are merged upwards, and whether they come within 5 % of the exact number."""
    rows = lived(spark, folder)
    merged = summary.merged_vehicles(summary.vehicle_sketches(rows, frames=750))
    return summary.vehicles_total(rows).join(merged, ["run_id", "camera_id"]).select(
        "run_id", "camera_id", "vehicles", (F.abs(F.col("estimate") - F.col("vehicles")) <= 0.05 * F.col("vehicles")).alias("close"))


@query("active_per_frame", sql.q(_AXIS, "SELECT run_id, camera_id, frame, active FROM act"))
def active_per_frame(spark, folder):
    return summary.active_per_frame(kept(spark, folder), views.runs(spark, folder))


@query("class_totals", sql.q(sql.routes_cte(), "SELECT run_id, camera_id, coalesce(cls, 'unknown') AS cls, count(*) AS cnt FROM routes GROUP BY ALL"))
def class_totals(spark, folder):
    return summary.class_totals(events(spark, folder))


@query("run_summary", sql.q(sql.routes_cte() + """,
vehicles AS (SELECT run_id, camera_id, count(DISTINCT (track_id, life)) AS v FROM lived GROUP BY ALL),
per AS (SELECT run_id, camera_id, route, count(*) AS cnt FROM routes GROUP BY ALL),
done AS (SELECT run_id, camera_id, CAST(sum(cnt) AS BIGINT) AS n, string_agg(route || '=' || cnt, '; ' ORDER BY cnt DESC, route) AS listed
 FROM per GROUP BY ALL)""", """
SELECT run_id, camera_id, max(o.frame) AS frames_processed, coalesce(max(v), 0) AS total_vehicles_tracked,
 coalesce(max(n), 0) AS total_routes_completed, coalesce(max(listed), '') AS routes
FROM obs o LEFT JOIN vehicles USING (run_id, camera_id) LEFT JOIN done USING (run_id, camera_id) GROUP BY ALL"""))
def run_summary(spark, folder):
    return _listed(report.run_totals(zone_reports(spark, folder), views.runs(spark, folder)))


def _listed(found):
    return found.withColumn("routes", F.array_join(F.transform(
        F.map_entries("routes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; "))


@query("run_summary_directions", sql.q(HEADINGS_SQL + """,
vehicles AS (SELECT run_id, camera_id, count(DISTINCT (track_id, life)) AS v FROM lived GROUP BY ALL),
per AS (SELECT run_id, camera_id, name AS route, count(*) AS cnt FROM b WHERE r = 1 GROUP BY ALL),
done AS (SELECT run_id, camera_id, CAST(sum(cnt) AS BIGINT) AS n, string_agg(route || '=' || cnt, '; ' ORDER BY cnt DESC, route) AS listed
 FROM per GROUP BY ALL)""", """
SELECT run_id, camera_id, max(o.frame) AS frames_processed, coalesce(max(v), 0) AS total_vehicles_tracked,
 coalesce(max(n), 0) AS total_routes_completed, coalesce(max(listed), '') AS routes
FROM obs o LEFT JOIN vehicles USING (run_id, camera_id) LEFT JOIN done USING (run_id, camera_id) GROUP BY ALL"""))
def run_summary_directions(spark, folder):
    return _listed(report.run_totals(heading_reports(spark, folder), views.runs(spark, folder)))


@query("learn_constraints", sql.q(sql.FLT, """
SELECT run_id, camera_id, greatest(1, CAST(trunc(min(w)*0.70::DOUBLE) AS BIGINT)) AS min_width,
 CAST(trunc(max(w)*1.45::DOUBLE) AS BIGINT) AS max_width,
 greatest(1, CAST(trunc(min(h)*0.70::DOUBLE) AS BIGINT)) AS min_height, CAST(trunc(max(h)*1.45::DOUBLE) AS BIGINT) AS max_height,
 greatest(1, CAST(trunc(min(w*h)*0.55::DOUBLE) AS BIGINT)) AS min_area, CAST(trunc(max(w*h)*1.55::DOUBLE) AS BIGINT) AS max_area,
 round(greatest(0.20::DOUBLE, min(w/h::DOUBLE)*0.70), 6) AS min_aspect, round(least(6.0::DOUBLE, max(w/h::DOUBLE)*1.30), 6) AS max_aspect
FROM (SELECT *, x2-x1 AS w, y2-y1 AS h FROM flt) GROUP BY ALL"""))
def learn_constraints(spark, folder):
    return calibration.learn_constraints(kept(spark, folder)).withColumns(
        {c: F.round(c, 6) for c in ("min_aspect", "max_aspect")})


@query("area_bounds", sql.q(sql.FLT + """,
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, camera_id ORDER BY area) - 1 AS i,
 count(*) OVER (PARTITION BY run_id, camera_id) AS n FROM (SELECT *, (x2-x1)*(y2-y1) AS area FROM flt))""", """
SELECT run_id, camera_id, max(n) AS n_boxes, CAST(trunc(lo*0.6::DOUBLE) AS BIGINT) AS min_area,
 greatest(CAST(trunc(lo*0.6::DOUBLE) AS BIGINT) + 1, CAST(trunc(hi*1.5::DOUBLE) AS BIGINT)) AS max_area FROM (
 SELECT run_id, camera_id, max(n) AS n, max(area) FILTER (i = greatest(0, CAST(trunc(n*0.10::DOUBLE) AS BIGINT) - 1)) AS lo,
  max(area) FILTER (i = least(n - 1, CAST(trunc(n*0.95::DOUBLE) AS BIGINT))) AS hi FROM o GROUP BY ALL) GROUP BY ALL"""))
def area_bounds(spark, folder):
    return calibration.area_bounds(kept(spark, folder))


@query("area_bounds_of_box", sql.q(sql.DET, """
SELECT camera_id, frame, det_idx, CAST(trunc((x2-x1)*(y2-y1)*0.5::DOUBLE) AS BIGINT) AS min_area,
 CAST((x2-x1)*(y2-y1)*4 AS BIGINT) AS max_area FROM det"""))
def area_bounds_of_box(spark, folder):
    return calibration.area_bounds_of_box(views.detections(spark, folder)).select(
        "camera_id", "frame", "det_idx", "min_area", "max_area")


@query("pick_backend", sql.q(sql.DET, """
SELECT sample_id, arg_max(backend, {'n': n, 'p': CASE backend WHEN 'whole' THEN 1 ELSE 0 END}) AS backend, max(n) AS n FROM (
 SELECT camera_id * 1000000 + frame AS sample_id, CASE WHEN det_idx % 2 = 0 THEN 'whole' ELSE 'tiled' END AS backend,
  count(*) AS n FROM det WHERE cls <> 'person' GROUP BY ALL) GROUP BY sample_id"""))
def pick_backend(spark, folder):
    rows = filters.filter_detections(views.detections(spark, folder), 0.0).select(
        (F.col("camera_id") * 1000000 + F.col("frame")).alias("sample_id"),
        F.when(F.col("det_idx") % 2 == 0, "whole").otherwise("tiled").alias("backend"))
    return calibration.pick_backend(rows, ("whole", "tiled"))


# --- result files, one per run, written and read back -----------------------------------------

def _read_back(spark, rows, order, schema):
    path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    run_files.write_run_files(rows, path, order)
    return run_files.read_run_files(spark, path.removeprefix("file://"), schema)


@query("routes_csv", sql.q(sql.routes_cte(), """
SELECT run_id, camera_id, route AS ruta, count(*) AS conteo,
 floor(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY run_id, camera_id) * 10 + 0.5) / 10 AS porcentaje
FROM routes GROUP BY run_id, camera_id, route"""))
def routes_csv(spark, folder):
    shares = summary.route_shares(events(spark, folder))
    rows = shares.select("run_id", "camera_id", "route", "cnt", F.format_string("%.1f", "share").alias("share")).toDF("run_id", "camera_id", *sinks.ROUTES_HEADER)
    return _read_back(spark, rows, (F.col("conteo").cast("bigint").desc(), "ruta"), "ruta string, conteo bigint, porcentaje double")


@query("tracks_csv", ORACLES["track_report"])
def tracks_csv(spark, folder):
    rows = track_report(spark, folder).select("run_id", "camera_id", *sinks.TRACK_COLUMNS)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in run_files.RUN)
    return _read_back(spark, rows, ("track_id",), kinds)


@query("od_csv", ORACLES["od_matrix"])
def od_csv(spark, folder):
    zones = sorted(views.ZONES)
    matrix = od_matrix(spark, folder).select("run_id", "camera_id", F.col("origin").alias(sinks.OD_CORNER), *zones)
    read = _read_back(spark, matrix, (f"`{sinks.OD_CORNER}`",), f"`{sinks.OD_CORNER}` string, " + ", ".join(f"{z} bigint" for z in zones))
    return read.withColumnRenamed(sinks.OD_CORNER, "origin")


# --- ordered aggregates and time --------------------------------------------------------------

@query("rolling_rate", sql.q(_AXIS, """
SELECT run_id, camera_id, frame, round(avg(active) OVER (PARTITION BY run_id, camera_id ORDER BY frame
 ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS rolling FROM act"""))
def rolling_rate(spark, folder):
    """Boxes a frame over the last 30 frames."""
    rates = summary.active_per_frame(kept(spark, folder), views.runs(spark, folder)).withColumnRenamed("active", "rate")
    return summary.rolling_rate(rates, total_frames=views.total_frames(spark, folder)).select(
        "run_id", "camera_id", "frame", F.round("rolling", 6).alias("rolling"))


@query("progress_samples", sql.q(sql.routes_cte() + """,
runs AS (SELECT run_id, camera_id, max(frame) AS f FROM obs GROUP BY ALL)""", """
SELECT e.run_id, e.camera_id, CAST(s*60 AS BIGINT) AS frame, count(r.frame) AS routes,
 round(s*60 * 100.0::DOUBLE / e.f, 6) AS pct, CAST(e.f - s*60 AS BIGINT) AS frames_left
FROM runs e JOIN (SELECT unnest(range(1, 5000)) AS s) ON s*60 <= e.f
 LEFT JOIN routes r ON r.run_id = e.run_id AND r.camera_id = e.camera_id AND r.frame <= s*60 GROUP BY ALL"""))
def progress_samples(spark, folder):
    done = events(spark, folder)
    return summary.progress_samples(
        done, views.runs(spark, folder), total_frames=views.total_frames(spark, folder)).withColumn("pct", F.round("pct", 6))


@query("progress_table", ORACLES["progress_samples"])
def progress_table(spark, folder):
    rows = progress_samples(spark, folder).select("run_id", "camera_id", "frame", "routes", "pct", "frames_left")
    return _read_back(spark, rows, ("frame",), "frame bigint, routes bigint, pct double, frames_left bigint")


@query("route_events", sql.q(sql.routes_cte(), """
SELECT run_id, camera_id, route, frame, count(*) AS new, min(cls) AS cls,
 CAST(sum(count(*)) OVER (PARTITION BY run_id, camera_id, route ORDER BY frame) AS BIGINT) AS cnt
FROM routes GROUP BY run_id, camera_id, route, frame"""))
def route_events(spark, folder):
    return summary.route_events(events(spark, folder), views.total_frames(spark, folder))


@query("flow_per_window", sql.q(sql.FLT, """
SELECT run_id, camera_id, CAST(floor(epoch(ts)/3600)*3600 AS BIGINT) AS window_start, cls, count(*) AS boxes
FROM flt GROUP BY ALL"""))
def flow_per_window(spark, folder):
    return summary.flow_per_window(kept(spark, folder))


# --- streams -----------------------------------------------------------------------------------

FPS = 25.0


@query("stream_routes", sql.q(sql.routes_cte(), """
SELECT run_id, camera_id, track_id, v.first_frame AS life_start, r.frame, r.cls, r.origin, r.destination
FROM routes r JOIN lives v USING (run_id, camera_id, track_id, life)"""))
def stream_routes(spark, folder):
    return replay.replay(zoned(spark, folder), lambda s: flows.stream_routes(s, FPS), FPS)


@query("stream_headings", sql.q(HEADINGS_SQL + """, lives AS (
SELECT run_id, camera_id, track_id, life, min(frame) AS life_start FROM lived GROUP BY ALL)""", """
SELECT run_id, camera_id, track_id, v.life_start, b.frame, b.cls, b.name AS direction
FROM b JOIN lives v USING (run_id, camera_id, track_id, life) WHERE r = 1"""))
def stream_headings(spark, folder):
    return replay.replay(
        kept(spark, folder), lambda s: flows.stream_headings(s, DIRECTIONS, FPS), FPS, slices=2)


@query("stream_crossings", sql.q(SETTLED_SQL + """, lives AS (
SELECT run_id, camera_id, track_id, life, min(frame) AS life_start FROM lived GROUP BY ALL)""", """
SELECT run_id, camera_id, track_id, v.life_start, q.frame, q.cls, q.line, q.direction
FROM q4 q JOIN lives v USING (run_id, camera_id, track_id, life) WHERE k = 1"""))
def stream_crossings(spark, folder):
    return replay.replay(
        kept(spark, folder), lambda s: flows.stream_crossings(s, LINES, FPS), FPS, slices=2)


# Rows arrive up to 200 frames (8 of the 10 seconds that a row may be late) after later ones, so batches overlap.
LATE_FRAMES = 200


@query("stream_routes_late", ORACLES["stream_routes"])
def stream_routes_late(spark, folder):
    return replay.replay(zoned(spark, folder), lambda s: flows.stream_routes(s, FPS), FPS, delay_frames=LATE_FRAMES)


@query("stream_headings_late", ORACLES["stream_headings"])
def stream_headings_late(spark, folder):
    return replay.replay(kept(spark, folder), lambda s: flows.stream_headings(s, DIRECTIONS, FPS), FPS, delay_frames=LATE_FRAMES)


@query("stream_crossings_late", ORACLES["stream_crossings"])
def stream_crossings_late(spark, folder):
    return replay.replay(kept(spark, folder), lambda s: flows.stream_crossings(s, LINES, FPS), FPS, delay_frames=LATE_FRAMES)


@query("stream_flow_per_window", sql.q(sql.FLT, f"""
SELECT run_id, camera_id, CAST({replay.RUN_START_SECONDS} + floor((frame - 1) / 25.0 / 10) * 10 AS BIGINT) AS window_start, cls, count(*) AS boxes
FROM flt GROUP BY ALL"""))
def stream_flow_per_window(spark, folder):
    found = replay.replay(kept(spark, folder), lambda s: flows.flow_per_window(s, "10 seconds"), FPS, delay_frames=LATE_FRAMES)
    return found.select("run_id", "camera_id", F.unix_timestamp("window.start").alias("window_start"), "cls", "boxes")


@query("stream_progress", sql.q(sql.routes_cte() + f""",
boxes AS (SELECT run_id, camera_id, floor((frame - 1) / 25.0 / 10) AS w, count(*) AS boxes, count(DISTINCT track_id) AS tracks FROM flt GROUP BY ALL),
done AS (SELECT run_id, camera_id, floor((frame - 1) / 25.0 / 10) AS w, count(*) AS routes FROM routes GROUP BY ALL)""", f"""
SELECT run_id, camera_id, CAST({replay.RUN_START_SECONDS} + w * 10 AS BIGINT) AS window_start, boxes, tracks,
 boxes / CAST(10 AS DOUBLE) AS rate, coalesce(routes, 0) AS routes FROM boxes LEFT JOIN done USING (run_id, camera_id, w)"""))
def stream_progress(spark, folder):
    """Progress of the stream per window, with the routes that the route stream completed in it."""
    load = replay.replay(kept(spark, folder), lambda s: flows.progress_per_window(s, 10), FPS, delay_frames=LATE_FRAMES)
    done = replay.with_frame_time(stream_routes(spark, folder), FPS).groupBy(
        "run_id", "camera_id", F.window("ts", "10 seconds").start.alias("window_start")).agg(F.count(F.lit(1)).alias("routes"))
    return load.join(done, ["run_id", "camera_id", "window_start"], "left").select(
        "run_id", "camera_id", F.unix_timestamp("window_start").alias("window_start"), "boxes", "tracks", "rate",
        F.coalesce("routes", F.lit(0)).alias("routes"))


@query("stream_od_upsert", sql.q(sql.routes_cte(), """
SELECT run_id, camera_id, origin, destination, cls, count(*) AS cnt FROM routes GROUP BY ALL"""))
def stream_od_upsert(spark, folder):
    """Origin-destination totals of a stream whose batches are all delivered twice."""
    keys = ("run_id", "camera_id", "origin", "destination", "cls")

    def sink(path):
        return totals.Totals(spark, path, keys)

    def deliver(events, path, checkpoint):
        def twice(batch, batch_id):
            counted = batch.select(*keys, F.lit(1).alias("cnt"))
            for _ in range(2):
                sink(path).write(counted, batch_id)

        return flows.on_batch(events, twice, checkpoint)

    return replay.replay(zoned(spark, folder), lambda s: flows.stream_routes(s, FPS), FPS, delay_frames=LATE_FRAMES,
                         read=lambda path: sink(path).read(), deliver=deliver)


@query("stream_track_detections")
def stream_track_detections(spark, folder):
    return replay.replay(
        filtered(spark, folder), live_tracks.stream_tracks, FPS, slices=2)


# --- runs of unknown length ------------------------------------------------------------------

def _long_runs(name):
    """The same question where no metadata bounds a run, so the plans carry state from span to span."""
    def asked(spark, folder):
        with views.unbounded_runs():
            return QUERIES[name](spark, folder)

    query(f"{name}_long_runs", ORACLES[name])(asked)


for _name in ("track_lives", "zone_routes", "zone_routes_by_site", "headings_by_site", "headings", "shape_ema", "line_crossings_settled", "line_crossings_strict", "rolling_rate",
              "route_events", "od_by_class", "track_report"):
    _long_runs(_name)
