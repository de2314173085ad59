"""Site configurations: one JSON document per site, read into small tables."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from flowlattice.schemas import SITE_CONFIG

# What a missing setting means.
SETTING_DEFAULTS = {
    "conf_threshold": 0.10, "imgsz": 1600, "min_area": 0, "max_area": 999999, "sample_count": 0,
    "min_origin_frames": 3, "min_dest_frames": 3, "min_crossing_frames": 2,
}
SHAPE_DEFAULTS = {
    "min_width": 0, "max_width": 999999, "min_height": 0, "max_height": 999999,
    "min_aspect": 0.0, "max_aspect": 999999.0,
}
TILE_DEFAULTS = {"slice_width": 512, "slice_height": 512, "overlap_ratio": 0.2, "nms_threshold": 0.3}
TRACKER_DEFAULTS = {"max_age": 40, "min_hits": 3, "iou_threshold": 0.2}
LINE_TOLERANCE = 15
DEFAULT_MODE = "zones"


class Sites(NamedTuple):
    """The tables of a set of sites, all keyed by `site_id`."""

    raw: DataFrame
    zones: DataFrame
    exclusion: DataFrame
    lines: DataFrame
    directions: DataFrame
    settings: DataFrame


def _rings(configs, column, order_column=None):
    entries = F.transform(F.map_entries(column), lambda e: F.struct(
        e["key"].alias("zone"),
        F.transform(e["value"], lambda p: F.struct(
            F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("ring")))
    rows = configs.select("site_id", *([order_column] if order_column else []),
                          F.posexplode(entries).alias("_at", "_e"))
    place = F.col("_at")
    if order_column:
        # JSON objects have no guaranteed order, so the producer may state the priority.
        listed = F.array_position(order_column, F.col("_e.zone"))
        place = F.coalesce(F.when(listed > 0, listed - 1), place)
    return rows.select("site_id", place.cast("int").alias("zone_order"),
                       F.col("_e.zone").alias("zone"), F.col("_e.ring").alias("ring"))


def _two_points(column):
    """The coordinates of the first two points; null where the list or a point is too short."""
    return [[F.get(F.get(F.col(column), F.lit(i)), F.lit(k)) for k in (0, 1)] for i in (0, 1)]


def _whole(points):
    """Lines and directions without two points of two coordinates are reported by the site rules, not used."""
    (a, b), (c, d) = points
    return a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()


def _lines(configs):
    rows = configs.select("site_id", F.posexplode("lines").alias("line_order", "_l"))
    point = _two_points("_l.points")
    rows = rows.filter(_whole(point))
    return rows.select(
        "site_id", "line_order",
        F.coalesce("_l.name", F.concat(F.lit("Linea "), F.col("line_order") + 1)).alias("line"),
        point[0][0].alias("lx1"), point[0][1].alias("ly1"),
        point[1][0].alias("lx2"), point[1][1].alias("ly2"),
        F.coalesce("_l.tolerance", F.lit(LINE_TOLERANCE)).alias("tolerance"))


def _directions(configs):
    rows = configs.select("site_id", F.posexplode(F.map_entries("directions")).alias("dir_order", "_d"))
    a, b = point = _two_points("_d.value")
    return rows.filter(_whole(point)).select("site_id", "dir_order", F.col("_d.key").alias("direction"),
                                             (b[0] - a[0]).alias("dx"), (b[1] - a[1]).alias("dy"))


def _settings(configs):
    def filled(prefix, defaults):
        return [F.coalesce(f"{prefix}.{n}", F.lit(v)).alias(n) for n, v in defaults.items()]

    return configs.select(
        "site_id", F.coalesce("counting_mode", F.lit(DEFAULT_MODE)).alias("mode"),
        *filled("settings", SETTING_DEFAULTS),
        F.coalesce("settings.conf_per_class", F.create_map().cast("map<string,double>")).alias(
            "conf_per_class"),
        *filled("settings.sample_constraints", SHAPE_DEFAULTS),
        *filled("sahi", TILE_DEFAULTS), *filled("tracker", TRACKER_DEFAULTS))


def site_tables(configs):
    return Sites(configs, _rings(configs, "zones", "zone_order"), _rings(configs, "exclusion_zones"),
                 _lines(configs), _directions(configs), _settings(configs))


def read_sites(spark, path, multiline=True):
    """Reads JSON site files. A file without `site_id` is named after itself."""
    configs = spark.read.schema(SITE_CONFIG).option("multiLine", multiline).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1)
    return site_tables(configs.withColumn("site_id", F.coalesce("site_id", stem)))
