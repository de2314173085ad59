"""Checks on site configurations: one row per violation."""

from pyspark.sql import functions as F

from flowlattice.functions.geometry import ring_area
from flowlattice.sources.site import (
    DEFAULT_MODE, SETTING_DEFAULTS, TILE_DEFAULTS, TRACKER_DEFAULTS)

MODES = ("zones", "lines", "directions")
SMALLEST_ZONE, SHORTEST_LINE = 100, 10


def _points(ring):
    return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def site_violations(configs):
    """(site_id, rule, subject, found) for everything a configuration breaks.

    `configs` has the site-config schema. Limits on zone area and line length apply to the counting
    mode that uses them, the others always.
    """
    def value(part, name, defaults):
        return F.coalesce(F.col(f"{part}.{name}"), F.lit(defaults[name])).cast("double")

    setting = {n: value("settings", n, SETTING_DEFAULTS)
               for n in ("conf_threshold", "imgsz", "min_area", "max_area")}
    tile = {n: value("sahi", n, TILE_DEFAULTS) for n in TILE_DEFAULTS}
    tracker = {n: value("tracker", n, TRACKER_DEFAULTS) for n in TRACKER_DEFAULTS}
    mode = F.coalesce("counting_mode", F.lit(DEFAULT_MODE))
    zones = F.coalesce(F.map_entries("zones"), F.array().cast(
        "array<struct<key:string,value:array<array<int>>>>"))
    n_zones, n_lines = F.size(zones), F.coalesce(F.size("lines"), F.lit(0))
    n_lines = F.when(n_lines < 0, 0).otherwise(n_lines)

    def broken(condition, rule, subject, found):
        return F.when(condition, F.struct(
            F.lit(rule).alias("rule"), subject.cast("string").alias("subject"),
            found.cast("double").alias("found")))

    none = F.lit(None)
    single = F.array(
        broken(~mode.isin(*MODES), "unknown_mode", mode, none),
        broken((mode == "zones") & (n_zones < 2), "fewer_than_2_zones", none, n_zones),
        broken((mode == "lines") & (n_lines < 1), "no_line", none, n_lines),
        broken(~((setting["conf_threshold"] > 0) & (setting["conf_threshold"] <= 1)),
               "conf_threshold_range", none, setting["conf_threshold"]),
        broken(setting["imgsz"] < 320, "imgsz_below_320", none, setting["imgsz"]),
        broken(setting["min_area"] < 0, "min_area_negative", none, setting["min_area"]),
        broken(setting["max_area"] < setting["min_area"], "max_area_below_min_area", none,
               setting["max_area"]),
        broken(tile["slice_width"] < 64, "slice_width_below_64", none, tile["slice_width"]),
        broken(tile["slice_height"] < 64, "slice_height_below_64", none, tile["slice_height"]),
        broken(~tile["overlap_ratio"].between(0.0, 0.9), "overlap_ratio_range", none,
               tile["overlap_ratio"]),
        broken(tracker["max_age"] < 1, "max_age_below_1", none, tracker["max_age"]),
        broken(tracker["min_hits"] < 1, "min_hits_below_1", none, tracker["min_hits"]),
        broken(~((tracker["iou_threshold"] > 0) & (tracker["iou_threshold"] <= 1)),
               "iou_threshold_range", none, tracker["iou_threshold"]),
    )
    few_points = F.transform(zones, lambda z: broken(
        F.size(z["value"]) < 3, "zone_with_fewer_than_3_points", z["key"], F.size(z["value"])))
    small = F.transform(zones, lambda z: broken(
        (mode == "zones") & (F.size(z["value"]) >= 3)
        & (ring_area(_points(z["value"])) < SMALLEST_ZONE),
        "zone_area_below_100", z["key"], ring_area(_points(z["value"]))))
    lines = F.coalesce(F.col("lines"), F.array().cast(
        "array<struct<name:string,points:array<array<int>>,tolerance:int>>"))

    def length(line):
        a, b = F.get(line["points"], F.lit(0)), F.get(line["points"], F.lit(1))
        return F.hypot(*((F.get(b, F.lit(k)) - F.get(a, F.lit(k))).cast("double") for k in (0, 1)))

    short_lists = F.transform(lines, lambda k: broken(
        F.size(k["points"]) < 2, "line_with_fewer_than_2_points", k["name"], F.size(k["points"])))
    short = F.transform(lines, lambda k: broken(
        (mode == "lines") & (F.size(k["points"]) >= 2) & (length(k) < SHORTEST_LINE),
        "line_shorter_than_10", k["name"], length(k)))
    directions = F.coalesce(F.map_entries("directions"), F.array().cast(
        "array<struct<key:string,value:array<array<int>>>>"))
    pointless = F.transform(directions, lambda d: broken(
        F.size(d["value"]) < 2, "direction_with_fewer_than_2_points", d["key"], F.size(d["value"])))

    def lame(points):
        return F.exists(points, lambda p: F.coalesce(F.size(p) < 2, F.lit(True)))

    def pointless_entries(entries, name, points):
        return F.transform(entries, lambda e: broken(lame(e[points]), "point_without_two_coordinates", e[name], none))

    no_point = [pointless_entries(zones, "key", "value"), pointless_entries(lines, "name", "points"),
                pointless_entries(directions, "key", "value")]
    found = F.array_compact(F.concat(single, few_points, small, short_lists, short, pointless, *no_point))
    return configs.select("site_id", F.inline(found))
