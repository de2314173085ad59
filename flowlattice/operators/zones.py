"""Which zone a point lies in."""

from pyspark.sql import Column, DataFrame, functions as F

from flowlattice.functions import geometry as g
from flowlattice.schemas import RUN_CAMERA


def collapse_zones(zones, by=("site_id",)):
    """Site zones (.., zone_order, zone, ring) as one row per site with an ordered array.

    The array is as long as the site's configuration, never as long as its data.
    """
    return zones.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("zone_order", "zone", "ring"))).alias("_zones"))


def _first_zone(px, py, zones, bounds):
    inside = F.lit(True)
    if bounds is not None:
        # A mask is defined on the frame only.
        width, height = bounds
        inside = px.between(0, width - 1) & py.between(0, height - 1)
    if isinstance(zones, dict):
        order = F.lit(None).cast("int")
        for i, points in reversed(list(enumerate(zones.values()))):
            order = F.when(inside & g.point_in_polygon(px, py, points), F.lit(i)).otherwise(order)
        names = F.array(*(F.lit(n) for n in zones)).cast("array<string>")
        return order, F.get(names, F.col("zone_order"))
    hit = F.get(F.filter(zones, lambda z: inside & g.point_in_ring(px, py, z["ring"])), F.lit(0))
    return hit["zone_order"], hit["zone"]


def zone_of_point(obs, zones, x="cx", y="cy", by=RUN_CAMERA, bounds=None):
    """Adds `zone` and `zone_order`: the first zone, in order, that holds the point, else null.

    `zones` is {name: points} for one site (an inline expression, no join), or a DataFrame
    (*by, zone_order, zone, ring) for many. The latter is joined by key; Spark broadcasts it when
    its size allows and splits hot cameras otherwise.
    """
    px, py = F.col(x), F.col(y)
    if isinstance(zones, DataFrame):
        obs = obs.join(collapse_zones(zones, by), list(by), "left")
        order, name = _first_zone(px, py, F.col("_zones"), bounds)
        return obs.withColumn("zone_order", order).withColumn("zone", name).drop("_zones")
    order, name = _first_zone(px, py, zones, bounds)
    return obs.withColumn("zone_order", order).withColumn("zone", name)


def zone_spans(zones, width, height, by=("site_id",)):
    """Raster masks as pixel spans (zone_order, zone, y, x_from, x_to), clipped to the frame.

    A scan line at an integer y meets the ring in pairs of crossings; the pixels between a pair,
    ends included, belong to the mask. Horizontal edges add their own pixels. The frame's size may be columns of `zones`.
    """
    width, height = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    n = F.size("ring")
    following = F.concat(F.slice("ring", 2, F.greatest(n - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = F.zip_with("ring", following, lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    shaped = zones.select(*by, "zone_order", "zone", edges.alias("_edges"), width.alias("_width"), height.alias("_height"))
    lows = F.array_min(F.transform("_edges", lambda e: e["ay"]))
    highs = F.array_max(F.transform("_edges", lambda e: e["ay"]))
    lows, highs = F.greatest(F.lit(0), lows), F.least(F.col("_height") - 1, highs)
    lines = shaped.select("*", F.explode(F.when(
        lows <= highs, F.sequence(lows, highs)).otherwise(F.array().cast("array<int>"))).alias("y"))

    def cut(e):
        slope = (F.col("y") - e["ay"]) * F.try_divide(
            (e["bx"] - e["ax"]).cast("double"), (e["by"] - e["ay"]).cast("double"))
        return e["ax"] + slope

    # Each pass counts an edge on one of its ends only, so vertices pair up. Both passes together
    # cover the scan lines just below and just above a vertex.
    def crossings(lower_end):
        def meets(e):
            lo, hi = F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
            inside = (lo <= F.col("y")) & (F.col("y") < hi) if lower_end else (
                (lo < F.col("y")) & (F.col("y") <= hi))
            return (lo < hi) & inside

        return F.array_sort(F.transform(F.filter("_edges", meets), cut))

    def paired(xs):
        pairs = F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1)
        return F.when(F.size(xs) >= 2, F.transform(pairs, lambda i: F.struct(
            F.get(xs, i * 2).alias("x_from"), F.get(xs, i * 2 + 1).alias("x_to")))
        ).otherwise(F.array().cast("array<struct<x_from:double,x_to:double>>"))

    flat = F.transform(
        F.filter("_edges", lambda e: (e["ay"] == F.col("y")) & (e["by"] == F.col("y"))),
        lambda e: F.struct(F.least(e["ax"], e["bx"]).cast("double").alias("x_from"),
                           F.greatest(e["ax"], e["bx"]).cast("double").alias("x_to")))
    spans = F.concat(paired(crossings(True)), paired(crossings(False)), flat)
    return (
        lines.select(*by, "zone_order", "zone", "y", "_width", F.inline(spans))
        .select(*by, "zone_order", "zone", "y",
                F.greatest(F.lit(0), F.round("x_from").cast("int")).alias("x_from"),
                F.least(F.col("_width") - 1, F.round("x_to").cast("int")).alias("x_to"))
        .filter("x_from <= x_to").distinct()
    )


def zone_of_point_raster(obs, zones, width, height, x="cx", y="cy", by=RUN_CAMERA):
    """The mask variant of `zone_of_point`: only points on the frame can match. The frame's size may be columns of `zones`.

    Spans are folded to one row per (site, scan line) before the join, so the join is an equi-join
    that keeps the observations' row count and needs no second grouping.
    """
    rows = zone_spans(zones, width, height, by).groupBy(*by, "y").agg(F.array_sort(
        F.collect_list(F.struct("zone_order", "zone", "x_from", "x_to"))).alias("_spans"))
    joined = obs.join(rows.withColumnRenamed("y", y), [*by, y], "left")
    hit = F.get(F.filter("_spans", lambda s: F.col(x).between(s["x_from"], s["x_to"])), F.lit(0))
    return joined.withColumn("zone_order", hit["zone_order"]).withColumn("zone", hit["zone"]).select(
        *obs.columns, "zone_order", "zone")


def zone_geometry(zones):
    """Area and vertex mean of every zone."""
    cx, cy = g.ring_centroid(F.col("ring"))
    return zones.withColumn("area", g.ring_area(F.col("ring"))).withColumn(
        "label_x", cx).withColumn("label_y", cy)
