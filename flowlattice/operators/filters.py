"""Row filters on detections: class, confidence, shape, place."""

from pyspark.sql import functions as F

from flowlattice.functions import geometry as g
from flowlattice.functions.labels import VEHICLES, confidence_floor
from flowlattice.sources.site import SETTING_DEFAULTS, SHAPE_DEFAULTS

# Inclusive bounds; a missing bound does not restrict.
SHAPE_BOUNDS = {"area": ("min_area", "max_area"), "w": ("min_width", "max_width"),
                "h": ("min_height", "max_height"), "aspect": ("min_aspect", "max_aspect")}


def passes_shape(b, limits):
    """All bounds of `limits` (dict of numbers, or a STRUCT column, null = no limit) hold."""
    features = g.box_features(b)
    checks = []
    for feature, (low, high) in SHAPE_BOUNDS.items():
        for name, above in ((low, True), (high, False)):
            if isinstance(limits, dict):
                bound = limits.get(name)
                if bound is None:
                    continue
                bound = F.lit(bound)
            else:
                bound = limits[name]
            check = features[feature] >= bound if above else features[feature] <= bound
            checks.append(check if isinstance(limits, dict) else F.coalesce(check, F.lit(True)))
    passed = F.lit(True)
    for check in checks:
        passed = passed & check
    return passed


def in_any_polygon(px, py, polygons):
    """True inside any of {name: points}, or of an ARRAY<STRUCT<.., ring>> column."""
    if isinstance(polygons, dict):
        hit = F.lit(False)
        for points in polygons.values():
            hit = hit | g.point_in_polygon(px, py, points)
        return hit
    return F.coalesce(F.exists(polygons, lambda z: g.point_in_ring(px, py, z["ring"])), F.lit(False))


def filter_detections(dets, conf_threshold=0.10, conf_per_class=None, limits=None, exclusion=None):
    """Vehicle class, per-class confidence, shape and exclusion polygons, cheap terms first.

    Catalyst cannot turn a per-class threshold into a scan filter, so the lowest threshold is
    added as a plain comparison that reaches the file statistics.
    """
    kept = dets.filter(F.col("cls").isin(*VEHICLES))
    if not hasattr(conf_threshold, "cast") and (conf_per_class is None or isinstance(conf_per_class, dict)):
        lowest = min([float(conf_threshold), *map(float, (conf_per_class or {}).values())])
        kept = kept.filter(F.col("conf") >= lowest)
    kept = kept.filter(F.col("conf") >= confidence_floor(F.col("cls"), conf_threshold, conf_per_class))
    if limits is not None:
        kept = kept.filter(passes_shape(g.box(), limits))
    if exclusion is not None:
        kept = kept.filter(~in_any_polygon(*g.center(g.box()), exclusion))
    return kept


def filter_by_settings(dets, settings, exclusion=None, by=("site_id",)):
    """`filter_detections` with every site's own settings and exclusion zones.

    `settings` and `exclusion` are site tables (see `sources.site`). They are as long as the
    configuration; Spark broadcasts them when their size allows and splits hot sites otherwise.
    """
    by = list(by)
    limits = [name for pair in SHAPE_BOUNDS.values() for name in pair]
    own = settings.select(*by, "conf_threshold", "conf_per_class", F.struct(*limits).alias("_limits"))
    # A camera without a row has the default settings.
    rows = dets.filter(F.col("cls").isin(*VEHICLES)).join(own, by, "left")
    usual = F.struct(*(F.lit({**SHAPE_DEFAULTS, **SETTING_DEFAULTS}[n]).cast(own.schema["_limits"].dataType[n].dataType).alias(n) for n in limits))
    rows = rows.withColumn("_limits", F.coalesce("_limits", usual)).filter(
        (F.col("conf") >= confidence_floor(
            F.col("cls"), F.coalesce("conf_threshold", F.lit(SETTING_DEFAULTS["conf_threshold"])), F.col("conf_per_class")))
        & passes_shape(g.box(), F.col("_limits")))
    if exclusion is not None:
        rings = exclusion.groupBy(*by).agg(F.collect_list(F.struct("ring")).alias("_closed"))
        rows = rows.join(rings, by, "left").filter(
            ~in_any_polygon(*g.center(g.box()), F.col("_closed")))
    return rows.select(*dets.columns)


def filter_roi(dets, roi):
    """Only boxes whose centre lies in a region of interest."""
    return dets.filter(in_any_polygon(*g.center(g.box()), roi))


def boxes_touching(dets, polygon):
    """Only boxes with at least one corner inside the polygon."""
    hit = F.lit(False)
    for x, y in g.box().corners:
        hit = hit | g.point_in_polygon(x, y, polygon)
    return dets.filter(hit)


def passes_sample_constraints(b, constraints):
    """Shape bounds learnt from samples; a null struct lets everything pass."""
    return constraints.isNull() | passes_shape(b, constraints)


def confirmed(observations):
    """Rows that carry a confirmed track id."""
    return observations.filter(F.col("track_id") >= 0)


def filter_tracked(observations, *args, **options):
    """`filter_detections` of rows that come with track ids: rows without a confirmed id (null or negative) go first."""
    return filter_detections(confirmed(observations), *args, **options)
