"""Shape limits learnt from boxes."""

from pyspark.sql import Window, functions as F

from flowlattice.functions import geometry as g
from flowlattice.schemas import RUN_CAMERA

# Margins around the smallest and the largest sample.
MARGINS = {"width": (0.70, 1.45), "height": (0.70, 1.45), "area": (0.55, 1.55), "aspect": (0.70, 1.30)}
ASPECT_RANGE = (0.20, 6.0)


def learn_constraints(samples, by=RUN_CAMERA, loaded=None):
    """Limits per group from the extremes of its sample boxes.

    `loaded` (by + the eight limits) fills in for groups without samples.
    """
    f = g.box_features(g.box())
    source = {"width": f["w"], "height": f["h"], "area": f["area"], "aspect": f["aspect"]}
    ends = samples.groupBy(*by).agg(
        *(F.min(e).alias(f"_lo_{n}") for n, e in source.items()),
        *(F.max(e).alias(f"_hi_{n}") for n, e in source.items()))
    out = []
    for name, (low, high) in MARGINS.items():
        lo, hi = F.col(f"_lo_{name}") * F.lit(low), F.col(f"_hi_{name}") * F.lit(high)
        if name == "aspect":
            lo = F.greatest(F.lit(ASPECT_RANGE[0]), lo)
            hi = F.least(F.lit(ASPECT_RANGE[1]), hi)
        else:
            lo = F.greatest(F.lit(1).cast("bigint"), lo.cast("bigint"))
            hi = hi.cast("bigint")
        out += [lo.alias(f"min_{name}"), hi.alias(f"max_{name}")]
    learnt = ends.select(*by, *out)
    if loaded is None:
        return learnt
    names = [f"{side}_{n}" for n in MARGINS for side in ("min", "max")]
    old = loaded.select(*by, *(F.col(n).alias(f"_old_{n}") for n in names))
    return learnt.join(old, list(by), "full").select(
        *by, *(F.coalesce(n, f"_old_{n}").alias(n) for n in names))


def area_bounds(dets, by=RUN_CAMERA):
    """Suggested area limits from the 10 % and 95 % order statistics, exact.

    Areas are counted first; order statistics then come from running counts over the distinct
    areas of a group, which are no more than the pixels of a frame, however many boxes there are.
    """
    b = g.box()
    zero = F.lit(0).cast("bigint")
    area = F.greatest(zero, (b.x2 - b.x1).cast("bigint") * (b.y2 - b.y1))
    counts = dets.groupBy(*by, area.alias("area")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*by).orderBy("area").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("n").over(up))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n_boxes"))
    n = F.col("n_boxes")
    low_at = F.greatest(zero, (n * F.lit(0.10)).cast("bigint") - 1)
    high_at = F.least(n - 1, (n * F.lit(0.95)).cast("bigint"))

    def value_at(index):
        return F.min(F.when(F.col("_upto") > index, F.col("area")))

    low = F.greatest(F.lit(0.0), F.col("_low") * F.lit(0.6)).cast("bigint")
    high = (F.col("_high") * F.lit(1.5)).cast("bigint")
    return (
        placed.join(totals, list(by)).groupBy(*by).agg(
            value_at(low_at).alias("_low"), value_at(high_at).alias("_high"),
            F.max("n_boxes").alias("n_boxes"))
        .select(*by, "n_boxes", low.alias("min_area"),
                F.greatest(low + 1, high).alias("max_area"))
    )


def area_bounds_of_box(boxes):
    """Area limits around one box: half and four times its area."""
    b = g.box()
    area = (b.x2 - b.x1).cast("bigint") * (b.y2 - b.y1)
    return boxes.withColumn("min_area", (area * F.lit(0.5)).cast("bigint")).withColumn(
        "max_area", (area * F.lit(4.0)).cast("bigint"))


def pick_backend(counted, preference, by=("sample_id",)):
    """Backend with most surviving boxes per sample; ties go to the earlier one in `preference`.

    `counted` holds the surviving detections with a `backend` column.
    """
    order = F.array_position(F.array(*(F.lit(p) for p in preference)), F.col("backend"))
    return counted.groupBy(*by, "backend").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
        F.max(F.struct("n", (-order).alias("_tie"), "backend")).alias("_best")).select(
        *by, "_best.backend", "_best.n")
