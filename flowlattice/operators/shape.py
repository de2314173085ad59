"""Per-track statistics: shape averages, trails and the track report."""

from pyspark.sql import Window, functions as F

from flowlattice.functions import geometry as g
from flowlattice.operators.ordered import fits
from flowlattice.schemas import LIFE

ALPHA = 0.3
TRAIL = 64
_BLOCK_BITS = 10
AVERAGES = {"avg_width": "w", "avg_height": "h", "avg_area": "area", "avg_aspect": "aspect",
            "avg_elongation": "elongation"}


def shape_ema(lived, alpha=ALPHA, total_frames=None):
    """Exponential averages of the box features over the observations of a life.

    The recurrence is a weighted sum: the i-th of n values weighs alpha*(1-alpha)^(n-i), the first
    (1-alpha)^(n-1). Weights are taken relative to blocks of 1,024 observations, so plain partial
    sums do the work and stay within the range of a double. When `total_frames`, the longest run, is
    known to be short, the few blocks of a life meet in one row; otherwise they are joined with the
    life's length and summed again.
    """
    keep = 1.0 - alpha
    if keep ** (1 << _BLOCK_BITS) < 1e-290:
        raise ValueError("alpha too large for the block size")
    i = F.col("obs_no")
    features = g.box_features(g.box())
    weight = F.when(i == 1, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(
        F.lit(keep), -F.pmod(i - 1, F.lit(1 << _BLOCK_BITS)).cast("double"))
    blocks = lived.groupBy(*LIFE, F.shiftright(i - 1, _BLOCK_BITS).alias("_block")).agg(
        F.max("obs_no").alias("_n"),
        *(F.sum(weight * features[f]).alias(name) for name, f in AVERAGES.items()))
    if fits(total_frames):
        names = ", ".join(AVERAGES)
        lives = blocks.groupBy(*LIFE).agg(
            F.max("_n").alias("samples"), F.collect_list(F.expr(f"struct(_block, {names})")).alias("_b"))
        return lives.select(*LIFE, "samples", *(F.expr(
            f"aggregate(_b, 0D, (s, b) -> s + b.{name} * "
            f"pow({keep}D, samples - 1 - shiftleft(b._block, {_BLOCK_BITS})))").alias(name)
            for name in AVERAGES))
    totals = blocks.groupBy(*LIFE).agg(F.max("_n").alias("samples"))
    ahead = F.pow(F.lit(keep), (
        F.col("samples") - 1 - F.shiftleft("_block", _BLOCK_BITS)).cast("double"))
    return blocks.join(totals, list(LIFE)).groupBy(*LIFE).agg(
        F.max("samples").alias("samples"),
        *(F.sum(F.col(name) * ahead).alias(name) for name in AVERAGES))


def trails(lived, n=TRAIL):
    """The last n centres of every life, oldest first.

    The rank filter becomes a per-task top-n before the shuffle, so a hot life sends n rows per
    task and not all of its rows.
    """
    latest = Window.partitionBy(*LIFE).orderBy(F.col("frame").desc())
    kept = lived.select(*LIFE, "frame", "cx", "cy", F.row_number().over(latest).alias("_back"))
    return kept.filter(F.col("_back") <= n).groupBy(*LIFE).agg(F.array_sort(F.collect_list(
        F.struct("frame", "cx", "cy"))).alias("trail"))


def track_report(lived, lives, states, total_frames=None):
    """One row per life still held at the end of the run.

    `lives` comes from `track_lives`; `states` gives (life key, cls, state, origin, direction) of
    the counting mode in use. The first point is the oldest one still in the trail.
    """
    keys = list(LIFE)
    points = trails(lived).select(
        *keys, F.col("trail")[0].alias("_a"), F.element_at("trail", -1).alias("_z"),
        F.size("trail").alias("trail_length"))
    shape = shape_ema(lived, total_frames=total_frames)
    digits = {"avg_width": 1, "avg_height": 1, "avg_area": 1, "avg_aspect": 2, "avg_elongation": 2}
    report = (
        lives.filter("survives").select(*keys, F.col("last_frame").alias("last_seen_frame"))
        .join(states, keys, "left").join(points, keys, "left").join(shape, keys, "left")
    )
    return report.select(
        "run_id", "camera_id", "track_id", F.col("cls").alias("class"), "state", "origin", "direction",
        F.col("_a.cx").alias("first_x"), F.col("_a.cy").alias("first_y"),
        F.col("_z.cx").alias("last_x"), F.col("_z.cy").alias("last_y"),
        "trail_length", "last_seen_frame",
        *(F.round(name, d).alias(name) for name, d in digits.items()))


def zone_states(routes):
    return routes.select(*LIFE, "cls", "state", "origin", F.lit(None).cast("string").alias("direction"))


def heading_states(lived, found):
    """States of heading mode, for lives with and without an assigned direction."""
    seen = lived.groupBy(*LIFE).agg(F.min(F.struct("frame", "cls")).alias("_head"))
    assigned = found.select(*LIFE, "direction")
    return seen.join(assigned, list(LIFE), "left").select(
        *LIFE, F.col("_head.cls").alias("cls"),
        F.when(F.col("direction").isNull(), "tracking").otherwise("done").alias("state"),
        F.lit(None).cast("string").alias("origin"), "direction")


def crossing_states(lived, crossings):
    """States of line mode: `done` once the life has crossed any line."""
    seen = lived.groupBy(*LIFE).agg(F.min(F.struct("frame", "cls")).alias("_head"))
    crossed = crossings.select(*LIFE).distinct().withColumn("_done", F.lit(True))
    return seen.join(crossed, list(LIFE), "left").select(
        *LIFE, F.col("_head.cls").alias("cls"),
        F.when(F.col("_done"), "done").otherwise("new").alias("state"),
        F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("direction"))
