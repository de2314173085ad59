"""Heading of a track: the configured direction closest to its displacement."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from flowlattice.operators.ordered import fits, span_of
from flowlattice.schemas import LIFE, RUN_CAMERA, TRACK

# Fixed values of the classification.
FEWEST_OBSERVATIONS, SHORTEST_MOVE, LOWEST_SCORE = 5, 10, 0.5


def headings(lived, directions, min_origin=3, total_frames=None):
    """First observation of a life at which a direction fits, and which one.

    `lived` needs `first_cx`, `first_cy` and `obs_no`. `directions` is {name: (start, end)}, or a table of cameras (run_id, camera_id,
    directions, min_origin) with an array of (direction, dx, dy) for every site; ties go to the earlier one. Each row decides alone and the earliest success wins. All but the first
    success of a span are dropped in the order the rows already have, so little is left to group.
    """
    if isinstance(directions, DataFrame):
        return _earliest(_by_site(lived, directions, min_origin), total_frames)
    if not directions:
        return lived.select(*LIFE, F.lit(None).cast("string").alias("direction"),
                            F.lit(None).cast("double").alias("score"), "cls", "frame").limit(0)
    # One plain column per direction keeps the expressions small for the optimizer.
    moved = lived.select(
        *LIFE, "frame", "cls", "obs_no", (F.col("cx") - F.col("first_cx")).cast("double").alias("_dx"),
        (F.col("cy") - F.col("first_cy")).cast("double").alias("_dy"))
    moved = moved.withColumn("_length", F.sqrt(
        F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).filter(
        (F.col("obs_no") >= max(min_origin, FEWEST_OBSERVATIONS)) & (F.col("_length") >= SHORTEST_MOVE))
    scores = []
    for i, (start, end) in enumerate(directions.values()):
        vx, vy = float(end[0] - start[0]), float(end[1] - start[1])
        size = math.sqrt(vx * vx + vy * vy)
        score = F.try_divide(F.col("_dx") * F.lit(vx) + F.col("_dy") * F.lit(vy),
                             F.col("_length") * F.lit(size)) if size else F.lit(0.0)
        scores.append(score.alias(f"_s{i}"))
    names = [f"_s{i}" for i in range(len(scores))]
    best = F.col(names[0]) if len(names) == 1 else F.greatest(*names)
    found = moved.select(*LIFE, "frame", "cls", *scores).withColumn("score", best).filter(
        F.col("score") > LOWEST_SCORE)
    name = F.lit(None).cast("string")
    for column, direction in reversed(list(zip(names, directions))):
        name = F.when(F.col(column) == F.col("score"), F.lit(direction)).otherwise(name)
    return _earliest(found.select(*LIFE, "frame", "cls", "score", name.alias("direction")), total_frames)


def direction_of_row(directions, min_origin=3):
    """The direction that fits a row with `first_cx`, `first_cy` and `obs_no`, or null; the same rule as `headings`, as one column."""
    dx, dy = (F.col("cx") - F.col("first_cx")).cast("double"), (F.col("cy") - F.col("first_cy")).cast("double")
    length = F.sqrt(dx * dx + dy * dy)
    best, name = F.lit(LOWEST_SCORE), F.lit(None).cast("string")
    for direction, (start, end) in directions.items():
        vx, vy = float(end[0] - start[0]), float(end[1] - start[1])
        size = math.sqrt(vx * vx + vy * vy)
        if size:
            score = F.try_divide(dx * F.lit(vx) + dy * F.lit(vy), length * F.lit(size))
            name, best = F.when(score > best, F.lit(direction)).otherwise(name), F.greatest(best, score)
    return F.when((F.col("obs_no") >= max(min_origin, FEWEST_OBSERVATIONS)) & (length >= SHORTEST_MOVE), name)


def _by_site(lived, cameras, min_origin):
    """Rows at which a direction of their own site fits."""
    own = cameras.select(*RUN_CAMERA, "directions", F.coalesce("min_origin", F.lit(min_origin)).alias("_least"))
    moved = lived.join(own, list(RUN_CAMERA)).select(
        *LIFE, "frame", "cls", "obs_no", "directions", "_least", (F.col("cx") - F.col("first_cx")).cast("double").alias("_dx"),
        (F.col("cy") - F.col("first_cy")).cast("double").alias("_dy")).withColumn("_length", F.sqrt(
            F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    moved = moved.filter((F.col("obs_no") >= F.greatest("_least", F.lit(FEWEST_OBSERVATIONS))) & (F.col("_length") >= SHORTEST_MOVE))

    def score(d):
        vx, vy = d["dx"].cast("double"), d["dy"].cast("double")
        return F.coalesce(F.try_divide(F.col("_dx") * vx + F.col("_dy") * vy, F.col("_length") * F.sqrt(vx * vx + vy * vy)), F.lit(0.0))

    scored = moved.withColumn("_scores", F.transform("directions", score)).withColumn("score", F.array_max("_scores"))
    at = (F.array_position("_scores", F.col("score")) - 1).cast("int")
    return scored.filter(F.col("score") > LOWEST_SCORE).select(
        *LIFE, "frame", "cls", "score", F.get("directions", at)["direction"].alias("direction"))


def _earliest(found, total_frames):
    span = [] if fits(total_frames) else [span_of("frame")]
    along = Window.partitionBy(*TRACK, *span).orderBy("frame")
    earliest = found.withColumn("_life_before", F.lag("life").over(along)).filter(
        F.col("_life_before").isNull() | (F.col("_life_before") != F.col("life")))
    return earliest.groupBy(*LIFE).agg(F.min(F.struct(
        "frame", "cls", "score", "direction")).alias("_first")).select(
        *LIFE, "_first.direction", "_first.score", "_first.cls", "_first.frame")
