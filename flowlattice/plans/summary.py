"""Counts, shares and progress over event tables."""

from pyspark.sql import Window, functions as F

from flowlattice.operators.ordered import running, with_trailing
from flowlattice.schemas import FRAME, LIFE, RUN_CAMERA

PROGRESS_EVERY = 60
RATE_WINDOW = 30
_AXIS_BITS = 14
_SKETCH_BITS = 12


def route_counts(events, key="route", by=()):
    return events.groupBy(*by, key).agg(F.count(F.lit(1)).alias("cnt"))


def top_routes(events, n=None, key="route", by=RUN_CAMERA):
    """Every run's routes with their rank, largest first; equal counts by name. `n` keeps the first n of each run."""
    along = Window.partitionBy(*by).orderBy(F.col("cnt").desc(), key)
    ranked = route_counts(events, key, by).withColumn("rank", F.row_number().over(along))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def route_shares(events, key="route", by=RUN_CAMERA):
    """Counts with their share of a run's events in percent and of its largest count.

    The window runs over counts, as many per run as its site has routes.
    """
    run = Window.partitionBy(*by)
    return route_counts(events, key, by).select(
        *by, key, "cnt", (F.col("cnt") * F.lit(100.0) / F.sum("cnt").over(run)).alias("share"),
        (F.col("cnt") / F.max("cnt").over(run).cast("double")).alias("of_largest"))


def od_by_class(events, by=RUN_CAMERA):
    """A run's counts per origin and destination, in total (cls null) and per class."""
    pair = [*by, "origin", "destination"]
    return events.groupingSets([pair, [*pair, "cls"]], *pair, "cls").agg(
        F.count(F.lit(1)).alias("cnt"), F.grouping("cls").alias("is_total"))


def od_rollup(events, by=RUN_CAMERA):
    """A run's counts with all marginals: origin and destination, origin, whole run."""
    sets = [[*by, "origin", "destination"], [*by, "origin"], [*by]]
    return events.groupingSets(sets, *by, "origin", "destination").agg(
        F.count(F.lit(1)).alias("cnt"),
        (F.grouping("origin").cast("bigint") * 2 + F.grouping("destination")).alias("level"))


def od_matrix_long(events, zones=None, by=RUN_CAMERA):
    """Square matrix in long form, per run: every pair of its zones seen in any role or listed in `zones`, zero filled.

    A run's counts are no more than pairs of its site's zones, so they meet in one row; the square is
    spelled out from there and `events` is read once.
    """
    counts = events.groupBy(*by, "origin", "destination").agg(F.count(F.lit(1)).alias("cnt"))
    pair = F.struct("origin", "destination")
    listed = F.array(*map(F.lit, zones or ())).cast("array<string>")
    square = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(pair, "cnt"))).alias("_counts"),
        F.array_sort(F.array_union(listed, F.array_union(F.collect_set("origin"), F.collect_set("destination")))).alias("_zones"))
    pairs = square.select(*by, "_counts", "_zones", F.explode("_zones").alias("origin")).select(
        *by, "_counts", "origin", F.explode("_zones").alias("destination"))
    return pairs.select(*by, "origin", "destination", F.coalesce(
        F.element_at("_counts", pair), F.lit(0)).alias("cnt"))


def od_matrix(events, zones=None, by=RUN_CAMERA):
    """Square matrix per run, one row per origin and one column per zone of any run, which Spark looks up first.

    A zone that a run does not have is null in its rows. For more zones than `spark.sql.pivotMaxValues` use the long form.
    """
    return od_matrix_long(events, zones, by).groupBy(*by, "origin").pivot("destination").agg(F.sum("cnt"))


def vehicles_total(lived, by=RUN_CAMERA, approximate=False):
    """Distinct vehicles ever seen: every life of a track is one."""
    if approximate:
        return lived.groupBy(*by).agg(
            F.approx_count_distinct(F.struct("track_id", "life")).alias("vehicles"))
    # Every life has exactly one opening observation, so no distinct is needed.
    return lived.groupBy(*by).agg(F.sum(F.col("new_life").cast("bigint")).alias("vehicles"))


def vehicle_sketches(lived, frames, by=RUN_CAMERA):
    """A mergeable sketch of the vehicles seen in every stretch of `frames` frames, as long however many there are."""
    vehicle = F.xxhash64("run_id", "camera_id", "track_id", "life")
    return lived.groupBy(*by, F.floor((F.col("frame") - 1) / F.lit(float(frames))).alias("stretch")).agg(
        F.hll_sketch_agg(vehicle, F.lit(_SKETCH_BITS)).alias("sketch"))


def merged_vehicles(sketches, by=RUN_CAMERA):
    """Distinct vehicles over stretches, cameras or runs: vehicles in several of them count once. Within about 1.6 %, two times in three."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def frame_axis(runs):
    """Every frame of every run of `runs` (run_id, camera_id, total_frames), from 1, made in spans so that no row holds a whole run."""
    last_span = F.shiftright(F.col("total_frames"), _AXIS_BITS)
    spans = runs.filter("total_frames >= 1").select(
        *RUN_CAMERA, "total_frames", F.explode(F.sequence(F.lit(0).cast("bigint"), last_span)).alias("_span"))
    low = F.shiftleft("_span", _AXIS_BITS)
    high = F.least("total_frames", low + (1 << _AXIS_BITS) - 1)
    return spans.select(*RUN_CAMERA, F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("frame"))


def active_per_frame(obs, runs):
    """Boxes of every frame of the runs, also of frames without any."""
    seen = obs.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("active"))
    return frame_axis(runs).join(seen, list(FRAME), "left").withColumn("active", F.coalesce("active", F.lit(0)))


def class_totals(rows, by=RUN_CAMERA):
    return rows.groupBy(*by, F.coalesce("cls", F.lit("unknown")).alias("cls")).agg(F.count(F.lit(1)).alias("cnt"))


def vehicles_by_class(labelled):
    """Distinct tracks per class, taking a track's first known class."""
    first = labelled.filter("cls <> 'unknown'").groupBy(*RUN_CAMERA, "track_id").agg(
        F.min(F.struct("frame", "cls")).alias("_first")).select(*RUN_CAMERA, F.col("_first.cls").alias("cls"))
    return class_totals(first)


def rolling_rate(rates, value="rate", n=RATE_WINDOW, total_frames=None):
    """Mean of the values of the last n frames, fewer at the start of a run; `rates` has a row for every frame."""
    def look(window):
        return {"rolling": F.avg(value).over(window.rowsBetween(-(n - 1), 0))}

    return with_trailing(rates, RUN_CAMERA, "frame", n - 1, look, bound=total_frames)


def progress_samples(events, runs, every=PROGRESS_EVERY, total_frames=None):
    """Routes so far at every `every`-th frame, with percent done and share of frames left.

    `runs` gives (run_id, camera_id, total_frames). Events are counted per step first; the running
    sum then has one row per step, and steps without events keep the last value.
    """
    step = F.ceil(F.col("frame") / F.lit(float(every)))
    counted = events.groupBy(*RUN_CAMERA, step.alias("step")).agg(
        F.count(F.lit(1)).alias("new_routes"))
    steps = runs.filter(F.col("total_frames") >= every).select(*RUN_CAMERA, "total_frames", F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.floor(F.col("total_frames") / F.lit(float(every))))).alias("step"))
    filled = steps.join(counted, [*RUN_CAMERA, "step"], "left").select(
        *RUN_CAMERA, "step", "total_frames", F.coalesce("new_routes", F.lit(0)).alias("new_routes"))
    frame = F.col("step") * every
    return running(filled, RUN_CAMERA, "step", {"routes": F.col("new_routes")}, bound=total_frames).select(
        *RUN_CAMERA, frame.alias("frame"), "routes",
        (frame * F.lit(100.0) / F.col("total_frames")).alias("pct"),
        (F.col("total_frames") - frame).alias("frames_left"))


def with_clock(progress, fps):
    """Adds elapsed and remaining seconds, given how many frames are processed per second."""
    rate = F.lit(float(fps))
    return progress.withColumn("elapsed", F.col("frame") / rate).withColumn(
        "eta", F.col("frames_left") / rate)


def route_events(events, total_frames=None):
    """Every completed route with the count its key has reached in its run so far."""
    keyed = events.groupBy("run_id", "camera_id", "route", "frame").agg(
        F.count(F.lit(1)).alias("new"), F.min("cls").alias("cls"))
    return running(keyed, ["run_id", "camera_id", "route"], "frame", {"cnt": F.col("new")},
                   bound=total_frames)


def flow_per_window(obs, seconds=3600):
    """Boxes and distinct classes per tumbling event-time window and camera."""
    ts = F.col("ts").cast("timestamp")
    return obs.groupBy(*RUN_CAMERA, F.window(ts, f"{seconds} seconds").alias("_w"), "cls").agg(
        F.count(F.lit(1)).alias("boxes")).select(
        *RUN_CAMERA, F.unix_timestamp("_w.start").alias("window_start"), "cls", "boxes")


def run_summary(lived, events, runs, by=RUN_CAMERA):
    """Totals of every run in `runs` (run_id, camera_id, total_frames), also of runs without a box.

    Frames, vehicles, completed routes, and the routes as a map with the largest first.
    """
    by = list(by)
    seen = lived.groupBy(*by).agg(F.sum(F.col("new_life").cast("bigint")).alias("_vehicles"))
    routes = route_counts(events, by=by).groupBy(*by).agg(
        F.sum("cnt").alias("_done"),
        F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("rank"), "route", "cnt"))).alias("_l"))
    listed = F.map_from_entries(F.transform(
        F.coalesce("_l", F.array().cast("array<struct<rank:bigint,route:string,cnt:bigint>>")), lambda e: F.struct(e["route"], e["cnt"])))
    return runs.join(seen, by, "left").join(routes, by, "left").select(
        *by, F.col("total_frames").alias("frames_processed"), F.coalesce("_vehicles", F.lit(0)).alias("total_vehicles_tracked"),
        F.coalesce("_done", F.lit(0)).alias("total_routes_completed"), listed.alias("routes"))
