"""Everything about a life in one aggregate: extent, shape averages, trail, and the state of the counting mode.

Rows of a life are grouped in blocks of 1,024 observations; a block gives partial sums, its last points and, for zones, its function
from entry state to exit state. The blocks of a life are then put together in one row. Both steps keep the partitioning by
track that lives have, so the rows are shuffled once in all and nothing is written in between.
"""

from pyspark.sql import functions as F

from flowlattice.functions import geometry as g
from flowlattice.operators import headings as heading_ops, routes
from flowlattice.operators.shape import ALPHA, AVERAGES, TRAIL
from flowlattice.schemas import LIFE

_BLOCK_BITS = 10


def _zone_machine(zone_names, min_origin, min_dest, direct):
    """(column of a row, function of a block, state of a life, its output) of the route machine."""
    low, high, n = max(1, min_origin), max(2, min_dest), len(zone_names)
    fresh, step = routes._state(routes.NEW), routes._step(low, high, direct)
    entered = f"IF(_block = 0, array({fresh}), {routes._entry_states(n, low, high)})"
    follow = f"IF(s.st = {routes.DONE}, s, get(c.exits, CAST({routes._entry_index(n, low, high)} AS INT)))"
    names = F.array(*map(F.lit, zone_names)).cast("array<string>")
    end = F.col("_end")
    done = end["st"] == routes.DONE
    return {
        "row": F.expr("CASE WHEN zone_order IS NOT NULL OR new_life OR prev_zone_order IS NOT NULL "
                      "THEN struct(frame, CAST(coalesce(zone_order, -1) AS INT) AS z) END"),
        "block": F.expr(f"transform({entered}, e -> aggregate(array_sort(_seq), e, (s, r) -> {step}))"),
        "life": F.expr(f"aggregate(array_sort(_exits), {fresh}, (s, c) -> {follow})"),
        "output": [F.get(F.array(*map(F.lit, routes.STATE_NAMES)), end["st"]).alias("state"),
                   F.when(end["o"] >= 0, F.get(names, end["o"])).alias("origin"),
                   F.when(done, F.get(names, end["d"])).alias("destination"), F.lit(None).cast("string").alias("direction"),
                   end["at"].alias("done_at")]}


def life_reports(lived, zone_names=None, directions=None, min_origin=3, min_dest=3, direct="confirm", alpha=ALPHA, trail=TRAIL):
    """One row per life: first_frame, last_frame, n_obs, cls (at first sight), first and last point of the trail and its length, the
    shape averages, and state, origin, destination, direction, done_at of the counting mode.

    With `zone_names` rows need `zone_order` and `prev_zone_order`, and states are those of `routes.zone_routes`; with `directions`
    rows need `first_cx`, `first_cy`, and a life is `tracking` until it is `done`. Without either it is `new`. Lives with repeated frames are
    not defined, an empty table has no lives.
    """
    keep = 1.0 - alpha
    at = F.col("obs_no") - 1
    weight = F.when(at == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(keep), -F.pmod(at, F.lit(1 << _BLOCK_BITS)).cast("double"))
    if keep ** (1 << _BLOCK_BITS) < 1e-290:
        raise ValueError("alpha too large for the block size")
    features = g.box_features(g.box())
    point = F.struct("frame", "cx", "cy")
    machine = _zone_machine(zone_names, min_origin, min_dest, direct) if zone_names is not None else None
    rows = lived.withColumn("_block", F.shiftright(at, _BLOCK_BITS))
    if directions is not None:
        rows = rows.withColumn("_fits", heading_ops.direction_of_row(directions, min_origin))
    parts = [F.min(F.struct("frame", "cls")).alias("_head"), F.max("frame").alias("_last"), F.max("obs_no").alias("_n"),
             F.collect_list(point).alias("_points"),
             *(F.sum(weight * features[f]).alias(name) for name, f in AVERAGES.items())]
    if machine:
        parts.append(F.collect_list(machine["row"]).alias("_seq"))
    if directions is not None:
        parts.append(F.min(F.when(F.col("_fits").isNotNull(), F.struct("frame", F.col("_fits").alias("direction")))).alias("_found"))
    blocks = rows.groupBy(*LIFE, "_block").agg(*parts)
    many = F.least(F.size("_points"), F.lit(trail))
    blocks = blocks.withColumn("_points", F.slice(F.array_sort("_points"), F.size("_points") - many + 1, many))
    if machine:
        blocks = blocks.withColumn("exits", machine["block"])
    ahead = F.collect_list(F.struct("_block", *AVERAGES)).alias("_sums")
    whole = [F.min("_head").alias("_head"), F.max("_last").alias("last_frame"), F.max("_n").alias("n_obs"), ahead,
             F.collect_list(F.struct("_block", "_points")).alias("_trails")]
    if machine:
        whole.append(F.collect_list(F.struct("_block", "exits")).alias("_exits"))
    if directions is not None:
        whole.append(F.min("_found").alias("_found"))
    lives = blocks.groupBy(*LIFE).agg(*whole)
    if machine:
        lives, state = lives.withColumn("_end", machine["life"]), machine["output"]
    else:
        found = F.col("_found") if directions is not None else F.lit(None).cast("struct<frame:bigint,direction:string>")
        state = [F.when(found.isNotNull(), "done").otherwise("tracking" if directions is not None else "new").alias("state"),
                 F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("destination"),
                 found["direction"].alias("direction"), found["frame"].alias("done_at")]
    averages = [F.expr(f"aggregate(_sums, 0D, (s, b) -> s + b.{name} * pow({keep}D, n_obs - 1 - shiftleft(b._block, {_BLOCK_BITS})))").alias(name)
                for name in AVERAGES]
    points = F.flatten(F.transform(F.array_sort("_trails"), lambda t: t["_points"]))
    lives = lives.withColumn("_all", points).withColumn("_kept", F.least(F.size("_all"), F.lit(trail)))
    first, last = F.element_at("_all", -F.col("_kept")), F.element_at("_all", -1)
    return lives.select(
        *LIFE, F.col("_head.cls").alias("cls"), F.col("_head.frame").alias("first_frame"), "last_frame", "n_obs", *state,
        first["cx"].alias("first_x"), first["cy"].alias("first_y"), last["cx"].alias("last_x"), last["cy"].alias("last_y"),
        F.col("_kept").alias("trail_length"), *averages)


def track_report(reports, ends, every, limit):
    """The lives of `life_reports` that are still held when their run ends; `ends` is (run_id, camera_id, last_frame_of_run)."""
    digits = {"avg_width": 1, "avg_height": 1, "avg_area": 1, "avg_aspect": 2, "avg_elongation": 2}
    last_purge = F.floor(F.col("last_frame_of_run") / F.lit(float(every))) * every
    return reports.join(ends, ["run_id", "camera_id"]).filter(last_purge - F.col("last_frame") <= limit).select(
        "run_id", "camera_id", "track_id", F.col("cls").alias("class"), "state", "origin", "direction", "first_x", "first_y", "last_x", "last_y",
        "trail_length", F.col("last_frame").alias("last_seen_frame"), *(F.round(name, d).alias(name) for name, d in digits.items()))


def with_crossings(reports, crossings):
    """Line mode: lives are done once they have crossed a line."""
    crossed = crossings.groupBy(*LIFE).agg(F.min("frame").alias("_crossed"))
    return reports.drop("state", "done_at").join(crossed, list(LIFE), "left").select(
        "*", F.when(F.col("_crossed").isNotNull(), "done").otherwise("new").alias("state"), F.col("_crossed").alias("done_at")).drop("_crossed")


def run_totals(reports, runs):
    """Totals of every run in `runs` (run_id, camera_id, total_frames): frames, vehicles, what was completed, and its names with counts.

    `reports` are the lives of zone or heading mode; what a life completes is its route or its direction.
    """
    name = F.when(F.col("state") == "done", F.coalesce("direction", routes.route_key(F.col("origin"), F.col("destination"))))
    per_name = reports.groupBy("run_id", "camera_id", name.alias("_name")).agg(F.count(F.lit(1)).alias("_lives"))
    done = F.when(F.col("_name").isNotNull(), F.struct((-F.col("_lives")).alias("rank"), F.col("_name").alias("name"), F.col("_lives").alias("cnt")))
    totals = per_name.groupBy("run_id", "camera_id").agg(
        F.sum("_lives").alias("_vehicles"), F.sum(F.when(F.col("_name").isNotNull(), F.col("_lives"))).alias("_done"),
        F.array_sort(F.collect_list(done)).alias("_names"))
    listed = F.map_from_entries(F.transform(
        F.coalesce("_names", F.array().cast("array<struct<rank:bigint,name:string,cnt:bigint>>")), lambda e: F.struct(e["name"], e["cnt"])))
    return runs.join(totals, ["run_id", "camera_id"], "left").select(
        "run_id", "camera_id", F.col("total_frames").alias("frames_processed"), F.coalesce("_vehicles", F.lit(0)).alias("total_vehicles_tracked"),
        F.coalesce("_done", F.lit(0)).alias("total_routes_completed"), listed.alias("routes"))
