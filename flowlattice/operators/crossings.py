"""Directional line crossings, in the three semantics users may want.

* `settled`: the track stays N qualifying observations in a row on the new side.
* `strict`: side change against the previous centre, with a shared side history that a count clears.
* `simple`: sign change of the centre between two observations.
"""

from pyspark.sql import DataFrame, Window, functions as F

from flowlattice.functions import geometry as g
from flowlattice.functions.labels import DOWN, UP, crossing_key
from flowlattice.operators.ordered import fits, with_trailing
from flowlattice.schemas import LIFE, RUN_CAMERA, TRACK



def line_array(lines):
    return F.array(*(F.struct(
        F.lit(i).alias("line_order"), F.lit(line["name"]).alias("line"),
        *(F.lit(int(v)).alias(n) for n, v in zip(
            ("lx1", "ly1", "lx2", "ly2"), (*line["pt1"], *line["pt2"]))),
        F.lit(int(line.get("tolerance", 15))).alias("tolerance"),
    ) for i, line in enumerate(lines)))


def per_line(obs, lines, by=RUN_CAMERA):
    """One row per observation and counting line of its site.

    `lines` is a list of {name, pt1, pt2, tolerance} or a DataFrame
    (*by, line_order, line, lx1, ly1, lx2, ly2, tolerance).
    """
    if isinstance(lines, DataFrame):
        return obs.join(lines, list(by))
    return obs.select("*", F.inline(line_array(lines)))


def _ends(line):
    return [line[c] if line is not None else F.col(c) for c in ("lx1", "ly1", "lx2", "ly2")]


def shared_side(anchors="box", line=None):
    """1 or -1 when all anchors lie on that side of the line, 0 when they straddle or touch it.

    Anchors are the centre and, with `anchors="box"`, the four corners. `line` is a struct with the
    line's ends; without it they are columns of the row.
    """
    points = [(F.col("cx"), F.col("cy"))] + (g.box().corners if anchors == "box" else [])
    sides = [g.line_side(px, py, *_ends(line)) for px, py in points]
    above = sides[0] > 0 if len(sides) == 1 else F.greatest(*sides) > 0
    below = sides[0] < 0 if len(sides) == 1 else F.least(*sides) < 0
    return above.cast("int") - below.cast("int")


def side_near(line, anchors="box"):
    """`shared_side` within the line's tolerance, 0 beyond it."""
    near = g.line_distance("cx", "cy", *_ends(line)) <= line["tolerance"]
    return F.when(near, shared_side(anchors, line)).otherwise(F.lit(0))


def near_lines(obs, lines, anchors="box", by=RUN_CAMERA):
    """Observations within tolerance of a line, with distance and `side` (see `shared_side`)."""
    rows = per_line(obs, lines, by).withColumn(
        "distance", g.line_distance("cx", "cy", *_ends(None)))
    return rows.filter(F.col("distance") <= F.col("tolerance")).withColumn(
        "side", shared_side(anchors))


def _first_per_key(events, keys):
    return events.groupBy(*keys, "line", "direction").agg(
        F.min(F.struct("frame", "cls")).alias("_first")).select(
        *keys, "line", "direction", F.col("_first.cls").alias("cls"),
        F.col("_first.frame").alias("frame"),
        crossing_key(F.col("line"), F.col("direction")).alias("route"))


def _direction(cy, before):
    return F.when(cy > before, F.lit(DOWN)).otherwise(F.lit(UP))


def crossings_settled(lived, lines, min_crossing=2, anchors="box", by=RUN_CAMERA, total_frames=None):
    """A crossing counts at the N-th qualifying observation in a row on the new side."""
    n = max(1, min_crossing)
    rows = near_lines(lived, lines, anchors, by).filter("side <> 0").select(
        *LIFE, "line_order", "line", "frame", "cy", "cls", "side")

    def look(window):
        built = {f"_side{k}": F.lag("side", k).over(window) for k in range(1, n + 1)}
        built["_cy_before"] = F.lag("cy", n).over(window)
        built["_cy_change"] = F.lag("cy", n - 1).over(window) if n > 1 else F.col("cy")
        return built

    rows = with_trailing(rows, [*LIFE, "line_order"], "frame", n, look, bound=total_frames)
    fires = F.col(f"_side{n}") == -F.col("side")
    for k in range(1, n):
        fires = fires & (F.col(f"_side{k}") == F.col("side"))
    events = rows.filter(fires).withColumn(
        "direction", _direction(F.col("_cy_change"), F.col("_cy_before")))
    return _first_per_key(events, LIFE)


def crossings_simple(lived, lines, by=RUN_CAMERA):
    """Sign change of the centre's side, taking the previous y at the present x."""
    ends = _ends(None)
    rows = per_line(lived.filter(~F.col("new_life")), lines, by)
    events = rows.filter(
        (g.line_distance("cx", "cy", *ends) <= F.col("tolerance"))
        & (F.signum(g.line_side("cx", "prev_cy", *ends).cast("double"))
           * F.signum(g.line_side("cx", "cy", *ends).cast("double")) < 0))
    events = events.withColumn("direction", _direction(F.col("cy"), F.col("prev_cy")))
    return _first_per_key(events, LIFE)


def crossings_strict(lived, lines, min_crossing=2, anchors="box", by=RUN_CAMERA, total_frames=None):
    """Side change against the previous centre, confirmed by the line's side history.

    The history keeps the last N+1 qualifying sides since it was cleared, a count needs at least N
    of them and all equal, and a count clears the track's history on every line. The raw sides before a row do not depend on what
    counted, so a row's history is known up to one thing: where the last clear was. Rows that could count for some place of the last
    clear are few; a life's are folded in order by an automaton whose state is that place and what was counted. The fold and
    the windows before it keep the partitioning by track that lives have, so no rows move.

    A candidate whose N+1 sides agree only fails when a clear falls among its last N rows. A life clears at most once per line and
    direction, so of each line and direction only the first few such candidates are kept. The others need a clear between two
    of their rows, so they are kept only behind another candidate.
    """
    n = max(1, min_crossing)
    ends = _ends(None)
    rows = near_lines(lived.filter(~F.col("new_life")), lines, anchors, by).filter("side <> 0")
    previous = F.when(g.line_side("prev_cx", "prev_cy", *ends) > 0, 1).otherwise(-1)
    rows = rows.select(
        *LIFE, "line_order", "line", "frame", "cls", "side",
        (previous * F.col("side") < 0).alias("_flips"),
        _direction(F.col("cy"), F.col("prev_cy")).alias("direction"))

    def look(window):
        built = {f"_side{k}": F.lag("side", k).over(window) for k in range(1, n + 1)}
        built["_needs_after"] = F.lag("frame", n - 1).over(window) if n > 1 else F.col("frame")
        built["_older"] = F.lag("frame", n).over(window)
        return built

    rows = with_trailing(rows, [*LIFE, "line_order"], "frame", n, look, bound=total_frames)
    steady = F.col("_flips") & F.col("_needs_after").isNotNull()
    for k in range(1, n):
        steady = steady & (F.col(f"_side{k}") == F.col("side"))
    candidates = rows.filter(steady).select(
        *LIFE, "frame", "line_order", "line", "direction", "cls", "_needs_after", "_older",
        F.coalesce(F.col(f"_side{n}") == F.col("side"), F.lit(True)).alias("_sure"))
    candidates = _that_may_count(candidates, n, lines, total_frames)

    at = "struct<frame:bigint,line_order:int>"
    event = "array<struct<line:string,direction:string,cls:string,frame:bigint>>"
    start = F.expr(f"named_struct('clear', CAST(NULL AS {at}), 'seen', CAST(array() AS array<string>), 'events', CAST(array() AS {event}))")

    def step(state, row):
        def after_clear(frame):
            place = F.struct(frame.cast("bigint").alias("frame"), row["line_order"].cast("int").alias("line_order"))
            return F.coalesce(place > state["clear"], F.lit(True))

        key = crossing_key(row["line"], row["direction"])
        counts = (~F.array_contains(state["seen"], key) & after_clear(row["_needs_after"])
                  & (row["_sure"] | (state["clear"].isNotNull() & ~after_clear(row["_older"]))))
        counted = F.struct(
            F.struct(row["frame"].cast("bigint").alias("frame"), row["line_order"].cast("int").alias("line_order")).alias("clear"),
            F.array_append(state["seen"], key).alias("seen"),
            F.array_append(state["events"], F.struct(*(row[c].alias(c) for c in ("line", "direction", "cls", "frame")))).alias("events"))
        return F.when(counts, counted).otherwise(state)

    columns = ("frame", "line_order", "line", "direction", "cls", "_needs_after", "_older", "_sure")
    walks = candidates.groupBy(*LIFE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))
    return walks.select(*LIFE, F.inline(F.aggregate("_rows", start, step)["events"])).withColumn(
        "route", crossing_key(F.col("line"), F.col("direction")))


def _that_may_count(candidates, n, lines, total_frames):
    """Candidates that some course of counts could reach, see `crossings_strict`."""
    if isinstance(lines, DataFrame) or not fits(total_frames):
        # Runs of unknown length, or sites of unknown size: all candidates are folded.
        return candidates
    most = 2 * len(lines) * n + 1
    key = Window.partitionBy(*LIFE, "line_order", "direction", "_sure").orderBy("frame")
    along = Window.partitionBy(*LIFE).orderBy("frame", "line_order")
    ranked = candidates.withColumns({"_rank": F.row_number().over(key), "_near": F.lag("frame").over(along)})
    return ranked.filter((F.col("_sure") & (F.col("_rank") <= most)) | (~F.col("_sure") & (F.col("_near") >= F.col("_older"))))


SEMANTICS = {"settled": crossings_settled, "strict": crossings_strict}


def line_crossings(lived, lines, min_crossing=2, semantics="settled", **options):
    if semantics == "simple":
        return crossings_simple(lived, lines, **options)
    return SEMANTICS[semantics](lived, lines, min_crossing, **options)


def gate_crossings(lived, width="frame_width", height="frame_height", ratios=(0.5, 0.7), tolerance=10, cameras=None):
    """Once-only count over horizontal gates at relative heights: upper first, then lower.

    `width` and `height` are the frame's, or columns of `cameras` (run_id, camera_id, frame_width, frame_height), where every camera has
    its own; rows of a camera that is not listed count nowhere.

    Every track counts at its first crossing of either gate and never again. `lived` needs
    `prev_cy`, which looks back across lives, since ids are never dropped here.
    """
    if cameras is not None:
        lived = lived.join(cameras.select(*RUN_CAMERA, width, height), list(RUN_CAMERA))
        width, height = F.col(width), F.col(height)
        levels = [F.floor(height * F.lit(float(r))).cast("int") for r in ratios]
    else:
        levels = [F.lit(int(height * r)) for r in ratios]
    at_gate = F.array(*(F.struct(F.lit(i).alias("gate_order"), F.lit(name).alias("gate"), y.alias("gate_y"))
                        for i, (name, y) in enumerate(zip(("up", "down"), levels))))
    y, cy, before = F.col("gate_y"), F.col("cy"), F.col("prev_cy")
    falls, rises = (before < y) & (cy >= y), (before > y) & (cy <= y)
    rows = lived.filter(F.col("cx").between(0, width) & before.isNotNull()).select(
        *TRACK, "frame", "cx", "cy", "prev_cy", "cls", F.inline(at_gate))
    events = rows.filter(cy.between(y - tolerance, y + tolerance) & (falls | rises)).withColumn(
        "direction", F.when(falls, "DOWN").otherwise("UP"))
    return events.groupBy(*TRACK).agg(F.min(F.struct(
        "frame", "gate_order", "gate", "direction", "cls")).alias("_first")).select(
        *TRACK, "_first.gate", "_first.direction", "_first.cls", "_first.frame")


def gate_counts(gates, by=()):
    return gates.groupBy(*by, "gate", "direction", F.coalesce("cls", F.lit("unknown")).alias("cls")).agg(
        F.count(F.lit(1)).alias("cnt"))
