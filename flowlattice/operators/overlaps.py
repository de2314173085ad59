"""Boxes against boxes of the same frame.

Pairs are found through a grid: a box is listed in every cell it touches, and only boxes of one
cell meet, so far-apart boxes of a crowded frame are never compared.
"""

from pyspark.sql import Window, functions as F

from flowlattice.functions import geometry as g
from flowlattice.operators.filters import passes_sample_constraints
from flowlattice.schemas import FRAME

CELL = 128
PASSES = 4


def _cells(low, high, cell):
    return F.sequence(F.floor(low / F.lit(float(cell))), F.floor(high / F.lit(float(cell))))


def in_cells(boxes, cell=CELL):
    b = g.box()
    across = boxes.select("*", F.explode(_cells(b.x1, b.x2, cell)).alias("_gx"))
    return across.select("*", F.explode(_cells(b.y1, b.y2, cell)).alias("_gy"))


def _meets_here(a, b, cell):
    """A pair shares several cells; it is taken in the one with the overlap's first corner."""
    return (
        (F.col("_gx") == F.floor(F.greatest(a.x1, b.x1) / F.lit(float(cell))))
        & (F.col("_gy") == F.floor(F.greatest(a.y1, b.y1) / F.lit(float(cell))))
    )


def _renamed(boxes, columns, prefix):
    return boxes.select(*FRAME, "_gx", "_gy", *(F.col(c).alias(prefix + c) for c in columns))


def overlap_pairs(dets, threshold=0.3, metric="iou", cell=CELL):
    """Pairs (det_a < det_b) of a frame whose overlap exceeds the threshold (at least 0)."""
    columns = ["det_idx", "x1", "y1", "x2", "y2"]
    listed = in_cells(dets.select(*FRAME, *columns), cell)
    a, b = _renamed(listed, columns, "a_"), _renamed(listed, columns, "b_")
    score = g.OVERLAP_METRICS[metric](g.box("a_"), g.box("b_"))
    pairs = a.join(b, [*FRAME, "_gx", "_gy"]).filter(
        (F.col("a_det_idx") < F.col("b_det_idx")) & _meets_here(g.box("a_"), g.box("b_"), cell))
    return pairs.select(*FRAME, F.col("a_det_idx").alias("det_a"), F.col("b_det_idx").alias("det_b"),
                        score.alias(metric)).filter(F.col(metric) > threshold)


def attach_class(tracks, dets, rule="best", cell=CELL):
    """Gives each tracked box the class of a detection of its frame.

    `best`: largest overlap above 0, else "car". `first`: first detection with overlap above 0.5,
    else "unknown". Earlier detections win ties.
    """
    keep = [c for c in tracks.columns if c != "cls"]
    listed = in_cells(tracks.select(*keep), cell)
    found = _renamed(in_cells(dets.select(*FRAME, "det_idx", "x1", "y1", "x2", "y2", "cls"), cell),
                     ["det_idx", "x1", "y1", "x2", "y2", "cls"], "d_")
    overlap = g.iou(g.box(), g.box("d_"))
    met = listed.join(found, [*FRAME, "_gx", "_gy"], "left").withColumn("_iou", overlap)
    if rule == "best":
        pick = F.max(F.when(F.col("_iou") > 0, F.struct(
            "_iou", (-F.col("d_det_idx")).alias("_tie"), F.col("d_cls").alias("cls"))))
        default = "car"
    else:
        pick = F.min(F.when(F.col("_iou") > 0.5, F.struct(
            F.col("d_det_idx").alias("_tie"), F.col("d_cls").alias("cls"))))
        default = "unknown"
    return met.groupBy(*keep).agg(pick.alias("_pick")).select(
        *keep, F.coalesce(F.col("_pick.cls"), F.lit(default)).alias("cls"))


def match_samples(candidates, samples, constraints=None):
    """Best candidate for every sample box: (iou, conf) decides, touching centres count too.

    Both sides share `sample_id`; samples hold sx1..sy2. `constraints` is an optional struct column
    of shape limits on the candidates' side.
    """
    b, s = g.box(), g.box("s")
    cand_x, cand_y = g.center(b)
    sel_x, sel_y = g.center(s)
    overlap = g.iou(b, s)
    rows = candidates.join(samples, "sample_id").withColumn("iou", overlap).filter(
        (F.col("iou") >= 0.10) | g.point_in_box(cand_x, cand_y, s) | g.point_in_box(sel_x, sel_y, b))
    if constraints is not None:
        rows = rows.filter(passes_sample_constraints(b, constraints))
    return rows.groupBy("sample_id").agg(F.max(F.struct(
        "iou", "conf", (-F.col("det_idx")).alias("_tie"), "cls", "x1", "y1", "x2", "y2")
    ).alias("_best")).select(
        "sample_id", (-F.col("_best._tie")).alias("det_idx"),
        *(F.col(f"_best.{c}").alias(c) for c in ("iou", "conf", "cls", "x1", "y1", "x2", "y2")))


def _apart(dets, keys, passes):
    """Adds group numbers so that boxes of different groups of a frame cannot overlap.

    Boxes are read from left to right; where one starts beyond the end of all before it, a new group starts. Every group is read again
    from top to bottom, and so on in turns, so that what lies apart is cut off. All passes keep the frames' partitioning.
    """
    groups = []
    for k in range(passes):
        low, high = (("x1", "x2"), ("y1", "y2"))[k % 2]
        along = Window.partitionBy(*keys, *groups).orderBy(low, high)
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        opens = F.coalesce(F.col(low) >= F.max(high).over(before), F.lit(True)).cast("int")
        dets = dets.withColumn("_opens", opens).withColumn(f"_group{k}", F.sum("_opens").over(upto)).drop("_opens")
        groups.append(f"_group{k}")
    return dets, groups


def nms(dets, threshold=0.3, metric="iou", class_aware=False, passes=PASSES):
    """Greedy non-maximum suppression per frame: confidence, then input order; 0 disables.

    A box only ever meets boxes that it overlaps, so frames are cut into groups of boxes that lie apart (`_apart`) and every
    group is one JVM fold. The plan is the same for frames of any size: one exchange by frame, no round trips. How far groups
    are cut changes the work, never the result.
    """
    if threshold <= 0:
        return dets
    keys = [*FRAME, "cls"] if class_aware else list(FRAME)
    score = g.OVERLAP_METRICS[metric]
    cut, groups = _apart(dets, keys, passes)
    payload = [c for c in dets.columns if c not in keys]
    ranked = F.struct((-F.col("conf")).alias("_rank"), F.col("det_idx").alias("_idx"), *payload)
    boxes = cut.groupBy(*keys, *groups).agg(F.array_sort(F.collect_list(ranked)).alias("_boxes"))
    none = F.slice("_boxes", 1, 0)
    kept = F.aggregate("_boxes", none, lambda kept, d: F.when(
        F.exists(kept, lambda k: score(g.box_of(k), g.box_of(d)) > threshold), kept
    ).otherwise(F.array_append(kept, d)))
    return boxes.select(*keys, F.inline(kept)).select(*dets.columns)


def synthetic_ids(dets):
    """Track ids without a tracker: the position of a box in its frame, from 1."""
    from flowlattice.operators.ordered import numbered

    return numbered(dets, FRAME, "det_idx", "track_id")
