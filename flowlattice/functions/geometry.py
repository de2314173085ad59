"""Column builders for boxes, lines and polygons. Everything stays a JVM expression.

Coordinates are integers. Products are taken in BIGINT so that ANSI mode never overflows on them.
"""

from typing import NamedTuple

from pyspark.sql import Column, functions as F

MAX_INLINE_EDGES = 160


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def corners(self):
        return [(self.x1, self.y1), (self.x2, self.y1), (self.x2, self.y2), (self.x1, self.y2)]


def _col(c):
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def _long(c):
    return _col(c).cast("bigint")


def box(prefix=""):
    """The four coordinates `<prefix>x1 .. <prefix>y2`."""
    return Box(*(F.col(prefix + name) for name in ("x1", "y1", "x2", "y2")))


def box_of(struct):
    return Box(struct["x1"], struct["y1"], struct["x2"], struct["y2"])


def centroid(b):
    """Pixel centre, floored also for negative sums."""
    return (
        F.floor((_long(b.x1) + _long(b.x2)) / F.lit(2.0)).cast("int"),
        F.floor((_long(b.y1) + _long(b.y2)) / F.lit(2.0)).cast("int"),
    )


def center(b):
    """Exact centre as doubles."""
    return (_long(b.x1) + _long(b.x2)) / F.lit(2.0), (_long(b.y1) + _long(b.y2)) / F.lit(2.0)


def box_features(b):
    """width, height (at least 1 px), area, aspect, elongation."""
    w = F.greatest(F.lit(1).cast("bigint"), _long(b.x2) - _long(b.x1))
    h = F.greatest(F.lit(1).cast("bigint"), _long(b.y2) - _long(b.y1))
    return {
        "w": w,
        "h": h,
        "area": w * h,
        "aspect": w / h.cast("double"),
        "elongation": F.greatest(w, h) / F.least(w, h).cast("double"),
    }


def _overlap_parts(a, b):
    zero = F.lit(0).cast("bigint")
    iw = F.greatest(zero, F.least(_long(a.x2), _long(b.x2)) - F.greatest(_long(a.x1), _long(b.x1)))
    ih = F.greatest(zero, F.least(_long(a.y2), _long(b.y2)) - F.greatest(_long(a.y1), _long(b.y1)))

    def area(k):
        return (F.greatest(zero, _long(k.x2) - _long(k.x1))
                * F.greatest(zero, _long(k.y2) - _long(k.y1)))

    return iw * ih, area(a), area(b)


def _ratio(part, whole):
    return F.when((part > 0) & (whole > 0), part / whole.cast("double")).otherwise(F.lit(0.0))


def iou(a, b):
    """Intersection over union, 0 without overlap."""
    inter, area_a, area_b = _overlap_parts(a, b)
    return _ratio(inter, area_a + area_b - inter)


def ios(a, b):
    """Intersection over the smaller box, 0 without overlap."""
    inter, area_a, area_b = _overlap_parts(a, b)
    return _ratio(inter, F.least(area_a, area_b))


OVERLAP_METRICS = {"iou": iou, "ios": ios}


def point_in_box(px, py, b):
    return _col(px).between(b.x1, b.x2) & _col(py).between(b.y1, b.y2)


def line_side(px, py, x1, y1, x2, y2):
    """Cross product of the line direction with the point: sign tells the side."""
    x1, y1, x2, y2, px, py = map(_long, (x1, y1, x2, y2, px, py))
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def line_distance(px, py, x1, y1, x2, y2):
    """Distance to the infinite line; to the point when both ends coincide."""
    x1, y1, x2, y2, px, py = map(_long, (x1, y1, x2, y2, px, py))
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    length = F.hypot(dx, dy)
    to_point = F.hypot((px - x1).cast("double"), (py - y1).cast("double"))
    cross = F.abs(dx * (y1 - py) - (x1 - px) * dy)
    return F.when(length > 0, F.try_divide(cross, length)).otherwise(to_point)


def cosine2d(ax, ay, bx, by):
    ax, ay, bx, by = (_col(c).cast("double") for c in (ax, ay, bx, by))
    norms = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(norms > 0, F.try_divide(ax * bx + ay * by, norms)).otherwise(F.lit(0.0))


def _edge_tests(px, py, ax, ay, bx, by):
    """(ray to +x crosses the edge, point lies on the edge) without any division."""
    turn = (px - ax) * (by - ay) - (bx - ax) * (py - ay)
    spans = (ay > py) != (by > py)
    crosses = spans & F.when(by > ay, turn < 0).otherwise(turn > 0)
    on_edge = (
        (turn == 0)
        & px.between(F.least(ax, bx), F.greatest(ax, bx))
        & py.between(F.least(ay, by), F.greatest(ay, by))
    )
    return crosses, on_edge


def point_in_ring(px, py, ring):
    """Even-odd polygon test with the boundary inside, for a ring column ARRAY<STRUCT<x,y>>."""
    px, py = _col(px), _col(py)
    n = F.size(ring)
    edges = F.zip_with(
        ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)),
        lambda a, b: F.struct(a["x"].cast("bigint").alias("ax"), a["y"].cast("bigint").alias("ay"),
                              b["x"].cast("bigint").alias("bx"), b["y"].cast("bigint").alias("by")),
    )

    def test(k):
        return lambda e: _edge_tests(px, py, e["ax"], e["ay"], e["bx"], e["by"])[k]

    odd = F.size(F.filter(edges, test(0))) % 2 == 1
    return (n > 0) & (odd | F.exists(edges, test(1)))


def _is_axis_box(points):
    xs, ys = {p[0] for p in points}, {p[1] for p in points}
    ring = list(points)
    return (
        len(ring) == 4 and len(xs) == 2 and len(ys) == 2 and len(set(map(tuple, ring))) == 4
        and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:] + ring[:1]))
    )


def point_in_polygon(px, py, points):
    """The same test against one polygon known when the plan is built.

    The edges are unrolled, so the test is generated code; a rectangle needs its bounds only.
    """
    px, py = _col(px), _col(py)
    points = [(int(x), int(y)) for x, y in points]
    if not points:
        return F.lit(False)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    inside_bounds = px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))
    if _is_axis_box(points):
        return inside_bounds
    if len(points) > MAX_INLINE_EDGES:
        ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points))
        return inside_bounds & point_in_ring(px, py, ring)
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        # The line through the edge: which side of it the point lies on.
        across, down = by - ay, ax - bx
        turn = px * F.lit(across).cast("bigint") + py * F.lit(down).cast("bigint") - F.lit(
            ax * across + ay * down).cast("bigint")
        low, high = min(ay, by), max(ay, by)
        on_edge = on_edge | ((turn == 0) & px.between(min(ax, bx), max(ax, bx)) & py.between(low, high))
        if low < high:
            beyond = turn < 0 if by > ay else turn > 0
            crossings = crossings + ((py >= low) & (py < high) & beyond).cast("int")
    return inside_bounds & (on_edge | (crossings % 2 == 1))


def ring_area(ring):
    """Shoelace area of a ring column."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, following, lambda a, b: (
        a["x"].cast("bigint") * b["y"] - b["x"].cast("bigint") * a["y"]))
    twice = F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, t: s + t)
    return F.abs(twice) / F.lit(2.0)


def ring_centroid(ring):
    """Vertex mean, truncated to whole pixels."""
    def mean(axis):
        total = F.aggregate(ring, F.lit(0).cast("bigint"), lambda s, p: s + p[axis])
        return F.try_divide(total.cast("double"), F.size(ring)).cast("int")

    return mean("x"), mean("y")


def crop_to_frame(b, scale, origin_x, origin_y):
    """Boxes found on a rescaled crop, back in frame pixels (truncated like an int cast)."""
    def back(v, origin):
        return (_col(v) / _col(scale)).cast("int") + _col(origin)

    return Box(back(b.x1, origin_x), back(b.y1, origin_y),
               back(b.x2, origin_x), back(b.y2, origin_y))


def crop_window(b, width, height):
    """Padded window around a box, clipped to the frame."""
    f = box_features(b)

    def pad(side):
        return F.greatest(F.lit(24), F.floor(side * F.lit(0.75)).cast("int"))

    px, py = pad(f["w"]), pad(f["h"])
    return Box(F.greatest(F.lit(0), b.x1 - px), F.greatest(F.lit(0), b.y1 - py),
               F.least(_col(width), b.x2 + px), F.least(_col(height), b.y2 + py))


def upscale_factor(b):
    """How much to enlarge a crop so the smaller side reaches 160 px, between 1 and 4."""
    f = box_features(b)
    return F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.lit(160.0) / F.least(f["w"], f["h"])))
