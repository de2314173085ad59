import math

import pytest
from pyspark.sql import functions as F

from flowlattice.functions import geometry as g, labels
from flowlattice.operators import filters, overlaps, zones

SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]
DIAMOND = [(50, 0), (100, 50), (50, 100), (0, 50)]
CONCAVE = [(0, 0), (100, 0), (100, 100), (50, 40), (0, 100)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit_box(*v):
    return g.Box(*(F.lit(k) for k in v))


@pytest.mark.parametrize("a, b, expected", [
    ((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175),
    ((0, 0, 10, 10), (0, 0, 10, 10), 1.0),
    ((0, 0, 10, 10), (10, 0, 20, 10), 0.0),
    ((5, 5, 5, 5), (0, 0, 10, 10), 0.0),
    ((0, 0, 10, 10), (0, 0, 5, 5), 0.25),
])
def test_iou(spark, a, b, expected):
    assert one(spark, g.iou(lit_box(*a), lit_box(*b)))[0] == pytest.approx(expected)


def test_floor_centroid(spark):
    x, y = g.centroid(lit_box(-3, 1, 0, 4))
    assert tuple(one(spark, x, y)) == (-2, 2)


@pytest.mark.parametrize("points", [SQUARE, DIAMOND, CONCAVE])
def test_inline_and_column_polygon_agree_with_plain_rule(spark, points):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points))
    grid = spark.range(23 * 23).select(
        (F.col("id") % 23 * 5 - 5).cast("int").alias("x"), (F.floor(F.col("id") / 23) * 5 - 5).cast("int").alias("y"))
    rows = grid.select("x", "y", g.point_in_polygon("x", "y", points).alias("inline"),
                       g.point_in_ring("x", "y", ring).alias("column")).collect()

    def plain(px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            cross = (px - ax) * (by - ay) - (bx - ax) * (py - ay)
            if cross == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                return True
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    for r in rows:
        assert r.inline == r.column == plain(r.x, r.y), (r.x, r.y)


def test_many_cornered_polygon_falls_back_to_array(spark):
    ring = [(int(500 + 400 * math.cos(a)), int(500 + 400 * math.sin(a)))
            for a in (2 * math.pi * k / 200 for k in range(200))]
    row = one(spark, g.point_in_polygon(F.lit(500), F.lit(500), ring), g.point_in_polygon(F.lit(5), F.lit(5), ring))
    assert tuple(row) == (True, False)


def test_line_side_and_distance(spark):
    row = one(
        spark, g.line_side(F.lit(50), F.lit(60), 0, 50, 100, 50), g.line_side(F.lit(50), F.lit(40), 0, 50, 100, 50),
        g.line_distance(F.lit(50), F.lit(55), 0, 50, 100, 50), g.line_distance(F.lit(13), F.lit(14), 10, 10, 10, 10),
        g.line_distance(F.lit(10), F.lit(0), 0, 0, 10, 10))
    assert row[0] > 0 > row[1]
    assert row[2:] == pytest.approx((5.0, 5.0, 10 / math.sqrt(2)))


def test_cosine_of_zero_vector_is_zero(spark):
    assert tuple(one(spark, g.cosine2d(0, 0, 1, 0), g.cosine2d(2, 0, 5, 0), g.cosine2d(0, 3, 1, 0))) == (0.0, 1.0, 0.0)


@pytest.mark.parametrize("box, limits, passes", [
    ((0, 0, 10, 10), {"min_area": 1000}, False),
    ((0, 0, 100, 10), {"max_aspect": 2}, False),
    ((5, 5, 5, 5), {"min_area": 1}, True),
    ((0, 0, 10, 10), {"min_area": 100, "max_area": 100, "min_width": 10, "max_height": 10}, True),
    ((0, 0, 10, 10), {}, True),
])
def test_shape_limits(spark, box, limits, passes):
    assert one(spark, filters.passes_shape(lit_box(*box), limits))[0] is passes


def test_exclusion_by_inline_and_by_column(spark):
    parks = {"park1": [(0, 0), (50, 0), (50, 50), (0, 50)], "park2": [(200, 200), (300, 200), (300, 300), (200, 300)]}
    column = F.array(*(F.struct(F.array(*(F.struct(
        F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring)).alias("ring")) for ring in parks.values()))
    for point, inside in (((25, 25), True), ((250, 250), True), ((100, 100), False), ((50, 50), True)):
        px, py = map(F.lit, point)
        row = one(spark, filters.in_any_polygon(px, py, parks), filters.in_any_polygon(px, py, column))
        assert tuple(row) == (inside, inside)


def test_box_touches_zone_by_a_corner(spark):
    boxes = spark.createDataFrame([(90, 10, 150, 90), (110, 10, 150, 90)], "x1 int, y1 int, x2 int, y2 int")
    assert [r.x1 for r in filters.boxes_touching(boxes, SQUARE).collect()] == [90]


def _points(spark, *points):
    return spark.createDataFrame([("r", 0, x, y) for x, y in points], "run_id string, camera_id bigint, cx int, cy int")


def test_first_zone_wins(spark):
    found = zones.zone_of_point(_points(spark, (50, 50), (90, 90), (500, 500)), {"A": DIAMOND, "B": SQUARE})
    assert [(r.zone, r.zone_order) for r in found.orderBy("cx").collect()] == [("A", 0), ("B", 1), (None, None)]


def test_raster_zones_end_with_the_frame(spark):
    rows = spark.createDataFrame(
        [("r", 0, 0, "Z", [(10, 10), (90, 10), (90, 90), (10, 90)])],
        "run_id string, camera_id bigint, zone_order int, zone string, ring array<struct<x:int,y:int>>")
    points = _points(spark, (50, 50), (10, 90), (5, 5), (200, 200), (-5, -5))
    found = zones.zone_of_point_raster(points, rows, 100, 100)
    assert {(r.cx, r.zone) for r in found.collect()} == {(50, "Z"), (10, "Z"), (5, None), (200, None), (-5, None)}


def test_raster_and_polygon_agree_inside_a_triangle(spark):
    ring = [(10, 10), (90, 10), (50, 80)]
    rows = spark.createDataFrame(
        [("r", 0, 0, "T", ring)],
        "run_id string, camera_id bigint, zone_order int, zone string, ring array<struct<x:int,y:int>>")
    points = _points(spark, *((x, y) for x in range(0, 100, 7) for y in range(0, 100, 7)))
    raster = zones.zone_of_point_raster(points, rows, 100, 100).select("cx", "cy", F.col("zone").alias("a"))
    exact = zones.zone_of_point(points, {"T": ring}).select("cx", "cy", F.col("zone").alias("b"))
    both = raster.join(exact, ["cx", "cy"]).collect()
    assert sum(r.b is not None for r in both) > 20
    # A mask may add pixels its outline touches, and never loses an inner one.
    assert all(r.a is not None for r in both if r.b is not None)


def _boxes(spark, rows):
    return spark.createDataFrame(
        [("r", 0, 1, i, *row) for i, row in enumerate(rows)],
        "run_id string, camera_id bigint, frame bigint, det_idx int, x1 int, y1 int, x2 int, y2 int, conf double, cls string")


@pytest.mark.parametrize("passes", [0, 1, 4])
def test_nms(spark, passes):
    boxes = _boxes(spark, [(0, 0, 10, 10, .9, "car"), (1, 1, 11, 11, .5, "truck"), (50, 50, 60, 60, .7, "bus")])
    assert {r.cls for r in overlaps.nms(boxes, 0.3, passes=passes).collect()} == {"car", "bus"}
    low = _boxes(spark, [(0, 0, 10, 10, .9, "car"), (8, 8, 18, 18, .8, "car")])
    assert overlaps.nms(low, 0.5, passes=passes).count() == 2
    assert overlaps.nms(boxes, 0.0, passes=passes).count() == 3


def test_nms_equals_plain_greedy_on_random_boxes(spark):
    import random

    random.seed(7)
    rows = []
    for _ in range(150):
        x, y = random.randrange(400), random.randrange(300)
        rows.append((x, y, x + random.randrange(20, 160), y + random.randrange(20, 160),
                     random.randrange(20) / 20, "car"))
    boxes = _boxes(spark, rows)

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    kept = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][4], i)):
        if all(iou(rows[i], rows[k]) <= 0.3 for k in kept):
            kept.append(i)
    for passes in (0, 1, 4):
        assert sorted(r.det_idx for r in overlaps.nms(boxes, 0.3, passes=passes).collect()) == sorted(kept)
    # Suppressing twice changes nothing.
    assert overlaps.nms(overlaps.nms(boxes, 0.3), 0.3).count() == len(kept)


def test_nms_of_many_boxes_that_lie_apart(spark):
    """5,000 boxes of one frame, one of them covered: one exchange, and no pass over all pairs."""
    boxes = _boxes(spark, [(x, y, x + 9, y + 9, .5, "car") for x in range(0, 1000, 10) for y in range(0, 500, 10)] + [(1, 1, 10, 10, .4, "car")])
    kept = overlaps.nms(boxes, 0.3)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert kept.count() == 5000 and kept.filter("conf < 0.5").count() == 0


def test_class_from_best_overlap(spark):
    tracks = spark.createDataFrame([("r", 0, 1, 1, 10, 10, 50, 50), ("r", 0, 2, 1, 10, 10, 50, 50)],
                                   "run_id string, camera_id bigint, frame bigint, track_id bigint, x1 int, y1 int, x2 int, y2 int")
    dets = _boxes(spark, [(0, 0, 20, 20, .9, "truck"), (10, 10, 50, 50, .8, "bus")])
    best = {r.frame: r.cls for r in overlaps.attach_class(tracks, dets).collect()}
    assert best == {1: "bus", 2: "car"}
    first = {r.frame: r.cls for r in overlaps.attach_class(tracks, dets, "first").collect()}
    assert first == {1: "bus", 2: "unknown"}


def test_text_helpers(spark):
    row = one(spark, labels.duration_text(F.lit(3723)), labels.duration_text(F.lit(63)), labels.duration_text(F.lit(3)),
              labels.route_key(F.lit("A"), F.lit("B")), labels.route_origin(F.lit("A → B")),
              labels.crossing_key(F.lit("L"), F.lit(labels.DOWN)))
    assert tuple(row) == ("1h 2m 3s", "1m 3s", "3s", "A → B", "A", "L ↓")


def test_confidence_fallback_and_aliases(spark):
    row = one(spark, labels.confidence_floor(F.lit("bus"), 0.1, {"bus": 0.4}),
              labels.confidence_floor(F.lit("car"), 0.1, {"bus": 0.4}), labels.confidence_floor(F.lit("car"), 0.2),
              labels.aliased_class(F.lit("motorcycle"), {"motorcycle": "motorbike"}), labels.class_name(F.lit(7)),
              labels.class_name(F.lit(99), "calibration"))
    assert tuple(row) == (0.4, 0.1, 0.2, "motorbike", "truck", "?")
