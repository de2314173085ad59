import random

import pytest
from pyspark.sql import functions as F

from flowlattice.operators import crossings, headings, heat, lives, ordered, routes, shape, zones
from flowlattice.plans import summary

ZONES = {"A": [(4, 6), (131, 2), (127, 118), (9, 109)], "B": [(287, 3), (433, 8), (421, 122), (291, 117)]}
IN_A, BETWEEN, IN_B = (50, 50), (200, 50), (350, 50)


def steps(*groups):
    """(count, point) groups as consecutive frames from 1."""
    points = [p for n, p in groups for _ in range(n)]
    return [(i + 1, *p) for i, p in enumerate(points)]


def run(obs, min_origin=3, min_dest=3, **options):
    lived = lives.with_lives(zones.zone_of_point(obs, ZONES))
    return routes.zone_routes(lived, list(ZONES), min_origin, min_dest, **options)


@pytest.mark.parametrize("points, settings, state, origin, destination", [
    ([(1, 200, 200)], (3, 3), "new", None, None),
    ([(1, 50, 50)], (3, 3), "origin", "A", None),
    (steps((2, IN_A), (1, BETWEEN), (2, IN_B)), (2, 2), "done", "A", "B"),
    (steps((3, IN_A), (1, BETWEEN), (2, IN_B), (1, BETWEEN)), (2, 3), "transit", "A", None),
    ([(1, 50, 50), (2, 200, 200)], (3, 3), "new", None, None),
    (steps((2, IN_A), (1, BETWEEN), (2, IN_B), (1, IN_A)), (2, 2), "done", "A", "B"),
    (steps((3, IN_A), (2, IN_B)), (3, 1), "done", "A", "B"),
    (steps((1, IN_A), (9, IN_B)), (3, 3), "origin", "A", None),
])
def test_route_scenarios(observe, points, settings, state, origin, destination):
    row = run(observe({1: points}), *settings).first()
    assert (row.state, row.origin, row.destination) == (state, origin, destination)


def test_direct_step_counts_at_once_when_asked(observe):
    obs = observe({1: steps((3, IN_A), (1, IN_B))})
    assert run(obs, 3, 3).first().state == "transit"
    assert run(obs, 3, 3, direct="immediate").first().state == "done"


def test_class_is_the_first_one(observe):
    first, later = observe({1: [(1, 50, 50)]}, "truck"), observe({1: [(2, 50, 50), (3, 50, 50)]}, "car")
    assert run(first.union(later), 1, 1).first().cls == "truck"


def plain_route(zone_list, min_origin, min_dest):
    """The machine, one observation at a time."""
    state, origin, held, dest, stayed = "new", None, 0, None, 0
    for i, zone in enumerate(zone_list):
        if state == "new" and zone:
            state, origin, held = "origin", zone, 1
        elif state == "origin":
            if zone == origin:
                held += 1
            elif held >= min_origin:
                state, dest, stayed = "transit", zone, 1 if zone else 0
            elif not zone:
                state, origin, held = "new", None, 0
        elif state == "transit":
            if zone and zone != origin:
                stayed = stayed + 1 if zone == dest else 1
                if zone == dest and stayed >= min_dest:
                    return "done", origin, zone, i + 1
                dest = zone
            else:
                dest, stayed = None, 0
    return state, origin if state != "new" else None, None, None


def test_long_lives_in_chunks_equal_the_plain_machine(spark):
    """Random zone walks, cut so small that every level of the composition is used."""
    random.seed(11)
    names = ["A", "B", "C"]
    rows, expected = [], {}
    for track in range(60):
        walk, zone = [], None
        for _ in range(random.randrange(1, 120)):
            if random.random() < 0.35:
                zone = random.choice([None, None, *names])
            walk.append(zone)
        expected[track] = plain_route(walk, 3, 4)
        rows += [("r", 0, track, i + 1, z, names.index(z) if z else None, "car") for i, z in enumerate(walk)]
    obs = spark.createDataFrame(
        rows, "run_id string, camera_id bigint, track_id bigint, frame bigint, zone string, zone_order int, cls string")
    assert {e[0] for e in expected.values()} == {"new", "origin", "transit", "done"}
    for bits in ((2, 4), (3, 5), (12, 22)):
        for prev in ((), ("zone_order",)):
            lived = lives.with_lives(obs, prev=prev, bits=bits[1])
            got = routes.zone_routes(lived, names, 3, 4, chunk_bits=bits[0], span_bits=bits[1]).collect()
            assert {r.track_id: (r.state, r.origin, r.destination, r.frame) for r in got} == expected


def plain_lives(frames):
    out, life, last = [], 0, None
    for f in frames:
        if last is None or (f - 1) // 120 * 120 - last > 200:
            life, number = life + 1, 0
        number += 1
        out.append((life, number, last))
        last = f
    return out


def test_lives_equal_plain_purge_for_any_span(observe, spark):
    random.seed(3)
    tracks = {}
    for track in range(40):
        frame, points = random.randrange(1, 50), []
        for _ in range(random.randrange(1, 40)):
            points.append((frame, frame % 97, track))
            frame += random.choice([1, 2, 5, 60, 150, 201, 230, 260, 320, 330, 900])
        tracks[track] = points
    obs = observe(tracks)
    for options in ({"bits": 5}, {"bits": 8}, {"bits": 22}, {"total_frames": 1 << 20}):
        got = lives.with_lives(obs, first=("cx",), prev=("cx",), **options).collect()
        by_track = {}
        for r in got:
            by_track.setdefault(r.track_id, []).append(r)
        for track, points in tracks.items():
            found = sorted(by_track[track], key=lambda r: r.frame)
            plain = plain_lives([p[0] for p in points])
            assert [(r.life, r.obs_no, r.prev_frame) for r in found] == plain
            starts = {}
            for (life, number, _), (_, cx, _) in zip(plain, points):
                starts.setdefault(life, cx)
            assert [r.first_cx for r in found] == [starts[life] for life, _, _ in plain]
            assert [r.prev_cx for r in found] == [None] + [p[1] for p in points[:-1]]
            assert [r.new_life for r in found] == [n == 1 for _, n, _ in plain]


def test_purge_scenarios(observe):
    ends = observe({9: [(360, 0, 0)]})
    seen = lives.with_lives(observe({1: [(1, 0, 0)], 2: [(200, 0, 0)]}).union(ends))
    kept = {r.track_id: r.survives for r in lives.track_lives(seen).collect()}
    assert kept == {1: False, 2: True, 9: True}


def test_running_and_trailing_across_spans(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    for bits in (2, 4, 22):
        rows = ordered.numbered(df, ["k"], "o", "n", bits=bits).collect()
        assert all(r.n == r.o // 3 + 1 for r in rows) and len(rows) == 200
        looked = ordered.with_trailing(
            df, ["k"], "o", 2, lambda w: {"back": F.lag("o", 2).over(w)}, bits=bits).collect()
        assert len(looked) == 200
        assert all(r.back == (r.o - 6 if r.o >= 6 else None) for r in looked)


LINE = {"name": "L1", "pt1": (0, 100), "pt2": (200, 100), "tolerance": 25}


def cross(obs, semantics, min_crossing=1, tolerance=25, anchors="center"):
    lived = lives.with_lives(obs, prev=("cx", "cy"))
    line = {**LINE, "tolerance": tolerance}
    options = {} if semantics == "simple" else {"anchors": anchors}
    rows = crossings.line_crossings(lived, [line], min_crossing, semantics, **options).collect()
    return sorted(r.route for r in rows)


def along(*ys):
    return {1: [(i + 1, 100, y) for i, y in enumerate(ys)]}


@pytest.mark.parametrize("semantics", ["strict", "settled", "simple"])
@pytest.mark.parametrize("ys, tolerance, expected", [
    ((80, 120), 25, ["L1 ↓"]), ((120, 80), 25, ["L1 ↑"]), ((80, 85), 25, []), ((50, 150), 15, []),
    ((100,), 25, []), ((90, 110, 90, 110), 25, ["L1 ↑", "L1 ↓"]),
])
def test_crossing_scenarios(observe, semantics, ys, tolerance, expected):
    assert cross(observe(along(*ys)), semantics, 1, tolerance) == expected


def test_debounced_crossing_by_semantics(observe):
    obs = observe(along(85, 95, 105, 115))
    assert cross(obs, "strict", 2) == []
    assert cross(obs, "settled", 2) == ["L1 ↓"]


def test_straddling_box_is_not_a_crossing(observe):
    obs = observe(along(95, 105), half=10)
    assert cross(obs, "settled", 1, 25, "box") == []
    assert cross(obs, "settled", 1, 25, "center") == ["L1 ↓"]


def test_lines_table_gives_the_same_as_a_list(spark, observe):
    lived = lives.with_lives(observe(along(90, 110, 90, 110)), prev=("cx", "cy"))
    table = spark.createDataFrame(
        [("r", 0, 0, "L1", 0, 100, 200, 100, 25)],
        "run_id string, camera_id bigint, line_order int, line string, lx1 int, ly1 int, lx2 int, ly2 int, tolerance int")
    for semantics in ("strict", "settled"):
        rows = crossings.line_crossings(lived, table, 1, semantics, anchors="center").collect()
        assert sorted(r.route for r in rows) == ["L1 ↑", "L1 ↓"]


def plain_strict(points, lines, n):
    prev, history, seen, events = None, {}, set(), []
    for frame, cx, cy in points:
        before, prev = prev, (cx, cy)
        if before is None:
            continue
        for name, y, tol in lines:
            if abs(cy - y) > tol or cy == y:
                continue
            side = 1 if cy > y else -1
            sides = history.setdefault(name, [])
            sides.append(side)
            del sides[:-(n + 1)]
            if len(sides) < n or any(s != side for s in sides):
                continue
            if (1 if before[1] > y else -1) == side:
                continue
            key = f"{name} {'↓' if cy > before[1] else '↑'}"
            if key not in seen:
                seen.add(key)
                history.clear()
                events.append((key, frame))
    return events


@pytest.mark.parametrize("n", [1, 2])
def test_strict_crossings_equal_plain_loop(observe, n):
    random.seed(5)
    tracks = {}
    for track in range(25):
        y, points = 100, []
        for i in range(60):
            y += random.choice([-35, -12, -5, 4, 11, 36])
            y = max(40, min(180, y))
            points.append((i + 1, 100, y))
        tracks[track] = points
    lines = [{"name": "P", "pt1": (0, 100), "pt2": (200, 100), "tolerance": 30},
             {"name": "Q", "pt1": (0, 120), "pt2": (200, 120), "tolerance": 40}]
    lived = lives.with_lives(observe(tracks), prev=("cx", "cy"))
    got = crossings.line_crossings(lived, lines, n, "strict", anchors="center").collect()
    want = {(t, *e) for t, p in tracks.items()
            for e in plain_strict(p, [("P", 100, 30), ("Q", 120, 40)], n)}
    assert {(r.track_id, r.route, r.frame) for r in got} == want
    assert len(want) >= 5


def test_gate_counts_each_track_once(observe):
    obs = observe({1: [(1, 50, 40), (2, 50, 52), (3, 50, 68), (4, 50, 72)], 2: [(1, 50, 75), (2, 50, 68)]})
    lived = lives.with_lives(obs, prev=("cy",))
    rows = crossings.gate_crossings(lived, 100, 100, (0.5, 0.7)).collect()
    assert {(r.track_id, r.gate, r.direction, r.frame) for r in rows} == {(1, "up", "DOWN", 2), (2, "down", "UP", 2)}


DIRECTIONS = {"Norte": ((100, 200), (100, 0)), "Sur": ((100, 0), (100, 200)), "Este": ((0, 100), (200, 100))}


@pytest.mark.parametrize("points, expected", [
    ([(f, 100, 200 - 20 * f) for f in range(1, 8)], "Norte"),
    ([(f, 50 * f, 100) for f in range(1, 4)], None),
    ([(f, 100 + 2 * f, 100) for f in range(1, 5)], None),
])
def test_headings(observe, points, expected):
    lived = lives.with_lives(observe({1: points}), first=("cx", "cy"))
    row = headings.headings(lived, DIRECTIONS, 3).first()
    assert (row.direction if row else None) == expected
    states = shape.heading_states(lived, headings.headings(lived, DIRECTIONS, 3)).first()
    assert states.state == ("done" if expected else "tracking")


def test_shape_average_follows_the_recurrence(observe, spark):
    boxes = [(20, 20, 80, 60)] + [(0, 0, 100 + i, 50) for i in range(2600)]
    rows = [("r", 0, 1, i + 1, *b, 0, 0, "car") for i, b in enumerate(boxes)]
    obs = spark.createDataFrame(rows, observe({}).schema)
    row = shape.shape_ema(lives.with_lives(obs)).first()
    want = None
    for x1, y1, x2, y2 in boxes:
        value = x2 - x1
        want = float(value) if want is None else want * 0.7 + value * 0.3
    assert row.samples == len(boxes)
    assert row.avg_width == pytest.approx(want)
    one = shape.shape_ema(lives.with_lives(spark.createDataFrame(rows[:1], obs.schema))).first()
    assert (one.avg_width, one.avg_height, one.avg_area) == (60, 40, 2400)


def test_trail_keeps_the_last_points(observe):
    lived = lives.with_lives(observe({1: [(i, i, 0) for i in range(1, 20)]}))
    trail = shape.trails(lived, 5).first().trail
    assert [p.cx for p in trail] == [15, 16, 17, 18, 19]


def test_report_of_two_modes(observe):
    lived = lives.with_lives(observe({1: steps((2, IN_A), (1, BETWEEN), (2, IN_B))}, half=5))
    done = run(observe({1: steps((2, IN_A), (1, BETWEEN), (2, IN_B))}), 2, 2)
    row = shape.track_report(lived, lives.track_lives(lived), shape.zone_states(done)).first()
    assert (row.state, row.origin, row.first_x, row.last_x, row.trail_length) == ("done", "A", 50, 350, 5)
    assert (row.avg_width, row.avg_aspect) == (10.0, 1.0)
    crossed = crossings.line_crossings(lived, [LINE], 1)
    states = shape.crossing_states(lived, crossed).first()
    assert states.state == "new"


def test_heat(observe):
    two = heat.heat_grid(observe({1: [(1, 5, 5)], 2: [(1, 5, 5)], 3: [(1, 500, 5)]}), 100, 100, decay=1.0)
    assert [(r.x, r.y, r.weight) for r in two.collect()] == [(5, 5, 2.0)]
    ends = observe({9: [(2, 0, 0)]}).select("run_id", "camera_id", F.lit(2).cast("bigint").alias("last_frame_of_run"))
    faded = heat.heat_grid(observe({1: [(1, 5, 5)]}), 100, 100, decay=0.5, ends=ends)
    assert faded.first().weight == 0.5


def test_smoothing_with_mirrored_edges_equals_dense(observe):
    import numpy as np

    width, height, size = 40, 36, 31
    cells = {(0, 0): 900.0, (1, 35): 500.0, (20, 18): 2500.0, (39, 3): 700.0}
    obs = observe({i: [(1, x, y)] for i, (x, y) in enumerate(cells)})
    grid = obs.join(obs.sparkSession.createDataFrame(
        [(x, y, w) for (x, y), w in cells.items()], "cx int, cy int, weight double"), ["cx", "cy"]).select(
        "run_id", "camera_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "weight")
    assert heat.default_sigma(size) == pytest.approx(5.0)
    dense = np.zeros((height, width))
    for (x, y), w in cells.items():
        dense[y, x] = w
    kernel = np.array(heat.gaussian_kernel(size, 5.0))
    padded = np.pad(dense, size // 2, mode="reflect")
    rows = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 1, padded)
    want = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 0, rows)
    want = want / max(want.max(), 1.0)
    got = {(r.x, r.y): r.level for r in heat.heat_smooth(grid, width, height, size).collect()}
    assert set(got) == {(x, y) for y in range(height) for x in range(width) if want[y, x] > 0.05}
    assert all(v == pytest.approx(want[y, x]) for (x, y), v in got.items())


def test_two_vehicles_and_matrix(observe):
    there = steps((2, IN_A), (1, BETWEEN), (2, IN_B))
    back = [(f + 5, *p) for f, *p in steps((2, IN_B), (1, BETWEEN), (2, IN_A))]
    obs = observe({1: there, 2: back}, {1: "car", 2: "truck"})
    done = routes.completed(run(obs, 2, 2))
    assert {(r.route, r.cnt) for r in summary.route_counts(done).collect()} == {("A → B", 1), ("B → A", 1)}
    lived = lives.with_lives(obs)
    assert summary.vehicles_total(lived).first().vehicles == 2
    assert summary.vehicles_total(lived, approximate=True).first().vehicles == 2
    matrix = {r.origin: (r.A, r.B) for r in summary.od_matrix(done).collect()}
    assert matrix == {"A": (0, 1), "B": (1, 0)}
    wider = {r.origin: (r.A, r.B, r.C) for r in summary.od_matrix(done, ["C"]).collect()}
    assert wider == {"A": (0, 1, 0), "B": (1, 0, 0), "C": (0, 0, 0)}
    by_class = {(r.origin, r.cls): r.cnt for r in summary.od_by_class(done).collect()}
    assert by_class == {("A", None): 1, ("A", "car"): 1, ("B", None): 1, ("B", "truck"): 1}
    both = obs.sparkSession.createDataFrame([("r", 0, 900), ("r", 7, 30)], "run_id string, camera_id bigint, total_frames bigint")
    row, idle = summary.run_summary(lived, done, both).orderBy("camera_id").collect()
    assert (row.frames_processed, idle.frames_processed, idle.total_vehicles_tracked, idle.routes) == (900, 30, 0, {})
    assert (row.total_vehicles_tracked, row.total_routes_completed) == (2, 2)
    assert row.routes == {"A → B": 1, "B → A": 1}


def test_sites_with_their_own_zones_and_thresholds(spark, observe):
    """Two cameras in one job give what each gives alone with its own settings; a camera without a site has no zones."""
    walk = {1: [(f, 50 if f < 4 else 350, 50) for f in range(1, 9)], 2: [(f, 350 if f < 6 else 50, 50) for f in range(1, 9)]}
    obs = observe(walk, camera=0).union(observe(walk, camera=1)).union(observe(walk, camera=2))
    place = F.when(F.col("camera_id") < 2, F.when(F.col("cx") < 100, 0).otherwise(F.when(F.col("camera_id") == 0, 1)))
    lived = lives.with_lives(obs.withColumn("zone_order", place))
    sites = spark.createDataFrame([("r", 0, ["A", "B"], 2, 2), ("r", 1, ["C"], 4, 3)],
                                  "run_id string, camera_id bigint, zone_names array<string>, min_origin int, min_dest int")
    for bits in ({}, {"chunk_bits": 1, "span_bits": 2}):
        got = {(r.camera_id, r.track_id): (r.state, r.origin, r.destination) for r in routes.zone_routes(lived, sites, **bits).collect()}
        for camera, names, low, high in ((0, ["A", "B"], 2, 2), (1, ["C"], 4, 3), (2, [], 3, 3)):
            alone = routes.zone_routes(lived.filter(F.col("camera_id") == camera), names, low, high).collect()
            assert {(camera, r.track_id): (r.state, r.origin, r.destination) for r in alone} == {k: v for k, v in got.items() if k[0] == camera}
        assert got[0, 1] == ("done", "A", "B") and got[1, 1][0] == "new" and got[2, 1][0] == "new"


def test_one_aggregate_per_life(spark, observe, monkeypatch):
    """Reports do not depend on how a life is cut into blocks, agree with the operators for each part, and move rows once."""
    from flowlattice.operators import report

    rng = random.Random(5)
    tracks = {t: [(f, rng.randrange(0, 420), rng.randrange(0, 120)) for f in sorted(rng.sample(range(1, 900), 90))] for t in range(12)}
    obs = zones.zone_of_point(observe(tracks, half=9), ZONES)
    lived = lives.with_lives(obs, first=("cx", "cy"), prev=("zone_order",), total_frames=1000)
    whole = report.life_reports(lived, list(ZONES), min_origin=2, min_dest=2)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {(r.track_id, r.life): r for r in whole.collect()}
    monkeypatch.setattr(report, "_BLOCK_BITS", 3)
    got = {(r.track_id, r.life): r for r in report.life_reports(lived, list(ZONES), min_origin=2, min_dest=2).collect()}
    assert got.keys() == want.keys() and sum(r.state == "done" for r in got.values()) > 3
    states = {(r.track_id, r.life): (r.state, r.origin, r.destination, r.frame) for r in routes.zone_routes(lived, list(ZONES), 2, 2).collect()}
    averages = {(r.track_id, r.life): r for r in shape.shape_ema(lived).collect()}
    trails = {(r.track_id, r.life): r.trail for r in shape.trails(lived).collect()}
    for key, row in got.items():
        a, b = row.asDict(), want[key].asDict()
        assert all(a[c] == pytest.approx(b[c]) if c in shape.AVERAGES else a[c] == b[c] for c in a)
        assert (row.state, row.origin, row.destination, row.done_at) == states[key]
        assert all(row[c] == pytest.approx(averages[key][c]) for c in shape.AVERAGES)
        assert (row.first_x, row.last_y, row.trail_length) == (trails[key][0].cx, trails[key][-1].cy, len(trails[key]))
    found = {(r.track_id, r.life): r.direction for r in headings.headings(lived, {"E": ((0, 0), (9, 0)), "N": ((0, 9), (0, 0))}).collect()}
    ways = report.life_reports(lived, directions={"E": ((0, 0), (9, 0)), "N": ((0, 9), (0, 0))}).collect()
    assert {(r.track_id, r.life): r.direction for r in ways if r.state == "done"} == found


def test_strict_crossings_equal_a_plain_walk(spark, observe):
    """Random walks over three lines against the rule told step by step, with boxes and with centres."""
    from collections import deque

    rng = random.Random(11)
    lines = [{"name": n, "pt1": a, "pt2": b, "tolerance": t} for n, a, b, t in (
        ("V", (100, 0), (100, 200), 25), ("H", (0, 100), (200, 100), 30), ("D", (0, 0), (200, 200), 20))]
    tracks = {t: [(f, rng.randrange(70, 131), rng.randrange(70, 131)) for f in range(1, 80)] for t in range(12)}

    def side(line, x, y):
        (x1, y1), (x2, y2) = line["pt1"], line["pt2"]
        return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)

    def walked(points, n, half):
        histories, seen, found, before = {}, set(), [], None
        for frame, x, y in points:
            for line in lines if before else ():
                (x1, y1), (x2, y2) = line["pt1"], line["pt2"]
                if abs(side(line, x, y)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5 > line["tolerance"]:
                    continue
                anchors = [(x, y)] + [(x + i * half, y + j * half) for i in (-1, 1) for j in (-1, 1)] * (half is not None and half > 0)
                values = [side(line, *a) for a in anchors]
                now = (max(values) > 0) - (min(values) < 0)
                if now == 0:
                    continue
                history = histories.setdefault(line["name"], deque(maxlen=n + 1))
                history.append(now)
                flips = (1 if side(line, *before) > 0 else -1) * now < 0
                key = line["name"], "↓" if y > before[1] else "↑"
                if len(history) >= n and set(history) == {now} and flips and key not in seen:
                    seen.add(key)
                    found.append((*key, frame))
                    histories.clear()
            before = (x, y)
        return found

    for half, anchors in ((0, "center"), (4, "box")):
        obs = observe(tracks, half=half)
        for total in (1000, None):
            lived = lives.with_lives(obs, prev=("cx", "cy"), total_frames=total)
            for n in (1, 2):
                got = crossings.line_crossings(lived, lines, n, "strict", anchors=anchors, total_frames=total).collect()
                assert {(r.track_id, r.line, r.direction, r.frame) for r in got} == {
                    (t, *e) for t, points in tracks.items() for e in walked(points, n, half)} and got
