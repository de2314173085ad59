import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlattice.operators import headings, lives, tracker
from flowlattice.plans import replay, views
from flowlattice.sources.detections import stream_detections
from flowlattice.streaming import flows, totals, tracks

FOLDER = "/root/testdata/sf0.001"


def test_live_tracks_equal_batch(spark):
    dets = views.detections(spark, FOLDER)
    live = replay.replay(dets, lambda s: tracks.stream_tracks(s, max_age=3), 25.0, slices=2)
    batch = tracker.track_detections(dets, max_age=3)
    columns = ["camera_id", "frame", "track_id", "x1", "y1", "x2", "y2"]
    got, want = (sorted(map(tuple, df.select(columns).collect())) for df in (live, batch))
    assert got == want and len(got) > 100


def test_returning_track_is_a_new_vehicle_across_batches(spark, observe):
    walk = [(f, 50, 50) for f in (1, 2)] + [(3, 350, 50), (4, 350, 50)]
    again = [(f + 600, cx, cy) for f, cx, cy in walk]
    obs = observe({1: walk + again}).withColumn("zone", F.when(F.col("cx") < 100, "A").otherwise("B"))
    events = replay.replay(obs, lambda s: flows.stream_routes(s, 25.0, 2, 2), 25.0, slices=2)
    assert sorted((r.life_start, r.frame) for r in events.collect()) == [(1, 4), (601, 604)]
    assert lives.with_lives(obs).agg(F.max("life")).first()[0] == 2


def _source(spark, folder, seconds):
    rows = spark.createDataFrame([(s,) for s in seconds], "s bigint").select(
        F.lit("r").alias("run_id"), F.lit(0).cast("bigint").alias("camera_id"), F.col("s").alias("frame"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("ts"), F.lit(0).alias("det_idx"),
        *(F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit(0.9).alias("conf"), F.lit("car").alias("cls"))
    rows.write.mode("append").parquet(folder)


@pytest.mark.parametrize("late_by, counted", [(200, False), (5, True)])
def test_windows_close_and_late_rows_are_dropped(spark, tmp_path, late_by, counted):
    home = str(tmp_path)

    def consume(seconds):
        _source(spark, f"{home}/in", seconds)
        stream = stream_detections(spark, f"{home}/in", late="10 seconds")
        flow = flows.flow_per_window(stream, "1 minute")
        flows.start(flow, f"{home}/out", f"{home}/checkpoint").awaitTermination()
        return flow.schema

    consume([1, 2, 61, 215])
    consume([215 - late_by + 1, 300])
    schema = consume([500])
    rows = spark.read.schema(schema).parquet(f"{home}/out").collect()
    boxes = {r.window.start.minute: r.boxes for r in rows}
    assert boxes[0] == 2 and boxes[1] == 1
    assert boxes[3] == (2 if counted else 1)


def test_batches_can_be_handed_to_a_function(spark, tmp_path):
    home, seen = str(tmp_path), []
    _source(spark, f"{home}/in", range(20))
    stream = stream_detections(spark, f"{home}/in")
    tracked = tracks.stream_tracks(stream, min_hits=1)
    flows.on_batch(tracked, lambda df, n: seen.append(df.count()), f"{home}/checkpoint").awaitTermination()
    assert len(seen) >= 1


def test_rows_in_any_order_inside_the_lateness(spark, observe):
    """Rows that arrive batch by batch in reverse order give what the table gives."""
    walk = {k: [(f, 50 if f < 20 + k else 350, 50 + 3 * f) for f in range(1, 60)] for k in range(5)}
    obs = observe(walk).withColumn("zone", F.when(F.col("cx") < 100, "A").otherwise("B"))
    want = replay.replay(obs, lambda s: flows.stream_routes(s, 25.0, 4, 4), 25.0, slices=2).collect()
    got = replay.replay(obs, lambda s: flows.stream_routes(s, 25.0, 4, 4), 25.0, slices=4, delay_frames=200).collect()
    assert sorted(got) == sorted(want) and sorted((r.track_id, r.frame) for r in got) == [(k, 23 + k) for k in range(5)]


def test_rows_behind_the_watermark_are_counted(spark, observe, tmp_path):
    home = str(tmp_path)
    obs = replay.with_frame_time(observe({1: [(1, 50, 50), (2, 50, 50), (5000, 50, 50)], 2: [(7000, 1, 1)]}).withColumn("zone", F.lit("A")), 1.0)
    late = replay.with_frame_time(observe({1: [(3, 350, 50), (4, 350, 50)]}).withColumn("zone", F.lit("B")), 1.0)
    for rows in (obs, late):
        rows.write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{home}/in").withWatermark("ts", "10 seconds")
        query = flows.start(flows.stream_routes(stream, 1.0, 1, 2), f"{home}/out", f"{home}/checkpoint")
        query.awaitTermination()
    assert flows.late_rows(query) == 2


def _plain_route(zones, need, stay):
    """(at, route) of a machine that looks at one row after the other."""
    at, origin, seen, dest, stayed = "new", None, 0, None, 0
    for k, zone in enumerate(zones):
        if at == "new" and zone:
            at, origin, seen = "origin", zone, 1
        elif at == "origin":
            if zone == origin:
                seen += 1
            elif seen >= need:
                at, dest, stayed = "transit", zone, 1
            elif not zone:
                at = "new"
        elif at == "transit":
            if not zone or zone == origin:
                dest = None
            elif zone != dest:
                dest, stayed = zone, 1
            else:
                stayed += 1
            if dest and stayed >= stay and zone == dest and stayed > 1:
                return k, (origin, zone)
    return None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["A", "B", "C", None]), min_size=1, max_size=30), st.integers(1, 3), st.integers(2, 4), st.lists(st.integers(1, 29), max_size=4))
def test_route_machine_by_runs_equals_row_by_row(zones, need, stay, cuts):
    machine, found, edges = flows.RouteMachine(), [], sorted({0, *(c for c in cuts if c < len(zones)), len(zones)})
    state = machine.fresh
    for low, high in zip(edges, edges[1:]):
        part = pd.DataFrame({"zone": zones[low:high], "min_origin": need, "min_dest": stay})
        state, events = machine.advance(state, part)
        found += [(low + at, event) for at, event in events]
    want = _plain_route(zones, need, stay)
    assert found == ([want] if want else [])


@pytest.mark.parametrize("moves", [[(150, 200)], [(-200, 150)], [(-7 * k, k) for k in range(2, 90)], [(3 * k, 4 * k) for k in range(4, 60)]])
def test_stream_headings_break_ties_like_the_batch(spark, observe, moves):
    directions = {"Norte": ((100, 200), (100, 0)), "Sur": ((100, 0), (100, 200)), "Este": ((0, 100), (200, 100)), "Oeste": ((200, 100), (0, 100)),
                  "Diag": ((0, 0), (7, 7)), "Anti": ((0, 0), (-100, 100))}
    tracks = {k: [(f, 1000, 1000) for f in range(1, 5)] + [(5, 1000 + x, 1000 + y)] for k, (x, y) in enumerate(moves)}
    obs = observe(tracks)
    batch = headings.headings(lives.with_lives(obs, first=("cx", "cy"), total_frames=10), directions, total_frames=10)
    machine, live = flows.HeadingMachine(directions), {}
    for track, rows in tracks.items():
        _, found = machine.advance(machine.fresh, pd.DataFrame(rows, columns=["frame", "cx", "cy"]))
        live.update({track: event[0] for _, event in found})
    assert {r.track_id: r.direction for r in batch.collect()} == live


class Handle:
    """The states and timers of one key; calls are counted."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, set()

    def getValueState(self, name, schema):
        handle = self

        class State:
            def get(self):
                handle.calls += 1
                return handle.values.get(name)

            def update(self, value):
                handle.calls += 1
                handle.values[name] = value

            def clear(self):
                handle.calls += 1
                handle.values.pop(name, None)

        return State()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _handled(processor, handle, key, rows, watermark=0):
    processor.init(handle)
    return [row for made in processor.handleInputRows(key, iter([rows]), Watermark(watermark)) for row in made.itertuples(index=False, name=None)]


def test_state_is_read_and_written_once_for_a_bucket_of_tracks(spark):
    """As many calls for 300 tracks as for one; events are those of every track alone, and records go with the purge."""
    rows = pd.DataFrame([(k, f, "car", "A" if f < 10 + k % 7 else "B", 2, 2) for k in range(300) for f in range(1, 40)],
                        columns=["track_id", "frame", "cls", "zone", "min_origin", "min_dest"])
    rows["ts"] = pd.to_datetime(rows["frame"] * 40, unit="ms")
    processor, calls, found = flows.OrderedTracks(flows.RouteMachine(), [*"abcdefgh"], 25.0), [], []
    for tracks_ in (range(300), range(1)):
        part, handle = rows[rows["track_id"].isin(tracks_)].sample(frac=1, random_state=1), Handle()
        low = _handled(processor, handle, ("r", 0, 5), part[part["frame"] < 20], 400)
        low += _handled(processor, handle, ("r", 0, 5), part[part["frame"] >= 20], 1_600)
        found.append(sorted(low))
        calls.append(handle.calls)
        (at,), before = handle.timers, set(handle.values)
        assert before == {"lives", "timer"}
        processor.init(handle)
        list(processor.handleExpiredTimer(("r", 0, 5), Watermark(at + 1), None))
        assert not handle.values
    assert found[0] == [("r", 0, k, 1, 11 + k % 7, "car", "A", "B") for k in range(300)] and found[1] == found[0][:1]
    assert calls[0] == calls[1] < 20


@pytest.mark.parametrize("seed", range(4))
def test_stretches_of_a_camera_are_tracked_apart(spark, seed):
    """Whatever the batches, ids and boxes are those of one pass over the camera, and closed stretches leave no state."""
    rng, frame, rows = np.random.default_rng(seed), 0, []
    for _ in range(120):
        frame += int(rng.choice([1, 1, 1, 1, 3, 4, 5, 6, 20]))
        rows += [(frame, k, *(xy := rng.integers(0, 12, 2).tolist() if k % 2 else [200 + frame % 9, 50]), xy[0] + 40, xy[1] + 40) for k in range(rng.integers(1, 4))]
    table = pd.DataFrame(rows, columns=["frame", "det_idx", "x1", "y1", "x2", "y2"])
    plain, want = tracker.LiveTracks(3, 2, 0.2), []
    for now, boxes in table.groupby("frame"):
        found, ids = plain.advance(int(now), boxes[["x1", "y1", "x2", "y2"]].to_numpy(float))
        want += [("r", 0, now, track, *box) for box, track in zip(np.trunc(found).astype(int).tolist(), ids.tolist())]
    columns = ["run_id", "camera_id", "stretch", "open", "place", "frame", "x1", "y1", "x2", "y2"]
    handles, got, most = {}, [], 0
    edges = [0, *sorted(rng.choice(range(1, frame), 6, replace=False).tolist()), frame]
    late = table[table["frame"] <= 3]
    for low, high in zip(edges, edges[1:]):
        batch = table[(table["frame"] > low) & (table["frame"] <= high)].sample(frac=1, random_state=seed)
        batch = pd.concat([batch, late]) if low > 3 else batch
        cut = pd.DataFrame(_handled(tracks.Stretches(3, columns), handles.setdefault("cut", Handle()), ("r", 0), batch), columns=columns)
        middle = []
        for stretch, part in cut.groupby("stretch"):
            middle += _handled(tracks.StretchTracks(3, 2, 0.2), handles.setdefault(stretch, Handle()), ("r", 0, stretch), part)
            most = max(most, stretch)
        names = [field.split()[0] for field in tracks.StretchTracks.made.split(", ")]
        if middle:
            made = pd.DataFrame(middle, columns=names).sample(frac=1, random_state=seed)
            got += _handled(tracks.CameraIds(), handles.setdefault("ids", Handle()), ("r", 0), made)
    assert sorted(got) == sorted(want) and len(want) > 20 and most > 5
    assert [k for k, handle in handles.items() if k not in ("cut", "ids") and handle.values] == [most]
    assert handles["cut"].values["seen"][2] == len(late) * sum(low > 3 for low in edges[:-1])


def test_totals_count_a_batch_once(spark, tmp_path):
    def batch(n):
        return spark.createDataFrame([("a", n), ("b", 1)], "k string, cnt bigint")

    sums = totals.Totals(spark, str(tmp_path / "t"), ["k"])
    assert sums.read(batch(0)).count() == 0
    assert [sums.write(batch(2), 0), sums.write(batch(2), 0), sums.write(batch(5), 1)] == [True, False, True]
    # Written but not entered, as after a crash: not read, and replaced when it comes again.
    batch(100).write.parquet(str(tmp_path / "t/batches/2"))
    assert {tuple(r) for r in sums.read().collect()} == {("a", 7), ("b", 2)}
    sums.compact()
    assert {tuple(r) for r in sums.read().collect()} == {("a", 7), ("b", 2)}
    assert [sums.write(batch(5), 1), sums.write(batch(3), 2)] == [False, True]
    assert {tuple(r) for r in sums.read().collect()} == {("a", 10), ("b", 3)}
