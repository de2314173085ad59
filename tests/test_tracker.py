import itertools

import numpy as np
import pytest

from flowlattice.operators import scoring, tracker
from flowlattice.operators.overlaps import attach_class
from flowlattice.plans import catalog, views

SCHEMA = ("run_id string, camera_id bigint, frame bigint, det_idx int, x1 int, y1 int, x2 int, y2 int, "
          "conf double, cls string")


def scene(spark, boxes_by_frame, camera=0):
    return spark.createDataFrame(
        [("r", camera, f, i, *b, 0.9, "bus") for f, boxes in boxes_by_frame.items() for i, b in enumerate(boxes)], SCHEMA)


def tracked(dets, **options):
    rows = tracker.track_detections(dets, **options).collect()
    return sorted((r.camera_id, r.frame, r.track_id, r.x1) for r in rows)


def box(x, y, side=40):
    return (x, y, x + side, y + side)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (3, 6), (6, 6)):
        for _ in range(20):
            gain = rng.random((n, m)) * (rng.random((n, m)) < 0.7)
            small, large = min(n, m), max(n, m)
            table = gain if n <= m else gain.T
            best = max(sum(table[i, c] for i, c in enumerate(cols))
                       for cols in itertools.permutations(range(large), small))
            for solve in (tracker.best_assignment, lambda table: tracker.matches(table, 0.0)):
                pairs = solve(gain)
                assert len(set(pairs[:, 0])) == len(pairs) == len(set(pairs[:, 1]))
                assert gain[pairs[:, 0], pairs[:, 1]].sum() == pytest.approx(best)


def test_three_tracks_keep_their_ids(spark):
    frames = {f: [box(10 + 4 * f, 10), box(300 - 4 * f, 100), box(50, 200 + 3 * f)] for f in range(1, 21)}
    rows = tracked(scene(spark, frames))
    assert {r[2] for r in rows} == {1, 2, 3}
    assert len(rows) == 60
    firsts = [x for _, f, t, x in rows if t == 1]
    assert firsts == sorted(firsts)


def test_confirmation_needs_hits_after_the_start(spark):
    frames = {f: [box(10, 10)] for f in range(1, 31)}
    for f in range(10, 31):
        frames[f] = [box(10, 10), box(200, 200)]
    frames_of_second = [r[1] for r in tracked(scene(spark, frames), min_hits=3) if r[2] == 2]
    assert min(frames_of_second) == 13


def test_short_gap_keeps_the_id_and_long_gap_does_not(spark):
    seen = [1, 2, 3, 4, 8, 9, 10, 11, 12, 40, 41, 42, 43, 44]
    rows = tracked(scene(spark, {f: [box(10, 10)] for f in seen}), max_age=5, min_hits=1)
    ids = {f: t for _, f, t, _ in rows}
    assert {ids[f] for f in (1, 2, 3, 9, 12)} == {1}
    assert {ids[f] for f in (41, 42, 44)} == {2}


def test_cameras_count_their_own_ids_and_stretches_change_nothing(spark):
    frames = {f: [box(10, 10), box(200, 10)] for f in (*range(1, 9), *range(30, 38), *range(60, 68))}
    both = scene(spark, frames).union(scene(spark, frames, camera=1))
    rows = tracked(both, max_age=3, min_hits=1)
    assert [r[1:] for r in rows if r[0] == 0] == [r[1:] for r in rows if r[0] == 1]
    # The same camera in one uninterrupted pass.
    live, want = tracker.LiveTracks(3, 1, 0.2), []
    for f in sorted(frames):
        boxes, ids = live.advance(f, np.array(frames[f], float))
        want += [(f, int(t), int(b[0])) for b, t in zip(boxes, ids)]
    assert [r[1:] for r in rows if r[0] == 0] == sorted(want)
    assert {t for _, t, _ in want} == {1, 2, 3, 4, 5, 6}


@pytest.mark.parametrize("name", ["track_detections", "stream_track_detections"])
def test_registered_tracking_keeps_ids_over_gaps_of_up_to_forty_frames(spark, monkeypatch, name):
    # Unseen for 4, 19 and 40 frames, then for 41.
    seen = [*range(1, 9), *range(13, 21), *range(40, 48), *range(88, 96), *range(137, 145)]
    boxes = {f: [(box(10, 10), 0.9, "bus"), (box(300, 10), 0.1, "car"), (box(10, 300), 0.05, "car"), (box(300, 300), 0.9, "person")]
             for f in seen}
    rows = [("r", c, f, i, *b, conf, cls) for c in (0, 1) for f, found in boxes.items() for i, (b, conf, cls) in enumerate(found)]
    monkeypatch.setattr(views, "detections", lambda *_: spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(views, "total_frames", lambda *_: max(seen))
    got = sorted((r.camera_id, r.frame, r.track_id, r.x1, r.y1) for r in catalog.QUERIES[name](spark, "").collect())
    live, want = tracker.LiveTracks(40, 3, 0.2), []
    for f in seen:
        found, ids = live.advance(f, np.array([b for b, conf, cls in boxes[f] if conf >= 0.1 and cls != "person"], float))
        want += [(c, f, int(t), int(b[0]), int(b[1])) for c in (0, 1) for b, t in zip(found, ids)]
    assert got == sorted(want)
    assert {r[2] for r in got if r[1] < 100} == {1, 2} and {r[2] for r in got if r[1] > 100} == {3, 4}


def test_flat_boxes_do_not_disturb_others():
    live = tracker.LiveTracks(3, 1, 0.2)
    for f in range(1, 6):
        boxes, ids = live.advance(f, np.array([(5, 5, 5, 5), box(50, 50), (9, 9, 20, 9)], float))
        assert np.isfinite(boxes).all() and 2 in ids


def test_tracks_get_classes(spark):
    dets = scene(spark, {f: [box(10 + f, 10)] for f in range(1, 6)})
    labelled = attach_class(tracker.track_detections(dets), dets).collect()
    assert {r.cls for r in labelled} == {"bus"} and len(labelled) == 5


def test_detector_hook_filters_and_suppresses(spark):
    frames = spark.createDataFrame([("r", 0, f, bytearray(b"x" * f)) for f in range(1, 5)],
                                   "run_id string, camera_id bigint, frame bigint, image binary")

    def infer(image, conf):
        n = len(image)
        return [{"bbox": (0, 0, 50, 50), "cls_name": "car", "conf": 0.9},
                {"bbox": (1, 1, 51, 51), "cls_name": "truck", "conf": 0.8},
                {"bbox": (200, 0, 250, 50), "cls_name": "person", "conf": 0.9},
                {"bbox": (0, 200, 50, 250 + n), "cls_name": "bus", "conf": 0.05 * n}]

    assert scoring.detect_frames(frames, infer).count() == 16
    kept = scoring.detect_vehicles(frames, infer, 0.1, {"bus": 0.15}, nms_threshold=0.3).collect()
    assert sorted((r.frame, r.cls) for r in kept) == [
        (1, "car"), (2, "car"), (3, "bus"), (3, "car"), (4, "bus"), (4, "car")]
