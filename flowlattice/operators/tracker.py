"""Linking detections to tracks: one sequential job per busy stretch of a camera.

Follows the published method "Simple Online and Realtime Tracking" (Bewley et al., 2016): a constant
velocity filter per track, one-to-one assignment on predicted overlap, births, deaths, and output
only of confirmed tracks.

A tracker that has been empty carries nothing forward, so a camera's timeline is cut wherever no
track can be alive, and the stretches run in parallel. Inside a stretch the method is sequential by
nature; frames stream through the task in Arrow batches and only the live tracks are held.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowlattice.operators.ordered import running, with_trailing
from flowlattice.schemas import FRAME, RUN_CAMERA
from flowlattice.session import checkpointed

# Fixed values of the method, per measured axis: centre x, centre y, area, shape. The shape has no speed.
VALUE_NOISE = np.array([1.0, 1.0, 1.0, 1.0])
SPEED_NOISE = np.array([0.01, 0.01, 0.0001, 0.0])
MEASUREMENT_NOISE = np.array([1.0, 1.0, 10.0, 10.0])
START_VALUE_VARIANCE = np.array([10.0, 10.0, 10.0, 10.0])
START_SPEED_VARIANCE = np.array([10000.0, 10000.0, 10000.0, 0.0])
AREA = 2


def best_assignment(gain):
    """Pairs (row, column) with the largest total gain, one to one, by augmenting paths.

    Plain lists: up to a hundred boxes they beat array calls, and most frames have few.
    """
    flipped = gain.shape[0] > gain.shape[1]
    cost = (-(gain.T if flipped else gain)).tolist()
    width = len(cost[0])
    price_row, price_col, owner = [0.0] * len(cost), [0.0] * width, [-1] * width
    for row in range(len(cost)):
        reach, came = [float("inf")] * width, [-1] * width
        unseen, seen = list(range(width)), []
        at, col, base = row, -1, 0.0
        while True:
            line, shift, nearest = cost[at], base - price_row[at], float("inf")
            for c in unseen:
                slack = line[c] - price_col[c] + shift
                if slack < reach[c]:
                    reach[c], came[c] = slack, col
                if reach[c] < nearest:
                    nearest, closest = reach[c], c
            base, col = nearest, closest
            if owner[col] < 0:
                break
            unseen.remove(col)
            seen.append(col)
            at = owner[col]
        price_row[row] += base
        for c in seen:
            price_row[owner[c]] += base - reach[c]
            price_col[c] -= base - reach[c]
        while col >= 0:
            owner[col], col = row if came[col] < 0 else owner[came[col]], came[col]
    pairs = np.array([(r, c) for c, r in enumerate(owner) if r >= 0])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return pairs[:, ::-1] if flipped else pairs


def overlap_groups(meets):
    """[(rows, columns)] of the connected groups of a table of meetings; boxes of different groups have nothing to gain
    from each other."""
    groups, free = [], set(np.flatnonzero(meets.any(axis=1)).tolist())
    while free:
        rows, columns, border = set(), set(), {free.pop()}
        while border:
            rows |= border
            columns |= set(np.flatnonzero(meets[sorted(border)].any(axis=0)).tolist())
            border = set(np.flatnonzero(meets[:, sorted(columns)].any(axis=1)).tolist()) - rows
        free -= rows
        groups.append((np.array(sorted(rows)), np.array(sorted(columns))))
    return groups


def matches(score, threshold):
    """(row, column) pairs of at least `threshold`, one to one within each group of overlapping boxes.

    A group in which every good overlap is some pair's only one is settled by them; in any other the pairs
    have the largest total overlap.
    """
    found = []
    for rows, columns in overlap_groups(score > 0):
        part = score[np.ix_(rows, columns)]
        good = part > threshold
        clear = good.any() and good.sum(axis=0).max() == 1 and good.sum(axis=1).max() == 1
        pairs = np.argwhere(good) if clear else best_assignment(part)
        found += [(rows[r], columns[c]) for r, c in pairs if part[r, c] >= threshold]
    return np.array(sorted(found), int).reshape(-1, 2)


def overlap(a, b):
    """IoU of every box of `a` with every box of `b`."""
    side = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    np.maximum(side, 0, out=side)
    inter = side[:, :, 0] * side[:, :, 1]
    size = [(k[:, 2] - k[:, 0]) * (k[:, 3] - k[:, 1]) for k in (a, b)]
    union = size[0][:, None] + size[1][None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


class AxisFilters:
    """Constant-speed filters of many tracks, one per measured axis; axes do not mix, so every filter is a few scalars.

    `value` and `speed` are the means, `spread` their variances and covariance (value, both, speed).
    """

    def __init__(self):
        self.value, self.speed, self.spread = np.empty((0, 4)), np.empty((0, 4)), np.empty((3, 0, 4))

    def __len__(self):
        return len(self.value)

    def take(self, rows):
        self.value, self.speed, self.spread = self.value[rows], self.speed[rows], self.spread[:, rows]

    def start(self, measured):
        still = np.zeros_like(measured)
        spread = np.stack([still + START_VALUE_VARIANCE, still, still + START_SPEED_VARIANCE])
        self.value, self.speed = np.vstack([self.value, measured]), np.vstack([self.speed, still])
        self.spread = np.concatenate([self.spread, spread], axis=1)

    def step(self):
        """One frame on. An area never shrinks to nothing: its speed is dropped before that."""
        vanishing = self.value[:, AREA] + self.speed[:, AREA] <= 0
        self.speed[vanishing, AREA] = 0.0
        self.value += self.speed
        own, both, speed = self.spread
        self.spread = np.stack([own + 2 * both + speed + VALUE_NOISE, both + speed, speed + SPEED_NOISE])

    def absorb(self, rows, measured):
        own, both, speed = self.spread[:, rows]
        total = own + MEASUREMENT_NOISE
        surprise = measured - self.value[rows]
        self.value[rows] += own / total * surprise
        self.speed[rows] += both / total * surprise
        self.spread[:, rows] = own * MEASUREMENT_NOISE / total, both * MEASUREMENT_NOISE / total, speed - both * both / total


def measured(boxes):
    """Centre, area and shape (width by height) of boxes."""
    size = boxes[:, 2:] - boxes[:, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.column_stack([boxes[:, :2] + size / 2, size.prod(axis=1), size[:, 0] / size[:, 1]])


def boxes_of(values):
    with np.errstate(divide="ignore", invalid="ignore"):
        width = np.sqrt(values[:, 2] * values[:, 3])
        half = np.column_stack([width, values[:, 2] / width]) / 2
    return np.hstack([values[:, :2] - half, values[:, :2] + half])


class LiveTracks:
    """All tracks of one camera. A track knows the frame it was last seen in and the one its unbroken run began in."""

    def __init__(self, max_age, min_hits, threshold):
        self.max_age, self.min_hits, self.threshold = max_age, min_hits, threshold
        self.born, self.frame, self.late = 0, None, 0
        self.filters = AxisFilters()
        self.ids, self.seen, self.since = (np.empty(0, np.int64) for _ in range(3))

    def state(self):
        """All that later frames depend on, as plain arrays and numbers."""
        return {"born": self.born, "frame": self.frame, "late": self.late, "ids": self.ids, "seen": self.seen, "since": self.since, "filters": vars(self.filters)}

    def resume(self, state):
        filters = state.pop("filters")
        vars(self).update(state)
        vars(self.filters).update(filters)
        return self

    def _take(self, rows):
        self.filters.take(rows)
        self.ids, self.seen, self.since = self.ids[rows], self.seen[rows], self.since[rows]

    def _move_to(self, frame):
        """Predict up to `frame`; tracks unseen for too long end on the way."""
        for now in range(frame if self.frame is None else self.frame + 1, frame + 1):
            if not len(self.ids):
                break
            self.filters.step()
            expected = boxes_of(self.filters.value)
            self._take(np.isfinite(expected).all(axis=1) & ((now == frame) | (now - self.seen <= self.max_age)))
        self.frame = frame

    def advance(self, frame, boxes):
        """One frame; skipped frames count as empty. Returns (boxes, ids) of confirmed tracks."""
        self._move_to(frame)
        pairs = matches(overlap(boxes, boxes_of(self.filters.value)), self.threshold) if len(boxes) and len(self.ids) else np.empty((0, 2), int)
        used, tracks = pairs.T
        if len(pairs):
            self.filters.absorb(tracks, measured(boxes[used]))
            self.since[tracks] = np.where(self.seen[tracks] == frame - 1, self.since[tracks], frame - 1)
            self.seen[tracks] = frame
        new = np.delete(boxes, used, axis=0)
        if len(new):
            self.filters.start(measured(new))
            self.ids = np.append(self.ids, self.born + 1 + np.arange(len(new)))
            self.seen, self.since = (np.append(x, np.full(len(new), frame)) for x in (self.seen, self.since))
            self.born += len(new)
        current = boxes_of(self.filters.value)
        # The first frames of a run show tracks before they can have been seen often enough. A box without height or
        # width has no shape to follow; its track ends at the next frame.
        long_enough = self.seen - self.since >= (self.min_hits if frame > self.min_hits else 0)
        shown = (self.seen == frame) & long_enough & np.isfinite(current).all(axis=1)
        result = current[shown], self.ids[shown]
        self._take(frame - self.seen <= self.max_age)
        return result


def _stretches(dets, max_age, total_frames):
    """Frames with detections, numbered by stretches between which no track survives."""
    frames = dets.select(*FRAME).distinct()
    linked = with_trailing(frames, RUN_CAMERA, "frame", 1, lambda w: {"_last": F.lag("frame").over(w)},
                           bound=total_frames)
    starts = F.col("_last").isNull() | (F.col("frame") - F.col("_last") > max_age + 1)
    return running(linked, RUN_CAMERA, "frame", {"_stretch": starts.cast("bigint")},
                   bound=total_frames).drop("_last")


_LINKED = ("run_id string, camera_id bigint, _stretch bigint, frame bigint, track_id bigint, "
           "x1 int, y1 int, x2 int, y2 int")


def track_detections(dets, max_age=40, min_hits=3, iou=0.2, total_frames=None):
    """Boxes of confirmed tracks (run_id, camera_id, frame, track_id, box), ids from 1 per camera.

    Ids count births in frame order over the whole camera: every stretch reports its births, and
    the running sum of earlier stretches is added. Boxes are truncated to whole pixels.
    """
    def link(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_id, camera_id, stretch = key
        live = LiveTracks(max_age, min_hits, iou)
        open_frame, open_boxes = None, []
        rows = []

        def close():
            if open_frame is None:
                return
            boxes, ids = live.advance(open_frame, np.array(open_boxes, float))
            for box, track in zip(np.trunc(boxes).astype(int).tolist(), ids.tolist()):
                rows.append((run_id, camera_id, stretch, open_frame, track, *box))

        def table():
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _LINKED.split(", ")])
            rows.clear()
            return frame

        for batch in batches:
            for frame, x1, y1, x2, y2 in zip(*(batch[c].tolist() for c in (
                    "frame", "x1", "y1", "x2", "y2"))):
                if frame != open_frame:
                    if open_frame is not None and frame < open_frame:
                        raise ValueError("detections must reach the tracker in frame order")
                    close()
                    open_frame, open_boxes = frame, []
                open_boxes.append((x1, y1, x2, y2))
            yield table()
        close()
        # The last row reports the births of the stretch.
        rows.append((run_id, camera_id, stretch, None, live.born, 0, 0, 0, 0))
        yield table()

    keys = [*RUN_CAMERA, "_stretch"]
    placed = dets.select(*FRAME, "det_idx", "x1", "y1", "x2", "y2").join(
        _stretches(dets, max_age, total_frames), list(FRAME))
    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "frame", "det_idx")
    linked = checkpointed(ordered.groupBy(*keys).applyInPandas(link, _LINKED))
    births = linked.filter("frame IS NULL").select(*keys, F.col("track_id").alias("_born"))
    offsets = running(births, RUN_CAMERA, "_stretch", {"_upto": F.col("_born")},
                      bound=total_frames).select(
        *keys, (F.col("_upto") - F.col("_born")).alias("_offset"))
    return linked.filter("frame IS NOT NULL").join(offsets, keys).select(
        *FRAME, (F.col("track_id") + F.col("_offset")).alias("track_id"), "x1", "y1", "x2", "y2")
