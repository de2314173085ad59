"""Live routes, crossings and headings: the batch semantics on Structured Streaming.

Rows of a track may arrive in any order within the lateness of the watermark. They wait, and a timer at the watermark
releases them in frame order; rows behind the watermark are dropped by Spark and counted in its progress (`late_rows`). What is
released steps a small typed record per (run, camera, track), so results do not depend on how rows fall into batches. An
event-time timer drops the record at the purge that would drop the track, so state stays as small as the traffic in view.

A camera's tracks are dealt over `BUCKETS` by a hash of their id. The state of a bucket is one table of waiting rows and one of records, so
state is read, timed and written once per bucket and not once per track.

Results of a frame come when the watermark has passed it. Rows without a track are heartbeats: they move the watermark on and mean nothing
else, so a source that ends or pauses sends one to have its last frames released.

Needs the RocksDB state store; `start` sets it.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from flowlattice.functions.labels import DOWN, UP
from flowlattice.operators import crossings as crossing_ops
from flowlattice.operators.headings import FEWEST_OBSERVATIONS, LOWEST_SCORE, SHORTEST_MOVE
from flowlattice.operators.lives import EVERY, LIMIT
from flowlattice.schemas import RUN_CAMERA, TRACK

BUCKETS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _runs(values):
    """(start, stop) of the runs of equal neighbours; None equals None."""
    if not len(values):
        return []
    starts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()]
    return list(zip(starts, [*starts[1:], len(values)]))


class RouteMachine:
    """Zone routes, a run of rows in one zone at a time; rows need `zone`, `min_origin` and `min_dest`."""

    output = "origin string, destination string"
    columns = ("zone", "min_origin", "min_dest")
    held = "zone string, min_origin int, min_dest int"
    state = "at string, origin string, seen int, dest string, stayed int"
    fresh = ("new", None, 0, None, 0)
    class_of_life = True

    def advance(self, state, rows):
        at, origin, seen, dest, stayed = state
        zones = np.array([z if isinstance(z, str) else None for z in rows["zone"]], object)
        needs, stays = np.asarray(rows["min_origin"]), np.asarray(rows["min_dest"])
        found = []
        for start, stop in _runs(zones):
            zone, left = zones[start], stop - start
            need, stay = max(1, int(needs[start])), max(2, int(stays[start]))
            if at == "new" and zone is not None:
                at, origin, seen = "origin", zone, left
            elif at == "origin" and zone == origin:
                seen += left
            elif at == "origin" and seen < need:
                at = "new" if zone is None else at
            elif at == "origin":
                at, dest, stayed, left = "transit", zone, 0, left
            if at == "transit":
                if zone is None or zone == origin:
                    dest, stayed = None, 0
                    continue
                stayed = stayed if zone == dest else 0
                dest = zone
                if stayed + left >= stay:
                    found.append((start + stay - stayed - 1, (origin, zone)))
                    at = "done"
                stayed += left
        return (at, origin, seen, dest, stayed), found


class CrossingMachine:
    """Settled line crossings; rows need `cy` and `sides`, one of + - 0 for every line."""

    output = "line string, direction string"
    columns = ("cy", "sides")
    held = "cy int, sides string"
    state = "side array<int>, length array<int>, turn array<int>, y array<int>, seen array<int>"
    class_of_life = False

    def __init__(self, names, min_crossing=2):
        self.names, self.n = names, max(1, min_crossing)
        self.fresh = tuple([0] * len(names) for _ in range(5))

    def advance(self, state, rows):
        side, length, turn, last, seen = (list(v) for v in state)
        y, found = np.asarray(rows["cy"]), []
        signs = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in s] for s in rows["sides"]], int).reshape(len(y), len(self.names))
        for k, name in enumerate(self.names):
            near = np.flatnonzero(signs[:, k])
            for start, stop in _runs(signs[near, k]):
                here, many = int(signs[near[start], k]), stop - start
                if here != side[k]:
                    # Turns: 1 down, 2 up, 0 where the track came from nowhere.
                    turn[k] = 0 if side[k] == 0 else 1 if y[near[start]] > last[k] else 2
                    side[k], length[k] = here, 0
                at = self.n - length[k] - 1
                if 0 <= at < many and turn[k] and not seen[k] & turn[k]:
                    seen[k] |= turn[k]
                    found.append((int(near[start + at]), (name, DOWN if turn[k] == 1 else UP)))
                length[k] = min(length[k] + many, self.n)
                last[k] = int(y[near[stop - 1]])
        return (side, length, turn, last, seen), sorted(found, key=lambda e: e[0])


class HeadingMachine:
    """Heading of a track; `directions` is {name: (start, end)}. Scores are the batch operator's, term by term, so ties are too."""

    output = "direction string"
    columns = ("cx", "cy")
    held = "cx int, cy int"
    state = "x int, y int, seen int, done boolean"
    fresh = (None, None, 0, False)
    class_of_life = False

    def __init__(self, directions, min_origin=3):
        self.names, self.fewest = list(directions), max(min_origin, FEWEST_OBSERVATIONS)
        self.vectors = [(float(end[0] - start[0]), float(end[1] - start[1])) for start, end in directions.values()]

    def advance(self, state, rows):
        x, y, seen, done = state
        if done or not self.names:
            return state, []
        cx, cy = np.asarray(rows["cx"]), np.asarray(rows["cy"])
        x, y = (int(cx[0]), int(cy[0])) if seen == 0 else (x, y)
        dx, dy = cx.astype(float) - x, cy.astype(float) - y
        length, count = np.sqrt(dx * dx + dy * dy), seen + 1 + np.arange(len(cx))
        scores = np.zeros((len(self.names), len(cx)))
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (vx, vy) in enumerate(self.vectors):
                size = float(np.sqrt(vx * vx + vy * vy))
                if size:
                    scores[k] = (dx * vx + dy * vy) / (length * size)
        fits = np.flatnonzero((count >= self.fewest) & (length >= SHORTEST_MOVE) & (scores.max(axis=0) > LOWEST_SCORE))
        found = [(int(fits[0]), (self.names[int(scores[:, fits[0]].argmax())],))] if len(fits) else []
        return (x, y, seen + len(cx), bool(found)), found


class Kept:
    """A table in one state value, as an Arrow stream."""

    def __init__(self, handle, name, schema):
        self.state, self.schema = handle.getValueState(name, "body binary"), schema

    def read(self):
        held = self.state.get()
        return self.schema.empty_table() if held is None else pa.ipc.open_stream(bytes(held[0])).read_all()

    def write(self, columns):
        """Put columns in the schema's order in place of what is kept; without rows nothing is kept."""
        if not len(columns[0]):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        self.state.update((sink.getvalue().to_pybytes(),))


def _plain(column):
    """An Arrow column as an array of integers where none is null, and of objects otherwise."""
    if column.null_count == 0 and pa.types.is_integer(column.type):
        return column.to_numpy()
    made = np.empty(len(column), object)
    made[:] = column.to_pylist()
    return made


class OrderedTracks(StatefulProcessor):
    """Holds the rows of a bucket of tracks until the watermark has passed them, then steps a machine through those of each track, by
    the batch rule for lives."""

    def __init__(self, machine, columns, fps, every=EVERY, limit=LIMIT):
        self.machine, self.columns = machine, columns
        self.fps, self.every, self.limit = fps, every, limit
        self.schemas = [to_arrow_schema(StructType.fromDDL(text)) for text in (
            f"track_id bigint, frame bigint, ts bigint, cls string, {machine.held}",
            f"track_id bigint, life_start bigint, last bigint, last_ts bigint, kind string, {machine.state}")]

    def init(self, handle):
        self.handle = handle
        self.waiting, self.lives = (Kept(handle, name, schema) for name, schema in zip(("waiting", "lives"), self.schemas))
        self.timer = handle.getValueState("timer", "at bigint")

    def _purge_after(self, frame):
        return ((frame + self.limit) // self.every + 1) * self.every

    def _purged_at(self, life):
        """When the watermark is past this, in ms, the record goes."""
        _, last, clock, *_ = life
        return clock // 1000 + int((self._purge_after(last) - last) * 1000 / self.fps) + 1

    def _wake_at(self, ms, before):
        if before != ms:
            if before is not None:
                self.handle.deleteTimer(before)
            if ms is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(ms)
                self.timer.update((ms,))

    def _stepped(self, key, life, rows):
        """(record, events) after `rows` of a track, which are in frame order and follow all that came before."""
        frames, clock, kinds = rows["frame"], rows["ts"], rows["cls"]
        before = np.concatenate(([life[1] if life else frames[0]], frames[:-1]))
        opens = self._purge_after(before) <= frames - 1
        opens[0] |= life is None
        found = []
        starts = sorted({0, *np.flatnonzero(opens).tolist()})
        for start, stop in zip(starts, [*starts[1:], len(frames)]):
            part = {name: rows[name][start:stop] for name in self.machine.columns}
            begun, _, _, cls, *state = (int(frames[start]), None, None, kinds[start], *self.machine.fresh) if opens[start] else life
            state, events = self.machine.advance(tuple(state), part)
            life = (begun, int(frames[stop - 1]), int(clock[stop - 1]), cls, *state)
            found += [(*key, begun, int(frames[start + at]), cls if self.machine.class_of_life else kinds[start + at], *event)
                      for at, event in events]
        return life, found

    def _release(self, key, watermark, added, timer):
        """Events that are due; `added` are new rows, and `timer` is the one that is set."""
        held = pa.concat_tables([self.waiting.read(), *added])
        rows = {name: _plain(held.column(name)) for name in held.column_names}
        known = self.lives.read()
        lives = {track: tuple(life) for track, *life in zip(*(c.to_pylist() for c in known.columns))}
        due = rows["ts"] <= watermark * 1000
        found = []
        if due.any():
            picked = np.flatnonzero(due)
            picked = picked[np.lexsort((rows["frame"][picked], rows["track_id"][picked]))]  # stable, so equal frames keep their order
            ready = {name: column[picked] for name, column in rows.items()}
            for start, stop in _runs(ready["track_id"]):
                track = int(ready["track_id"][start])
                lives[track], events = self._stepped((*key, track), lives.get(track), {name: column[start:stop] for name, column in ready.items()})
                found += events
            rows = {name: column[~due] for name, column in rows.items()}
        if due.any() or added:
            self.waiting.write(list(rows.values()))
        # A timer fires when the watermark is past it. A track with rows that wait keeps its record.
        waits, times = set(rows["track_id"].tolist()), [-(-int(rows["ts"].min()) // 1000)] if len(rows["ts"]) else []
        ends = {track: self._purged_at(life) for track, life in lives.items() if track not in waits}
        gone = {track for track, at in ends.items() if at < watermark}
        if due.any() or gone:
            rest = [(track, *life) for track, life in lives.items() if track not in gone]
            self.lives.write(list(zip(*rest)) if rest else [[]])
        self._wake_at(min([*times, *(at for track, at in ends.items() if track not in gone)], default=None), timer)
        return pd.DataFrame(found, columns=self.columns)

    def _set(self):
        timer = self.timer.get()
        return None if timer is None else timer[0]

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows))
        batch = batch[batch["track_id"].notna()]
        if not len(batch):
            yield pd.DataFrame([], columns=self.columns)
            return
        clock = batch["ts"].to_numpy("datetime64[us]").astype(np.int64)
        columns = [clock if f.name == "ts" else batch[f.name] for f in self.waiting.schema]
        added = pa.Table.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, self.waiting.schema)], schema=self.waiting.schema)
        yield self._release(self._camera(key), timerValues.getCurrentWatermarkInMs(), [added], self._set())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        yield self._release(self._camera(key), timerValues.getCurrentWatermarkInMs(), [], None)

    @staticmethod
    def _camera(key):
        return tuple(None if pd.isna(part) else part for part in key[:len(RUN_CAMERA)])

    def close(self):
        pass


def _events(observations, machine, fps):
    schema = ("run_id string, camera_id bigint, track_id bigint, life_start bigint, frame bigint, "
              f"cls string, {machine.output}")
    columns = [field.split()[0] for field in schema.split(", ")]
    rows = observations.select(*TRACK, "frame", "ts", "cls", *machine.columns, F.pmod(F.xxhash64("track_id"), F.lit(BUCKETS)).alias("bucket"))
    return rows.groupBy(*RUN_CAMERA, "bucket").transformWithStateInPandas(
        OrderedTracks(machine, columns, fps), schema, "append", "eventTime")


def stream_routes(observations, fps, min_origin=3, min_dest=3):
    """Completed routes of a stream of observations that already have a `zone`.

    The thresholds may be columns of the stream, as a join with a table of sites adds them.
    """
    given = {"min_origin": min_origin, "min_dest": min_dest}
    asked = observations.withColumns({n: (v if hasattr(v, "alias") else F.lit(v)).cast("int") for n, v in given.items()})
    return _events(asked, RouteMachine(), fps)


def stream_crossings(observations, lines, fps, min_crossing=2, anchors="box"):
    """Settled crossings. The sides near every row are worked out before the stateful step."""
    near = F.transform(crossing_ops.line_array(lines), lambda k: crossing_ops.side_near(k, anchors))
    signs = F.transform(near, lambda side: F.when(side > 0, "+").when(side < 0, "-").otherwise("0"))
    return _events(observations.withColumn("sides", F.array_join(signs, "")),
                   CrossingMachine([line["name"] for line in lines], min_crossing), fps)


def stream_headings(observations, directions, fps, min_origin=3):
    return _events(observations, HeadingMachine(directions, min_origin), fps)


def late_rows(query):
    """Rows of a stream that came behind the watermark and were left out, by Spark's count."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def _without_heartbeats(observations, column):
    """Rows that are no heartbeats. The condition names the event time, so it is not pushed below the watermark, which heartbeats move."""
    return observations.where(F.col(column).isNotNull() | F.col("ts").isNull())


def flow_per_window(observations, window="1 minute"):
    """Boxes per camera, class and tumbling window, given out when the watermark closes it; late rows beyond the watermark are dropped."""
    return _without_heartbeats(observations, "camera_id").groupBy("run_id", "camera_id", F.window("ts", window), "cls").agg(
        F.count(F.lit(1)).alias("boxes"))


def progress_per_window(observations, seconds=10):
    """Boxes, tracks and boxes a second per camera and window, given out when the watermark closes it.

    Tracks are counted exactly: boxes are summed per track first, so state is one number per track and window in view.
    """
    window = F.window("ts", f"{seconds} seconds")
    per_track = _without_heartbeats(observations, "track_id").groupBy(*TRACK, window).agg(F.count(F.lit(1)).alias("boxes"))
    return per_track.groupBy("run_id", "camera_id", "window").agg(F.sum("boxes").alias("boxes"), F.count(F.lit(1)).alias("tracks")).select(
        "run_id", "camera_id", F.col("window.start").alias("window_start"), "boxes", "tracks", (F.col("boxes") / F.lit(float(seconds))).alias("rate"))


def start(events, path, checkpoint, fmt="parquet", available_now=True):
    """Starts writing an event stream; append mode, exactly once with the file sink."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = events.writeStream.outputMode("append").format(fmt).option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def on_batch(events, handle, checkpoint, available_now=True):
    """Calls `handle(batch, batch_id)` with every batch of events."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = events.writeStream.outputMode("append").foreachBatch(handle).option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
