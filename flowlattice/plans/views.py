"""Input tables derived from `events`: tracked observations and raw overlapping boxes.

The same text in SQL, for the comparison engine, is in `plans.oracle`. A derived table is written
to the shared folder once per application, as the detection table a user would have on disk, and
scanned from there by every query.
"""

import contextlib
import uuid

from pyspark.sql import functions as F

from flowlattice.operators.ordered import numbered
from flowlattice.session import shared_dir
from flowlattice.sources.detections import read_detections

_WRITTEN = {}

# Fixed values of the test site: zones in match priority, counting lines, directions.
ZONES = {
    "W": [(0, 0), (120, 0), (120, 520), (0, 520)],
    "E": [(560, 0), (700, 0), (700, 520), (560, 520)],
    "N": [(0, 0), (700, 0), (700, 90), (0, 90)],
    "S": [(0, 400), (700, 400), (700, 520), (0, 520)],
}
FRAME_SIZE = (700, 520)

_KEY = "run_id string, camera_id bigint"
_BOX = "x1 int, y1 int, x2 int, y2 int"
OBSERVED = (f"{_KEY}, track_id bigint, frame bigint, event_id bigint, ts timestamp, {_BOX}, "
            "cx int, cy int, conf double, cls string")
DETECTED = f"{_KEY}, frame bigint, det_idx int, {_BOX}, conf double, cls string"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _written(spark, folder, name, build):
    key = (spark.sparkContext.applicationId, str(folder), name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"
        # Files enough for all cores, like any larger table has.
        build(spark, folder).repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def observations_path(spark, folder):
    return _written(spark, folder, "observations", derive_observations)


def detections_path(spark, folder):
    return _written(spark, folder, "detections", derive_detections)


def runs(spark, folder, name="observations"):
    """Run metadata of a derived table: (run_id, camera_id, total_frames)."""
    def build(spark, folder):
        source = observations if name == "observations" else detections
        return source(spark, folder).groupBy("run_id", "camera_id").agg(
            F.max("frame").alias("total_frames"))

    return spark.read.schema(f"{_KEY}, total_frames bigint").parquet(
        _written(spark, folder, f"runs_of_{name}", build))


_UNBOUNDED = []


@contextlib.contextmanager
def unbounded_runs():
    """Plans made inside know no bound on the length of a run."""
    _UNBOUNDED.append(True)
    try:
        yield
    finally:
        _UNBOUNDED.pop()


def total_frames(spark, folder, name="observations"):
    """The longest run, from the metadata; looked up once per application."""
    if _UNBOUNDED:
        return None
    key = (spark.sparkContext.applicationId, str(folder), f"longest_{name}")
    if key not in _WRITTEN:
        _WRITTEN[key] = runs(spark, folder, name).agg(F.max("total_frames")).first()[0]
    return _WRITTEN[key]


def observations(spark, folder):
    return spark.read.schema(OBSERVED).parquet(observations_path(spark, folder))


def detections(spark, folder):
    return read_detections(spark, detections_path(spark, folder), schema=DETECTED)


def _class_of(event_type):
    return (F.when(event_type == "click", "car").when(event_type == "view", "truck")
            .when(event_type == "purchase", "bus").when(event_type == "signup", "motorbike")
            .otherwise("person"))


def _conf():
    return F.lit(0.05) + F.pmod(F.col("event_id") * 7919, F.lit(90)) / F.lit(100.0)


def derive_observations(spark, folder):
    """One tracked box per event: user -> track, event order -> frame, linear motion."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    e = numbered(events, ["user_id"], "event_id", "rn")
    u, rn, i = F.col("user_id"), F.col("rn"), F.col("event_id")
    moved = e.select(
        F.when(u % 8 < 4, "am").otherwise("pm").alias("run_id"),
        (u % 4).cast("bigint").alias("camera_id"),
        u.alias("track_id"), i, "ts",
        (rn + F.when((u % 5 == 0) & (rn > 30), 330).otherwise(0)).cast("bigint").alias("frame"),
        F.when(u % 3 == 0, 10 + rn * 10).when(u % 3 == 1, 690 - rn * 10)
        .otherwise(100 + (u % 6) * 80).cast("int").alias("cx"),
        F.when(u % 3 == 2, 10 + rn * 7).otherwise(40 + (u % 8) * 50 + i % 5)
        .cast("int").alias("cy"),
        (16 + (u % 5) * 8).cast("int").alias("w"),
        (12 + (u % 4) * 6 + i % 3).cast("int").alias("h"),
        _conf().alias("conf"), _class_of(F.col("event_type")).alias("cls"))
    x1, y1 = F.col("cx") - F.floor(F.col("w") / 2).cast("int"), F.col("cy") - F.floor(
        F.col("h") / 2).cast("int")
    return moved.select(
        "run_id", "camera_id", "track_id", "frame", "event_id",
        # The same wall clock in UTC, whatever the session's time zone is.
        F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))").alias("ts"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("w")).alias("x2"), (y1 + F.col("h")).alias("y2"),
        "cx", "cy", "conf", "cls")


def derive_detections(spark, folder):
    """Eight overlapping boxes per frame."""
    i = F.col("event_id")
    x1 = (i % 3) * 70 + (i * 53) % 31
    y1 = (i * 29) % 23
    frame = F.shiftright("event_id", 3) + 1
    return table(spark, folder, "events").select(
        F.lit("am").alias("run_id"), (F.pmod(F.shiftright(frame, 6), F.lit(4))).cast("bigint").alias("camera_id"),
        frame.alias("frame"), (i % 8).cast("int").alias("det_idx"),
        x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
        (x1 + 60 + i % 7).cast("int").alias("x2"), (y1 + 50 + i % 5).cast("int").alias("y2"),
        _conf().alias("conf"), _class_of(F.col("event_type")).alias("cls"))


def tracked_boxes(spark, folder):
    """Track boxes near the raw boxes, for the class joins."""
    d = detections(spark, folder)
    k = F.col("det_idx")
    return d.select(
        "run_id", "camera_id", "frame", (k + 1).cast("bigint").alias("track_id"),
        (F.col("x1") + k * 3).alias("x1"), (F.col("y1") + 2 * k).alias("y1"),
        (F.col("x2") + k * 3).alias("x2"), (F.col("y2") + 2 * k).alias("y2"))


def site_configs(spark, folder):
    """One made-up site per customer, many of them faulty, in the site-config schema."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    return c.selectExpr(
        "concat('site-', k) AS site_id",
        "CASE k % 7 WHEN 0 THEN 'lines' WHEN 1 THEN 'directions' WHEN 2 THEN 'other' ELSE 'zones' END AS counting_mode",
        """map_from_entries(transform(filter(array(0, 1, 2), i -> i < k % 4), i -> struct(
             concat('Z', i) AS key,
             slice(array(array(0, 0), array(CAST(5 + (k*7+i) % 20 AS INT), 0),
                         array(CAST(5 + (k*7+i) % 20 AS INT), CAST(5 + (k*7+i) % 20 AS INT)),
                         array(0, CAST(5 + (k*7+i) % 20 AS INT))), 1, CAST(2 + (k+i) % 3 AS INT)) AS value))) AS zones""",
        """transform(filter(array(0, 1), j -> j < k % 3), j -> named_struct(
             'name', concat('L', j),
             'points', slice(array(array(0, 0), array(CAST(4 + (k+j) % 15 AS INT), 0)), 1, CAST(1 + (k+j) % 2 AS INT)),
             'tolerance', CAST(NULL AS INT))) AS lines""",
        # One direction each: one point, a point of one coordinate, or a sound one.
        """map('D', CASE k % 5 WHEN 0 THEN array(array(1, 1)) WHEN 1 THEN array(array(1, 1), array(2))
             ELSE array(array(0, 0), array(CAST(k % 9 AS INT), 5)) END) AS directions""",
        """named_struct('conf_threshold', (k % 13) / 10.0D, 'imgsz', CAST(200 + (k % 5) * 100 AS INT),
             'min_area', CAST(k % 9 - 2 AS INT), 'max_area', CAST(k % 11 AS INT)) AS settings""",
        """named_struct('slice_width', CAST(32 + (k % 3) * 32 AS INT), 'slice_height', CAST(48 + (k % 4) * 16 AS INT),
             'overlap_ratio', (k % 12) / 10.0D, 'nms_threshold', 0.3D) AS sahi""",
        """named_struct('max_age', CAST(k % 3 AS INT), 'min_hits', CAST(k % 2 AS INT),
             'iou_threshold', (k % 6) / 4.0D) AS tracker""")


def frame_sizes(spark, folder):
    """One frame size per part."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("frame_id"),
        (320 + (F.col("p_partkey") % 7) * 200).cast("int").alias("frame_width"),
        (240 + (F.col("p_partkey") % 5) * 150).cast("int").alias("frame_height"))


def drawn_zones(spark, folder):
    """One five-cornered ring per customer."""
    k = F.col("c_custkey")

    def point(x, y):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    ring = F.array(
        point(k % 50, k % 30), point(k % 50 + 100 + k % 17, k % 30 + k % 11),
        point(k % 50 + 120, k % 30 + 90), point(k % 50 + 40, k % 30 + 60 + k % 13),
        point(k % 50 - 20, k % 30 + 80))
    return table(spark, folder, "customer").select(k.alias("zone_id"), ring.alias("ring"))


def cameras(spark, folder):
    """One site per run and camera, as a join of `sources.site` tables gives it: zones, thresholds, frame size, directions and lines differ."""
    k = F.col("camera_id").cast("int")

    def ring(x1, y1, x2, y2):
        return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))))

    zero, right, bottom = F.lit(0), F.lit(700), F.lit(520)
    rings = {"W": ring(zero, zero, 120 + 20 * k, bottom), "E": ring(560 - 10 * k, zero, right, bottom),
             "N": ring(zero, zero, right, 90 + 5 * k), "S": ring(zero, 400 - 10 * k, right, bottom)}
    zones = F.array(*(F.struct(F.lit(i).alias("zone_order"), F.lit(n).alias("zone"), r.alias("ring")) for i, (n, r) in enumerate(rings.items())))
    zones = F.slice(zones, 1, F.when(k == 3, 2).otherwise(4))
    directions = F.array(*(F.struct(F.lit(n).alias("direction"), x.alias("dx"), y.alias("dy")) for n, x, y in (
        ("up", zero, -10 - k), ("down", zero, 20 + k), ("right", 30 + zero, 5 * k), ("left", F.lit(-40), zero))))
    return runs(spark, folder).select(
        "run_id", "camera_id", zones.alias("zones"), F.transform(zones, lambda z: z["zone"]).alias("zone_names"),
        (2 + k % 3).alias("min_origin"), (2 + k % 2).alias("min_dest"), (1 + k % 2).alias("min_crossing"),
        F.when(k % 2 == 1, F.reverse(directions)).otherwise(F.slice(directions, 1, 3)).alias("directions"),
        (700 - 50 * k).alias("frame_width"), (520 - 40 * k).alias("frame_height"))
