"""Explicit schemas of the tables the package reads and writes."""

from pyspark.sql import types as T

RUN_CAMERA = ("run_id", "camera_id")
FRAME = (*RUN_CAMERA, "frame")
TRACK = (*RUN_CAMERA, "track_id")
LIFE = (*TRACK, "life")


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_KEY = (("run_id", T.StringType()), ("camera_id", T.LongType()))
_BOX = tuple((c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2"))

DETECTIONS = _struct(
    *_KEY, ("frame", T.LongType()), ("ts", T.TimestampType()), ("det_idx", T.IntegerType()),
    *_BOX, ("conf", T.DoubleType()), ("cls", T.StringType()),
)

OBSERVATIONS = _struct(
    *_KEY, ("frame", T.LongType()), ("ts", T.TimestampType()), ("track_id", T.LongType()),
    *_BOX, ("cls", T.StringType()),
)

RUNS = _struct(
    *_KEY, ("frame_width", T.IntegerType()), ("frame_height", T.IntegerType()),
    ("fps", T.DoubleType()), ("total_frames", T.LongType()),
)

FRAMES = _struct(*_KEY, ("frame", T.LongType()), ("image", T.BinaryType()))

TRACKED = _struct(
    *_KEY, ("frame", T.LongType()), ("track_id", T.LongType()), *_BOX, ("cls", T.StringType()),
)

RAW_BOXES = _struct(
    *_KEY, ("frame", T.LongType()), ("det_idx", T.IntegerType()), *_BOX,
    ("conf", T.DoubleType()), ("cls", T.StringType()),
)

POINT = T.ArrayType(T.IntegerType())
RING = T.ArrayType(POINT)

SAMPLE_CONSTRAINTS = _struct(
    ("min_width", T.IntegerType()), ("max_width", T.IntegerType()),
    ("min_height", T.IntegerType()), ("max_height", T.IntegerType()),
    ("min_area", T.IntegerType()), ("max_area", T.IntegerType()),
    ("min_aspect", T.DoubleType()), ("max_aspect", T.DoubleType()),
)

# One JSON document per site. Rings come as maps (name -> points) when order does not matter and
# as arrays of {name, points} when the producer wants a match priority.
NAMED_RING = _struct(("name", T.StringType()), ("points", RING))
SITE_CONFIG = _struct(
    ("site_id", T.StringType()),
    ("counting_mode", T.StringType()),
    ("zones", T.MapType(T.StringType(), RING)),
    ("zone_order", T.ArrayType(T.StringType())),
    ("exclusion_zones", T.MapType(T.StringType(), RING)),
    ("lines", T.ArrayType(_struct(
        ("name", T.StringType()), ("points", RING), ("tolerance", T.IntegerType())))),
    ("directions", T.MapType(T.StringType(), RING)),
    ("settings", _struct(
        ("conf_threshold", T.DoubleType()), ("imgsz", T.IntegerType()),
        ("min_area", T.IntegerType()), ("max_area", T.IntegerType()),
        ("sample_constraints", SAMPLE_CONSTRAINTS), ("sample_count", T.IntegerType()),
        ("conf_per_class", T.MapType(T.StringType(), T.DoubleType())),
        ("min_origin_frames", T.IntegerType()), ("min_dest_frames", T.IntegerType()),
        ("min_crossing_frames", T.IntegerType()))),
    ("sahi", _struct(
        ("slice_width", T.IntegerType()), ("slice_height", T.IntegerType()),
        ("overlap_ratio", T.DoubleType()), ("nms_threshold", T.DoubleType()))),
    ("tracker", _struct(
        ("max_age", T.IntegerType()), ("min_hits", T.IntegerType()),
        ("iou_threshold", T.DoubleType()))),
    ("video_path", T.StringType()),
    ("model_path", T.StringType()),
)
