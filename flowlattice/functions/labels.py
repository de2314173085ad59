"""Class names, confidences and text keys."""

from pyspark.sql import Column, functions as F

# Class names by model class id.
CLASS_NAMES = (
    "person", "bicycle", "car", "motorbike", "aeroplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat",
    "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella",
    "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite", "baseball bat",
    "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle", "wine glass", "cup",
    "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange", "broccoli",
    "carrot", "hot dog", "pizza", "donut", "cake", "chair", "sofa", "pottedplant", "bed",
    "diningtable", "toilet", "tvmonitor", "laptop", "mouse", "remote", "keyboard", "cell phone",
    "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors",
    "teddy bear", "hair drier", "toothbrush",
)
# The classes that count as vehicles, and their short labels by class id.
VEHICLES = ("car", "truck", "bus", "motorbike")
SHORT_LABELS = {2: "car", 3: "moto", 5: "bus", 7: "truck"}
# What an id beyond the list becomes on each input path.
UNKNOWN_CLASS = {"plain": "", "tracked": "car", "calibration": "?"}

ARROW = "→"
DOWN, UP = "↓", "↑"


def class_name(class_id, path="plain"):
    names = F.array(*(F.lit(n) for n in CLASS_NAMES))
    return F.coalesce(F.get(names, class_id.cast("int")), F.lit(UNKNOWN_CLASS[path]))


def short_label(class_id):
    pairs = [F.lit(v) for item in SHORT_LABELS.items() for v in item]
    return F.create_map(*pairs)[class_id.cast("int")]


def aliased_class(cls, aliases):
    """Rename model-specific spellings, e.g. {"motorcycle": "motorbike"}."""
    if not aliases:
        return cls
    pairs = [F.lit(v) for item in aliases.items() for v in item]
    return F.coalesce(F.create_map(*pairs)[cls], cls)


def confidence_floor(cls, threshold, per_class=None):
    """The threshold of a class, with the common one as fallback.

    `per_class` is a dict, or a MAP column when thresholds differ by camera.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if per_class is None or (isinstance(per_class, dict) and not per_class):
        return threshold
    if isinstance(per_class, dict):
        pairs = [F.lit(v) for k, t in per_class.items() for v in (k, float(t))]
        per_class = F.create_map(*pairs)
    return F.coalesce(per_class[cls], threshold)


def floor_confidence(conf):
    """Two decimals, rounded down."""
    return F.floor(conf * F.lit(100.0)) / F.lit(100.0)


def route_key(origin, destination):
    return F.concat_ws(f" {ARROW} ", origin, destination)


def crossing_key(line, direction):
    return F.concat_ws(" ", line, direction)


def route_origin(key):
    return F.trim(F.split(key, ARROW)[0])


def duration_text(seconds):
    """`1h 2m 3s`, `2m 3s` or `3s`."""
    total = seconds.cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))
    return (
        F.when(h != 0, F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s")))
        .when(m != 0, F.concat(m, F.lit("m "), s, F.lit("s")))
        .otherwise(F.concat(s, F.lit("s")))
    )
