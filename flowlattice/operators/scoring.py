"""Running a user's detector over a table of frames."""

import pandas as pd

from flowlattice.operators.filters import filter_detections
from flowlattice.operators.overlaps import nms
from flowlattice.schemas import RAW_BOXES

_COLUMNS = RAW_BOXES.fieldNames()


def detect_frames(frames, infer, conf=0.10):
    """Raw boxes of `infer(image, conf) -> [{bbox, cls_name, conf}]` for every frame.

    Frames are (run_id, camera_id, frame, image). Scoring streams over each partition in Arrow
    batches, so a task never holds more than a batch; the partitioning of `frames` is kept.
    """
    def score(batches):
        for batch in batches:
            out = []
            for run_id, camera_id, frame, image in zip(
                    batch["run_id"], batch["camera_id"], batch["frame"], batch["image"]):
                for i, found in enumerate(infer(image, conf)):
                    out.append((run_id, camera_id, frame, i, *(int(v) for v in found["bbox"]),
                                float(found["conf"]), found["cls_name"]))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return frames.select("run_id", "camera_id", "frame", "image").mapInPandas(score, RAW_BOXES)


def detect_vehicles(frames, infer, conf_threshold=0.10, conf_per_class=None, limits=None,
                    exclusion=None, nms_threshold=0.0):
    """Detector, filters and, for tiled input, suppression of duplicates."""
    lowest = min([conf_threshold, *(conf_per_class or {}).values()])
    kept = filter_detections(detect_frames(frames, infer, lowest), conf_threshold, conf_per_class,
                             limits, exclusion)
    return nms(kept, nms_threshold)
