import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from flowlattice.session import local_session

    session = local_session(8, partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def observe(spark):
    """Observation rows from {track: [(frame, cx, cy), ...]}, with boxes of 2*half pixels."""
    def build(tracks, cls="car", half=0, camera=0):
        rows = []
        for track, points in tracks.items():
            kind = cls[track] if isinstance(cls, dict) else cls
            for frame, cx, cy in points:
                rows.append(("r", camera, track, frame, cx - half, cy - half, cx + half, cy + half,
                             cx, cy, kind))
        return spark.createDataFrame(
            rows, "run_id string, camera_id bigint, track_id bigint, frame bigint, x1 int, y1 int, "
                  "x2 int, y2 int, cx int, cy int, cls string")

    return build
