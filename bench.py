"""Times the headline queries and prints one JSON line.

`BENCH_SF_DIR` (default /root/testdata/sf0.1) is the input, `BENCH_CPUS` (default 8) the cores. The
input tables derived from `events` are written first, outside the timings, as a user's detection
tables would be on disk. Every query is run to completion on all its columns. One untimed round over
the smallest scale factor first gets class loading and compilation out of the way (`BENCH_WARM=0` skips it).
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowlattice.plans import catalog, views  # noqa: E402
from flowlattice.session import local_session  # noqa: E402

HEADLINE = (
    "filter_detections", "nms_iou", "iou_pairs", "attach_class_best_iou", "zone_of_point", "track_lives",
    "zone_routes", "od_by_class", "od_matrix", "line_crossings_settled", "headings", "shape_ema", "trails",
    "track_report", "heat_grid", "heat_smooth", "area_bounds", "rolling_rate", "route_shares", "flow_per_window",
    "track_detections",
)


def run(spark, name, folder):
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(folder).parent / "sf0.001"
    if os.environ.get("BENCH_WARM", "1") != "0" and small.is_dir():
        for name in names:
            run(spark, name, str(small))
    started = time.perf_counter()
    views.observations_path(spark, folder)
    views.detections_path(spark, folder)
    views.total_frames(spark, folder)
    views.total_frames(spark, folder, "detections")
    prepared = time.perf_counter() - started
    seconds = {}
    for name in names:
        started = time.perf_counter()
        run(spark, name, folder)
        seconds[name] = round(time.perf_counter() - started, 3)
    rows = views.table(spark, folder, "events").count()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "traffic-flow queries, total wall time", "value": total, "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "input_rows": rows,
        "rows_per_sec": {n: int(rows / s) for n, s in seconds.items()}, "prepare_sec": round(prepared, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
