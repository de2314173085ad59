import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from flowlattice.operators import lives, routes, shape, site_rules, tiles, zones
from flowlattice.plans import summary
from flowlattice.sources import detections, run_files, sinks, site

CONFIG = {
    "counting_mode": "zones",
    "zones": {"Quay": [[3, 5], [128, 2], [131, 117], [6, 111]], "Mill": [[291, 4], [427, 7], [433, 121], [288, 116]]},
    "zone_order": ["Mill", "Quay"],
    "exclusion_zones": {"park": [[0, 0], [5, 0], [5, 5]]},
    "lines": [{"name": "L1", "points": [[0, 1], [2, 3]], "tolerance": 20}, {"points": [[0, 0], [9, 9]]},
              {"name": "bad", "points": [[1, 1]]}],
    "directions": {"Este": [[0, 100], [200, 100]]},
    "settings": {"conf_threshold": 0.25, "conf_per_class": {"bus": 0.4}, "sample_constraints": {"min_width": 7}},
    "tracker": {"max_age": 12},
}


@pytest.fixture
def sites(spark, tmp_path):
    (tmp_path / "cruce.json").write_text(json.dumps(CONFIG))
    (tmp_path / "vacio.json").write_text("{}")
    return site.read_sites(spark, str(tmp_path))


def test_site_tables(sites):
    assert [(r.zone_order, r.zone) for r in sites.zones.orderBy("zone_order").collect()] == [(0, "Mill"), (1, "Quay")]
    assert sites.exclusion.first().zone == "park"
    assert [(r.line_order, r.line, r.lx2, r.tolerance) for r in sites.lines.orderBy("line_order").collect()] == [
        (0, "L1", 2, 20), (1, "Linea 2", 9, 15)]
    assert tuple(sites.directions.select("direction", "dx", "dy").first()) == ("Este", 200, 0)
    settings = {r.site_id: r for r in sites.settings.collect()}
    assert settings["vacio"].mode == "zones" and settings["vacio"].conf_threshold == 0.10
    full = settings["cruce"]
    assert (full.conf_threshold, full.conf_per_class, full.min_width, full.max_age, full.min_hits, full.slice_width) == (
        0.25, {"bus": 0.4}, 7, 12, 3, 512)


def test_zone_table_places_points(spark, sites):
    points = spark.createDataFrame([("cruce", 50, 50), ("cruce", 350, 50), ("vacio", 50, 50)], "site_id string, cx int, cy int")
    found = zones.zone_of_point(points, sites.zones, by=("site_id",)).collect()
    assert {(r.site_id, r.cx, r.zone) for r in found} == {("cruce", 50, "Quay"), ("cruce", 350, "Mill"), ("vacio", 50, None)}


def test_violations(spark, sites, tmp_path):
    rules = {(r.site_id, r.rule, r.subject) for r in site_rules.site_violations(sites.raw).collect()}
    assert rules == {("vacio", "fewer_than_2_zones", None), ("cruce", "line_with_fewer_than_2_points", "bad")}
    (tmp_path / "malo.json").write_text(json.dumps({"zones": {"Z": [[1, 1], [2]]}, "settings": {"imgsz": 100}, "directions": {"d": [[0, 0]]}}))
    bad = site.read_sites(spark, str(tmp_path / "malo.json"))
    found = {(r.rule, r.subject) for r in site_rules.site_violations(bad.raw).collect()}
    assert found == {("fewer_than_2_zones", None), ("imgsz_below_320", None), ("zone_with_fewer_than_3_points", "Z"),
                     ("point_without_two_coordinates", "Z"), ("direction_with_fewer_than_2_points", "d")}
    assert bad.directions.count() == 0 and bad.zones.count() == 1


def read_csv(path):
    rows = []
    for name in sorted(glob.glob(f"{path}/*.csv")):
        with open(name, encoding="utf-8") as f:
            part = list(csv.reader(f))
            rows += part if not rows else part[1:]
    return rows


def test_sinks(spark, observe, tmp_path):
    zone_map = {"A": [(0, 0), (100, 0), (100, 100), (0, 100)], "B": [(300, 0), (400, 0), (400, 100), (300, 100)]}
    walk = [(1, 50, 50), (2, 50, 50), (3, 200, 50), (4, 350, 50), (5, 350, 50)]
    back = [(f, 400 - cx, cy) for f, cx, cy in walk]
    lived = lives.with_lives(zones.zone_of_point(observe({1: walk, 2: walk, 3: back}, half=5), zone_map))
    states = routes.zone_routes(lived, list(zone_map), 2, 2)
    done = routes.completed(states)
    sinks.write_routes_csv(done, str(tmp_path / "routes"))
    assert read_csv(tmp_path / "routes") == [["ruta", "conteo", "porcentaje"], ["A → B", "2", "66.7"], ["B → A", "1", "33.3"]]
    assert sinks.write_od_csv(done, str(tmp_path / "od"))
    assert read_csv(tmp_path / "od") == [["origen\\destino", "A", "B"], ["A", "0", "2"], ["B", "1", "0"]]
    assert not sinks.write_od_csv(done.filter("cnt < 0") if "cnt" in done.columns else done.filter("false"), str(tmp_path / "none"))
    report = shape.track_report(lived, lives.track_lives(lived), shape.zone_states(states))
    assert sinks.write_tracks_csv(report, str(tmp_path / "tracks"))
    rows = read_csv(tmp_path / "tracks")
    assert rows[0] == list(sinks.TRACK_COLUMNS)
    assert [r[0] for r in rows[1:]] == ["1", "2", "3"]
    assert rows[1][2:11] == ["done", "A", "", "50", "50", "350", "50", "5", "5"]
    runs = spark.createDataFrame([("r", 0, 125)], "run_id string, camera_id bigint, total_frames bigint")
    sinks.write_run_summary(summary.run_summary(lived, done, runs), str(tmp_path / "run"), {"tracker": "sort", "fps_avg": 12.3456})
    record = spark.read.json(str(tmp_path / "run")).first()
    assert (record.total_vehicles_tracked, record.total_routes_completed, record.fps_avg, record.tracker) == (3, 3, 12.35, "sort")
    assert record.routes["A → B"] == 2
    progress = summary.with_clock(summary.progress_samples(done, runs), 25.0)
    sinks.write_progress(progress, str(tmp_path / "progress"))
    saved = spark.read.parquet(str(tmp_path / "progress")).orderBy("frame").collect()
    assert [(r.frame, r.routes, r.eta_text) for r in saved] == [(60, 3, "2s"), (120, 3, "0s")]


def test_detection_sources(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, 1, None, 0, 1, 2, 3, 4, 0.5, "motorcycle")], detections.DETECTIONS)
    for fmt in ("parquet", "json", "csv"):
        rows.write.format(fmt).save(str(tmp_path / fmt))
        back = detections.read_detections(spark, str(tmp_path / fmt), fmt, aliases={"motorcycle": "motorbike"}).first()
        assert (back.camera_id, back.x2, back.conf, back.cls) == (1, 3, 0.5, "motorbike")
    runs = spark.sql("SELECT 'r' AS run_id, 1L AS camera_id, TIMESTAMP '2024-01-01 00:00:00' AS started, 25.0D AS fps")
    late = detections.with_event_time(rows.withColumn("frame", F.lit(26).cast("bigint")).drop("ts"), runs)
    assert late.first().ts.second == 1
    assert detections.every_kth_frame(spark.range(1, 20).toDF("frame"), 5).count() == 4


def test_tile_numbers(spark):
    assert tiles.tile_step(512, 0.2) == 409
    assert tiles.tile_count(1920, 512, 0.2) == 5 and tiles.tile_count(400, 512, 0.2) == 1
    frames = spark.createDataFrame([(1000, 600)], "frame_width int, frame_height int")
    grid = tiles.tile_grid(frames, 512, 512, 0.2).collect()
    assert len(grid) == 3 * 2
    assert max((t.tx2, t.ty2) for t in grid) == (1000, 600)


def test_run_files_are_whole_ordered_and_replaced(spark, tmp_path):
    runs = ["a", "b-c é/%x", None]
    rows = [(r, k, n, f"v{n},\"q\"" if n % 2 else None) for r in runs for k in (0, 1) for n in range(30)]
    frame = spark.createDataFrame(rows, "run_id string, camera_id bigint, n int, v string").repartition(5)
    path = str(tmp_path / "files")
    run_files.write_run_files(frame, path, (F.col("n").cast("int").desc(),))
    with open(f"{path}/{run_files.file_name('a', 1)}", encoding="utf-8") as f:
        lines = list(csv.reader(f))
    assert lines[0] == ["n", "v"] and [int(r[0]) for r in lines[1:]] == list(range(29, -1, -1)) and lines[1][1] == 'v29,"q"'
    back = run_files.read_run_files(spark, path, "n int, v string")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
    # A job that fails changes nothing; one that is done replaces its own runs.
    fails = F.when(F.col("n") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit("new"))
    with pytest.raises(Exception, match="broken"):
        run_files.write_run_files(frame.filter("run_id = 'a'").withColumn("v", fails), path, ("n",))
    assert sorted(p.name for p in (tmp_path / "files").iterdir() if p.is_file()) == sorted({run_files.file_name(r, k) for r in runs for k in (0, 1)})
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
    run_files.write_run_files(frame.filter("run_id = 'a' AND n < 3").withColumn("v", F.lit("new")), path, ("n",))
    got = run_files.read_run_files(spark, path, "n int, v string")
    assert got.filter("run_id = 'a'").count() == 6 and got.count() == 126
    run_files.write_run_files(frame.filter("false"), path, ("n",))
    assert got.count() == 126
