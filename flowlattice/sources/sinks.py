"""Result files. Every sink writes with Spark, into a folder of part files."""

from pyspark.sql import functions as F

from flowlattice.functions.labels import duration_text
from flowlattice.plans.summary import od_matrix, route_shares

# Headers of the result files.
ROUTES_HEADER = ("ruta", "conteo", "porcentaje")
OD_CORNER = "origen\\destino"
TRACK_COLUMNS = (
    "track_id", "class", "state", "origin", "direction", "first_x", "first_y", "last_x", "last_y",
    "trail_length", "last_seen_frame", "avg_width", "avg_height", "avg_area", "avg_aspect",
    "avg_elongation")


def _csv(df, path, mode):
    df.write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_run_summary(summary, path, facts=None, mode="errorifexists"):
    """One JSON record per run. `facts` adds constant fields such as the tracker's name.

    Number fields named in `facts` as floats are rounded to two decimals.
    """
    facts = {k: round(v, 2) if isinstance(v, float) else v for k, v in (facts or {}).items()}
    summary.withColumns({k: F.lit(v) for k, v in facts.items()}).write.mode(mode).json(path)


def write_routes_csv(events, path, key="route", with_run=False, mode="errorifexists"):
    """Route, count and percentage with one decimal, largest count first. Events of several runs need `with_run`."""
    first = ["run_id", "camera_id"] if with_run else []
    shares = route_shares(events, key).orderBy(*first, F.col("cnt").desc(), key)
    _csv(shares.select(*first, key, "cnt", F.format_string("%.1f", "share").alias("share")).toDF(
        *first, *ROUTES_HEADER), path, mode)


def write_tracks_csv(report, path, with_run=False, mode="errorifexists"):
    """The track report in id order. Returns False, and writes nothing, for an empty report."""
    if report.isEmpty():
        return False
    first = ["run_id", "camera_id"] if with_run else []
    _csv(report.select(*first, *TRACK_COLUMNS).orderBy(*first, "track_id"), path, mode)
    return True


def write_od_csv(events, path, zones=None, with_run=False, mode="errorifexists"):
    """The square origin-destination matrix, zones sorted; nothing without routes. Events of several runs need `with_run`."""
    if events.isEmpty():
        return False
    first = ["run_id", "camera_id"] if with_run else []
    matrix = od_matrix(events, zones).orderBy(*first, "origin").withColumnRenamed("origin", OD_CORNER)
    matrix = matrix.select(*first, OD_CORNER, *[c for c in matrix.columns if c not in ("run_id", "camera_id", OD_CORNER)])
    _csv(matrix, path, mode)
    return True


def write_progress(progress, path, fmt="parquet", mode="errorifexists"):
    """The progress table, with remaining time as text where it is known."""
    if "eta" in progress.columns:
        progress = progress.withColumn("eta_text", duration_text(F.col("eta")))
    progress.write.mode(mode).format(fmt).save(path)
