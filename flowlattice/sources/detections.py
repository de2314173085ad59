"""Detection and observation tables: batch and streaming scans, frame ranges."""

from pyspark.sql import functions as F

from flowlattice.functions.labels import aliased_class, class_name
from flowlattice.schemas import DETECTIONS, OBSERVATIONS


def _named(rows, aliases):
    return rows if not aliases else rows.withColumn("cls", aliased_class(F.col("cls"), aliases))


def read_detections(spark, path, fmt="parquet", schema=DETECTIONS, aliases=None, **options):
    """Detections from parquet, json or csv; the schema is never inferred.

    `aliases` renames class texts of models that spell a class differently.
    """
    reader = spark.read.format(fmt).schema(schema).options(**options)
    return _named(reader.load(path), aliases)


def read_observations(spark, path, fmt="parquet", schema=OBSERVATIONS, aliases=None, **options):
    return read_detections(spark, path, fmt, schema, aliases, **options)


def stream_detections(spark, path, fmt="parquet", schema=DETECTIONS, aliases=None, late="10 seconds",
                      **options):
    """The same as a stream with a watermark on `ts`."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return _named(reader.load(path), aliases).withWatermark("ts", late)


def with_class_names(dets, path="plain", class_id="class_id"):
    """Class names for tables that hold model class ids."""
    return dets.withColumn("cls", class_name(F.col(class_id), path))


def with_event_time(dets, runs):
    """Event time of every frame: start of the run plus (frame - 1) / fps.

    `runs` gives (run_id, camera_id, started, fps).
    """
    joined = dets.join(runs.select("run_id", "camera_id", "started", "fps"), ["run_id", "camera_id"])
    micros = ((F.col("frame") - 1) * F.lit(1000000.0) / F.col("fps")).cast("bigint")
    return joined.withColumn("ts", F.timestamp_micros(F.unix_micros("started") + micros)).drop(
        "started", "fps")


def first_frames(rows, n):
    return rows.filter(F.col("frame") <= n)


def every_kth_frame(rows, k=5):
    return rows.filter((F.col("frame") - 1) % k == 0)


def clamped_frame(index, total):
    """A requested frame index moved into 0 .. total-1."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(total - 1, index))
