"""Replaying a finished table as a stream, slice by slice."""

import uuid

from pyspark.sql import functions as F

from flowlattice.session import shared_dir
from flowlattice.streaming.flows import start


# A stream starts with its watermark at the epoch, where rows would already be late.
RUN_START_SECONDS = 1704067200


def with_frame_time(obs, fps, started=RUN_START_SECONDS):
    """Event time of a frame: start of the run plus (frame - 1) / fps."""
    micros = F.lit(started * 1000000) + ((F.col("frame") - 1) * F.lit(1000000.0 / fps)).cast("bigint")
    return obs.withColumn("ts", F.timestamp_micros(micros))


def heartbeat(timed, seconds=3600):
    """One row without a track, so long after the last one that every frame before it is released."""
    after = (F.max("ts") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("ts")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in timed.schema if f.name != "ts"]
    return timed.agg(after).select(*others, "ts").select(*timed.columns)


def replay(obs, build, fps, slices=3, late="10 seconds", delay_frames=0, read=None, deliver=start):
    """Events of `build(stream)` when `obs` arrives as `slices` batches, and then a heartbeat.

    A row arrives up to `delay_frames` frames after its own frame, by a hash of the row, so slices overlap by so much. Every slice is
    appended to one folder and consumed by one run of the query, so state is carried across restarts through the checkpoint.
    Returns the events written so far as a table, or what `read(folder)` makes of them.
    """
    spark = obs.sparkSession
    home = f"{shared_dir(spark)}/replay/{uuid.uuid4().hex}"
    timed = with_frame_time(obs, fps)
    arrives = F.col("frame") + F.pmod(F.xxhash64(*timed.columns), F.lit(delay_frames + 1))
    cuts = timed.select(arrives.alias("_at")).approxQuantile("_at", [i / slices for i in range(1, slices)], 0.01)
    edges = [None, *cuts, None]
    parts = [timed.filter((F.lit(True) if low is None else arrives > low) & (F.lit(True) if high is None else arrives <= high))
             for low, high in zip(edges, edges[1:])]
    for part in [*parts, heartbeat(timed)]:
        part.write.mode("append").parquet(f"{home}/input")
        stream = spark.readStream.schema(timed.schema).parquet(f"{home}/input").withWatermark("ts", late)
        events = build(stream)
        deliver(events, f"{home}/events", f"{home}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{home}/events") if read is None else read(f"{home}/events")
