"""Track lives: a track id that comes back after the purge is a new vehicle.

Tracks unseen for more than `limit` frames are dropped at every multiple of `every` frames. An
observation at frame c opens a new life when the last purge before c already dropped the id.
"""

from pyspark.sql import functions as F

from flowlattice.operators.ordered import SPAN_BITS, fits
from flowlattice.schemas import LIFE, RUN_CAMERA, TRACK

EVERY, LIMIT = 120, 200


def with_lives(obs, first=(), prev=(), every=EVERY, limit=LIMIT, bits=SPAN_BITS, total_frames=None):
    """Adds `life` (1, 2, ...), `obs_no` inside the life, `new_life` and `prev_frame`.

    `first` columns come back as `first_<c>` (value at the start of the life), `prev` columns as
    `prev_<c>` (previous observation of the track, of any life).

    A track is cut into spans of 2^bits frames and windows run inside a span. What a span takes over
    from earlier ones (last row, rows and lives so far, start of the open life) comes from one row
    per span. One shuffle carries everything; the side pass reads only the columns it needs, and is
    not planned at all when `total_frames`, the longest run, fits a span.
    """
    key = ", ".join(TRACK)
    bounded = fits(total_frames, bits)
    part = key if bounded else f"{key}, _span"
    kept = list(dict.fromkeys([*first, *prev]))
    also = "".join(f", {c}" for c in kept)

    def purged(last, frame):
        return f"floor(({frame} - 1) / {float(every)}) * {every} - {last} > {limit}"

    def counted(p):
        # A point of a span, counted from the first row of the track.
        return f"named_struct('frame', {p}.frame, 'n', {p}.n + rows_before" + "".join(
            f", '{c}', {p}.{c}" for c in kept) + ")"

    def local(columns):
        return f"""
          SELECT *, coalesce({purged("_prev.frame", "frame")}, false) AS _cut
          FROM (SELECT *, lag(struct(frame{also})) OVER w AS _prev,
                       CAST(row_number() OVER w AS BIGINT) AS _n
                FROM (SELECT {columns}, shiftright(frame, {bits}) AS _span FROM {{obs}})
                WINDOW w AS (PARTITION BY {part} ORDER BY frame))"""

    out = f"""
      SELECT {", ".join(obs.columns)}, _opened + _lives AS life, _rn - _start.n + 1 AS obs_no,
             new_life, _before.frame AS prev_frame
             {"".join(f", _start.{c} AS first_{c}" for c in first)}
             {"".join(f", _before.{c} AS prev_{c}" for c in prev)}
      FROM opened"""
    if bounded:
        return obs.sparkSession.sql(f"""
          WITH flagged AS (
            SELECT *, _n = 1 OR _cut AS new_life, _prev AS _before, _n AS _rn, 0L AS _lives
            FROM ({local("*")})),
          opened AS (
            SELECT *, sum(CAST(new_life AS BIGINT)) OVER w AS _opened,
                   last(CASE WHEN new_life THEN struct(frame, _rn AS n{also}) END, true) OVER w AS _start
            FROM flagged WINDOW w AS (PARTITION BY {part} ORDER BY frame
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
          {out}""", obs=obs)
    return obs.sparkSession.sql(f"""
      WITH ends AS (
        SELECT {key}, _span, min(struct(frame, _n AS n{also})) AS head,
               max(struct(frame{also})) AS tail, max(_n) AS n_rows, sum(CAST(_cut AS BIGINT)) AS cuts,
               max(CASE WHEN _cut THEN struct(frame, _n AS n{also}) END) AS last_cut
        FROM ({local(", ".join([*TRACK, "frame", *kept]))})
        GROUP BY {key}, _span),
      linked AS (
        SELECT *, prev_tail IS NULL OR {purged("prev_tail.frame", "head.frame")} AS opens
        FROM (SELECT *, lag(tail) OVER w AS prev_tail, -n_rows + sum(n_rows) OVER w AS rows_before
              FROM ends WINDOW w AS (PARTITION BY {key} ORDER BY _span))),
      started AS (
        SELECT *, CASE WHEN last_cut IS NOT NULL THEN {counted("last_cut")}
                       WHEN opens THEN {counted("head")} END AS start
        FROM linked),
      carry AS (
        SELECT * FROM (
          SELECT {key}, _span, prev_tail, rows_before, opens,
                 max(start) OVER w AS open_start,
                 sum(cuts + CAST(opens AS BIGINT)) OVER w AS lives_before
          FROM started WINDOW w AS (PARTITION BY {key} ORDER BY _span
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WHERE prev_tail IS NOT NULL),
      flagged AS (
        SELECT r.*, CASE WHEN r._n = 1 THEN coalesce(c.opens, true) ELSE r._cut END AS new_life,
               coalesce(r._prev, c.prev_tail) AS _before, c.open_start,
               r._n + coalesce(c.rows_before, 0) AS _rn, coalesce(c.lives_before, 0) AS _lives
        FROM ({local("*")}) r LEFT JOIN carry c USING ({key}, _span)),
      opened AS (
        SELECT *, sum(CAST(new_life AS BIGINT)) OVER w AS _opened, coalesce(
                 last(CASE WHEN new_life THEN struct(frame, _rn AS n{also}) END, true) OVER w,
                 open_start) AS _start
        FROM flagged WINDOW w AS (PARTITION BY {key}, _span ORDER BY frame
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      {out}""", obs=obs)


def last_frames(obs):
    """Last frame of every run and camera."""
    return obs.groupBy(*RUN_CAMERA).agg(F.max("frame").alias("last_frame_of_run"))


def track_lives(lived, ends=None, every=EVERY, limit=LIMIT):
    """One row per life: extent, size and whether it is still held when the run ends.

    `ends` gives (run_id, camera_id, last_frame_of_run) where frames without boxes follow the
    last observation; without it the last observed frame counts as the end.
    """
    ends = last_frames(lived) if ends is None else ends
    lives = lived.groupBy(*LIFE).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.count(F.lit(1)).alias("n_obs"))
    last_purge = F.floor(F.col("last_frame_of_run") / F.lit(float(every))) * every
    return (
        lives.join(ends, list(RUN_CAMERA), "left")
        .withColumn("survives", last_purge - F.col("last_frame") <= limit)
        .drop("last_frame_of_run")
    )
