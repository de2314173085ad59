"""The queries' meaning in plain SQL, for an independent engine."""

CLASS = """CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'truck' WHEN 'purchase' THEN 'bus'
  WHEN 'signup' THEN 'motorbike' ELSE 'person' END"""
CONF = "0.05 + ((event_id * 7919) % 90) / CAST(100 AS DOUBLE)"

OBS = f"""obs0 AS (
 SELECT CASE WHEN user_id % 8 < 4 THEN 'am' ELSE 'pm' END AS run_id,
  CAST(user_id % 4 AS BIGINT) AS camera_id, user_id AS track_id, event_id, ts,
  rn + CASE WHEN user_id % 5 = 0 AND rn > 30 THEN 330 ELSE 0 END AS frame,
  CAST(CASE WHEN user_id % 3 = 0 THEN 10 + rn*10 WHEN user_id % 3 = 1 THEN 690 - rn*10
       ELSE 100 + (user_id % 6)*80 END AS INTEGER) AS cx,
  CAST(CASE WHEN user_id % 3 = 2 THEN 10 + rn*7
       ELSE 40 + (user_id % 8)*50 + event_id % 5 END AS INTEGER) AS cy,
  CAST(16 + (user_id % 5)*8 AS INTEGER) AS w, CAST(12 + (user_id % 4)*6 + event_id % 3 AS INTEGER) AS h,
  {CONF} AS conf, {CLASS} AS cls
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS rn
       FROM events) e),
obs AS (SELECT run_id, camera_id, track_id, frame, event_id, ts,
  CAST(cx - floor(w/2.0) AS INTEGER) AS x1, CAST(cy - floor(h/2.0) AS INTEGER) AS y1,
  CAST(cx - floor(w/2.0) + w AS INTEGER) AS x2, CAST(cy - floor(h/2.0) + h AS INTEGER) AS y2,
  cx, cy, conf, cls FROM obs0)"""

DET = f"""det AS (
 SELECT 'am' AS run_id, CAST(CAST(floor((floor(event_id/8.0)+1)/64) AS BIGINT) % 4 AS BIGINT) AS camera_id,
  CAST(floor(event_id / 8.0) AS BIGINT) + 1 AS frame, CAST(event_id % 8 AS INTEGER) AS det_idx,
  CAST((event_id % 3) * 70 + (event_id * 53) % 31 AS INTEGER) AS x1,
  CAST((event_id * 29) % 23 AS INTEGER) AS y1,
  CAST((event_id % 3) * 70 + (event_id * 53) % 31 + 60 + event_id % 7 AS INTEGER) AS x2,
  CAST((event_id * 29) % 23 + 50 + event_id % 5 AS INTEGER) AS y2,
  {CONF} AS conf, {CLASS} AS cls
 FROM events)"""

# The filters, zones and lives of the flow queries.
FLT = OBS + """,
flt AS (SELECT * FROM obs
 WHERE cls IN ('car','truck','bus','motorbike')
  AND conf >= CASE cls WHEN 'truck' THEN 0.15 WHEN 'bus' THEN 0.2 ELSE 0.1 END
  AND (x2-x1)*(y2-y1) >= 200 AND (x2-x1) <= 60
  AND NOT ((x1+x2)/2.0 BETWEEN 320 AND 360 AND (y1+y2)/2.0 BETWEEN 100 AND 130))"""
ZONED = """zoned AS (SELECT *, CASE WHEN cx BETWEEN 0 AND 120 AND cy BETWEEN 0 AND 520 THEN 'W'
  WHEN cx BETWEEN 560 AND 700 AND cy BETWEEN 0 AND 520 THEN 'E'
  WHEN cx BETWEEN 0 AND 700 AND cy BETWEEN 0 AND 90 THEN 'N'
  WHEN cx BETWEEN 0 AND 700 AND cy BETWEEN 400 AND 520 THEN 'S' END AS zone FROM flt)"""


def lived(zoned):
    return FLT + ",\n" + zoned + """,
cut AS (SELECT *, lag(frame) OVER t AS pf, lag(cx) OVER t AS pcx, lag(cy) OVER t AS pcy
  FROM zoned WINDOW t AS (PARTITION BY run_id, camera_id, track_id ORDER BY frame)),
cut2 AS (SELECT *, CASE WHEN pf IS NULL THEN 1
   WHEN floor((frame-1)/120.0)*120 - pf > 200 THEN 1 ELSE 0 END AS opens FROM cut),
cut3 AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY run_id, camera_id, track_id ORDER BY frame) AS BIGINT) AS life
  FROM cut2),
lived AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, camera_id, track_id, life ORDER BY frame) AS BIGINT)
  AS obs_no FROM cut3)"""


_LIFE_SUM = """,
lives AS (SELECT run_id, camera_id, track_id, life, min(frame) AS first_frame, max(frame) AS last_frame,
  count(*) AS n_obs, arg_min(cls, frame) AS first_cls FROM lived GROUP BY ALL),
ends AS (SELECT run_id, camera_id, max(frame) AS f FROM obs GROUP BY ALL)"""
LIVED = lived(ZONED)
LIFE_SUM = LIVED + _LIFE_SUM

# Zones and thresholds that differ from camera to camera: camera 3 has two zones only.
ZONED_BY_SITE = """zoned AS (SELECT *, CASE WHEN cx BETWEEN 0 AND 120 + 20 * camera_id AND cy BETWEEN 0 AND 520 THEN 'W'
  WHEN cx BETWEEN 560 - 10 * camera_id AND 700 AND cy BETWEEN 0 AND 520 THEN 'E'
  WHEN camera_id < 3 AND cx BETWEEN 0 AND 700 AND cy BETWEEN 0 AND 90 + 5 * camera_id THEN 'N'
  WHEN camera_id < 3 AND cx BETWEEN 0 AND 700 AND cy BETWEEN 400 - 10 * camera_id AND 520 THEN 'S' END AS zone FROM flt)"""
BY_SITE = lived(ZONED_BY_SITE)


def routes_cte(min_origin=3, min_dest=3, immediate=False, lives=None):
    """A plain step-by-step run of the route machine; thresholds may be expressions over `s`."""
    to_other = ("'done'" if immediate else "'transit'")
    return (lives or LIVED) + _LIFE_SUM + f""",
run(run_id, camera_id, track_id, life, n, st, o, zf, d, df, done_at) AS (
 SELECT run_id, camera_id, track_id, life, obs_no, CASE WHEN zone IS NULL THEN 'new' ELSE 'origin' END,
   zone, CASE WHEN zone IS NULL THEN 0 ELSE 1 END, CAST(NULL AS VARCHAR), 0, CAST(NULL AS BIGINT)
 FROM lived WHERE obs_no = 1
 UNION ALL
 SELECT s.run_id, s.camera_id, s.track_id, s.life, l.obs_no,
  CASE WHEN s.st = 'done' THEN 'done'
   WHEN s.st = 'new' THEN CASE WHEN l.zone IS NULL THEN 'new' ELSE 'origin' END
   WHEN s.st = 'origin' THEN CASE WHEN l.zone = s.o THEN 'origin'
      WHEN l.zone IS NULL THEN CASE WHEN s.zf >= {min_origin} THEN 'transit' ELSE 'new' END
      WHEN s.zf >= {min_origin} THEN {to_other} ELSE 'origin' END
   ELSE CASE WHEN l.zone IS NOT NULL AND l.zone <> s.o AND l.zone = s.d AND s.df + 1 >= {min_dest}
      THEN 'done' ELSE 'transit' END END,
  CASE WHEN s.st = 'new' THEN l.zone
   WHEN s.st = 'origin' AND l.zone IS NULL AND s.zf < {min_origin} THEN NULL ELSE s.o END,
  CASE WHEN s.st = 'new' THEN CASE WHEN l.zone IS NULL THEN 0 ELSE 1 END
   WHEN s.st = 'origin' AND l.zone = s.o THEN s.zf + 1
   WHEN s.st = 'origin' AND l.zone IS NULL AND s.zf < {min_origin} THEN 0 ELSE s.zf END,
  CASE WHEN s.st = 'done' THEN s.d
   WHEN s.st = 'origin' AND l.zone IS NOT NULL AND l.zone <> s.o AND s.zf >= {min_origin} THEN l.zone
   WHEN s.st = 'transit' AND l.zone IS NOT NULL AND l.zone <> s.o THEN l.zone END,
  CASE WHEN s.st = 'done' THEN s.df
   WHEN s.st = 'origin' AND l.zone IS NOT NULL AND l.zone <> s.o AND s.zf >= {min_origin} THEN 1
   WHEN s.st = 'transit' AND l.zone IS NOT NULL AND l.zone <> s.o THEN
     CASE WHEN l.zone = s.d THEN s.df + 1 ELSE 1 END ELSE 0 END,
  CASE WHEN s.st = 'done' THEN s.done_at
   WHEN s.st = 'transit' AND l.zone <> s.o AND l.zone = s.d AND s.df + 1 >= {min_dest} THEN l.frame
   WHEN {'TRUE' if immediate else 'FALSE'} AND s.st = 'origin' AND l.zone <> s.o AND s.zf >= {min_origin} THEN l.frame
   END
 FROM run s JOIN lived l ON l.run_id = s.run_id AND l.camera_id = s.camera_id
   AND l.track_id = s.track_id AND l.life = s.life AND l.obs_no = s.n + 1),
states AS (SELECT r.run_id, r.camera_id, r.track_id, r.life, r.st AS state, r.o AS origin,
   CASE WHEN r.st = 'done' THEN r.d END AS destination, v.first_cls AS cls, r.done_at AS frame, v.last_frame
  FROM run r JOIN lives v ON r.run_id = v.run_id AND r.camera_id = v.camera_id
   AND r.track_id = v.track_id AND r.life = v.life AND r.n = v.n_obs),
routes AS (SELECT run_id, camera_id, track_id, life, origin, destination, cls, frame,
   origin || ' → ' || destination AS route FROM states WHERE state = 'done')"""


def q(ctes, body):
    recursive = "RECURSIVE " if "run(run_id" in ctes or "walk(" in ctes else ""
    return f"WITH {recursive}{ctes}\n{body}"
