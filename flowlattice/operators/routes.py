"""Origin-destination routes between zones.

Each life runs a small state machine over its zone sequence: a new track takes the first zone it
is seen in as origin, keeps it once it was seen there `min_origin` times, and completes the route
when it stays `min_dest` observations in a row (never fewer than two) in another zone.

A machine with finitely many states is a function from entry state to exit state, and such
functions compose. So a life is cut into chunks of frames; a chunk that opens its life is run once,
a later chunk is run from every possible entry state, and chunks are composed in two bounded
levels. Almost every life is one chunk and costs one run; a life of any length spreads over tasks
and no task ever holds more than a chunk of it.
"""

from pyspark.sql import DataFrame, functions as F

from flowlattice.functions.labels import route_key
from flowlattice.operators.ordered import fits
from flowlattice.schemas import LIFE

CHUNK_BITS, SPAN_BITS = 12, 22
NEW, ORIGIN, TRANSIT, DONE = 0, 1, 2, 3
STATE_NAMES = ("new", "origin", "transit", "done")
_STATE = "struct<st:int,o:int,zf:int,d:int,df:int,at:bigint>"


def _state(st, o=-1, zf=0, d=-1, df=0, at="NULL"):
    fields = zip(("st", "o", "zf", "d", "df"), (st, o, zf, d, df))
    return "named_struct(" + ", ".join(
        f"'{n}', CAST({v} AS INT)" for n, v in fields) + f", 'at', CAST({at} AS BIGINT))"


def _step(min_origin, min_dest, direct):
    """State `s` after the observation `r` (r.z: zone order, -1 outside)."""
    if direct == "immediate":
        enters_other = _state(DONE, "s.o", min_origin, "r.z", 1, "r.frame")
    else:
        enters_other = _state(TRANSIT, "s.o", min_origin, "r.z", 1)
    arrived = _state(DONE, "s.o", min_origin, "r.z", "s.df + 1", "r.frame")
    return f"""CASE
      WHEN s.st = {DONE} THEN s
      WHEN s.st = {NEW} THEN IF(r.z < 0, s, {_state(ORIGIN, "r.z", 1)})
      WHEN s.st = {ORIGIN} AND r.z = s.o THEN {_state(ORIGIN, "s.o", f"least(s.zf + 1, {min_origin})")}
      WHEN s.st = {ORIGIN} AND s.zf >= {min_origin} THEN
        IF(r.z < 0, {_state(TRANSIT, "s.o", min_origin)}, {enters_other})
      WHEN s.st = {ORIGIN} THEN IF(r.z < 0, {_state(NEW)}, s)
      WHEN r.z < 0 OR r.z = s.o THEN {_state(TRANSIT, "s.o", min_origin)}
      WHEN r.z <> s.d THEN {_state(TRANSIT, "s.o", min_origin, "r.z", 1)}
      WHEN s.df + 1 >= {min_dest} THEN {arrived}
      ELSE {_state(TRANSIT, "s.o", min_origin, "r.z", "s.df + 1")} END"""


def _entry_states(n_zones, min_origin, min_dest):
    """Every state a chunk can be entered in except `done`, ordered as `_entry_index` counts.

    The numbers may be columns: a row has as many entry states as its site's zones and thresholds ask for.
    """
    zones = f"slice(sequence(0, {n_zones}), 1, {n_zones})"
    held = (f"flatten(transform({zones}, o -> transform(sequence(1, {min_origin}), "
            f"k -> {_state(ORIGIN, 'o', 'k')})))")
    toward = (f"flatten(transform({zones}, d -> transform(sequence(1, {min_dest} - 1), "
              f"k -> {_state(TRANSIT, 'o', min_origin, 'd', 'k')})))")
    bound = (f"flatten(transform({zones}, o -> "
             f"concat(array({_state(TRANSIT, 'o', min_origin)}), {toward})))")
    return f"concat(array({_state(NEW)}), {held}, {bound})"


def _entry_index(n_zones, min_origin, min_dest):
    transit = f"1 + {n_zones} * {min_origin} + s.o * (1 + {n_zones} * ({min_dest} - 1))"
    return f"""CASE WHEN s.st = {NEW} THEN 0
      WHEN s.st = {ORIGIN} THEN s.o * {min_origin} + s.zf
      WHEN s.d < 0 THEN {transit}
      ELSE {transit} + 1 + s.d * ({min_dest} - 1) + s.df - 1 END"""


def zone_routes(lived, zone_names, min_origin=3, min_dest=3, direct="confirm",
                chunk_bits=CHUNK_BITS, span_bits=SPAN_BITS, total_frames=None):
    """One row per life: state, origin, destination, class at first sight and route frame.

    `lived` needs the life, `frame`, `zone_order` (null outside every zone) and `cls`.
    `zone_names` lists the zones by order, or is a table of cameras (run_id, camera_id, zone_names, min_origin, min_dest) where every
    site has its own; it meets the groups of a life and not its rows, and a camera without a row has no zones.
    `direct="immediate"` completes a route at once when a settled track steps from its origin straight into another zone.
    `total_frames`, the longest run, saves the levels of composition it makes needless.

    Runs of rows outside every zone act like their first row. Where `lived` has `prev_zone_order`,
    only that row enters the machine.
    """
    key = ", ".join(LIFE)
    cameras = zone_names if isinstance(zone_names, DataFrame) else None
    if cameras is None:
        min_origin, min_dest, n_zones = max(1, min_origin), max(2, min_dest), len(zone_names)
        names = "CAST(array(" + ", ".join(
            "'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in zone_names) + ") AS array<string>)"
    else:
        min_origin, min_dest, n_zones, names = (
            f"greatest(1, coalesce(_site.min_origin, {min_origin}))", f"greatest(2, coalesce(_site.min_dest, {min_dest}))",
            "coalesce(size(_site.zone_names), 0)", "coalesce(_site.zone_names, CAST(array() AS array<string>))")

    def sited(groups):
        if cameras is None:
            return groups
        return f"""SELECT g.*, c._site FROM ({groups}) g LEFT JOIN (
            SELECT run_id, camera_id, struct(zone_names, min_origin, min_dest) AS _site FROM {{cameras}}) c
            ON g.run_id = c.run_id AND g.camera_id = c.camera_id"""

    entered = f"IF(opens, array({_state(NEW)}), {_entry_states(n_zones, min_origin, min_dest)})"
    step = _step(min_origin, min_dest, direct)
    follow = (f"IF(s.st = {DONE}, s, "
              f"get(c.exits, CAST({_entry_index(n_zones, min_origin, min_dest)} AS INT)))")
    summed = "max(opens) AS opens, min(head) AS head, max(last_frame) AS last_frame"
    states = "array(" + ", ".join(f"'{n}'" for n in STATE_NAMES) + ")"
    entry = "struct(frame, z)"
    if "prev_zone_order" in lived.columns:
        entry = f"CASE WHEN z >= 0 OR new_life OR prev_zone_order IS NOT NULL THEN {entry} END"
        also = ", prev_zone_order"
    else:
        also = ""

    gathered = f"""array_sort(collect_list({entry})) AS seq, max(new_life) AS opens,
               min(struct(frame, cls)) AS head, max(frame) AS last_frame"""
    source = f"""
      SELECT {key}, shiftright(frame, {span_bits}) AS _span, shiftright(frame, {chunk_bits}) AS _chunk,
             frame, new_life, cls, CAST(coalesce(zone_order, -1) AS INT) AS z{also}
      FROM {{lived}}"""
    if fits(total_frames, chunk_bits):
        ended = f"""
          SELECT *, aggregate(seq, {_state(NEW)}, (s, r) -> {step}) AS _end
          FROM ({sited(f"SELECT {key}, {gathered} FROM ({source}) GROUP BY {key}")})"""
    else:
        chunks = f"""
          SELECT *, transform({entered}, e -> aggregate(seq, e, (s, r) -> {step})) AS exits
          FROM ({sited(f"SELECT {key}, _span, _chunk, {gathered} FROM ({source}) GROUP BY {key}, _span, _chunk")})"""
        last = "_chunk"
        if not fits(total_frames, span_bits):
            chunks = f"""
              SELECT *, transform({entered}, e -> aggregate(seq, e, (s, c) -> {follow})) AS exits
              FROM ({sited(f"SELECT {key}, _span, array_sort(collect_list(struct(_chunk, exits))) AS seq, {summed} FROM ({chunks}) GROUP BY {key}, _span")})"""
            last = "_span"
        ended = f"""
          SELECT *, aggregate(seq, {_state(NEW)}, (s, c) -> {follow}) AS _end
          FROM ({sited(f"SELECT {key}, array_sort(collect_list(struct({last}, exits))) AS seq, {summed} FROM ({chunks}) GROUP BY {key}")})"""
    return lived.sparkSession.sql(f"""
      SELECT {key}, get({states}, _end.st) AS state,
             CASE WHEN _end.o >= 0 THEN get({names}, _end.o) END AS origin,
             CASE WHEN _end.st = {DONE} THEN get({names}, _end.d) END AS destination,
             head.cls AS cls, _end.at AS frame, last_frame
      FROM ({ended})""", lived=lived, **({} if cameras is None else {"cameras": cameras}))


def completed(routes):
    """Route events: one row per completed route."""
    return routes.filter("state = 'done'").select(
        *LIFE, "origin", "destination", "cls", "frame",
        route_key(F.col("origin"), F.col("destination")).alias("route"))
