"""Object tracks, gaze and steering over the track and sensor stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverscope.functions.geometry import gaze_direction, gaze_millimetres, gaze_pitch, gaze_pixel, gaze_yaw, quaternion_yaw
from driverscope.operators import gaze as eyes
from driverscope.operators import chunks, steering, tracks as moving
from driverscope.operators.chunks import frame_grid
from driverscope.operators.timing import rolling_step_mean
from driverscope.plans.catalogue import query, rounded, table
from driverscope.plans.standins import SIGNAL_SQL, TRACKS_SQL, actors, recordings, signal, tracks
from driverscope.session import settle

SECOND = 1_000_000_000
SLOT = 60 * SECOND
KEYS = ["recording"]

EGO_SQL = f"""{TRACKS_SQL},
ego AS (SELECT t.*, degrees(atan2(2 * (qw * qz + qx * qy), qw * qw + qx * qx - qy * qy - qz * qz) - pi() / 2) AS yaw FROM tracks t WHERE object_id = 1),
ado AS (SELECT * FROM tracks WHERE object_id <> 1 AND recording IN (SELECT recording FROM ego))
"""
D3 = "sqrt((a.pose_x - e.pose_x) * (a.pose_x - e.pose_x) + (a.pose_y - e.pose_y) * (a.pose_y - e.pose_y) + (a.pose_z - e.pose_z) * (a.pose_z - e.pose_z))"


def split(spark, folder, rows=None):
    rows = tracks(spark, folder) if rows is None else rows
    few = actors(rows)
    ego, ado = moving.split_ego(rows, few, KEYS)
    return ego.withColumn("yaw", F.degrees(quaternion_yaw("qx", "qy", "qz", "qw"))), ado, few


def written_scenes(spark, folder):
    """Scenes and object summaries as tables, and the actors: the tracks are grouped once."""
    rows = settle(tracks(spark, folder))
    few = actors(rows)
    found = settle(moving.scenes(rows, few, KEYS, F.degrees(quaternion_yaw("qx", "qy", "qz", "qw"))))
    return found, settle(moving.object_summaries(found, KEYS)), few


@query(
    "relevant_trajectories",
    f"""WITH {TRACKS_SQL}, y AS (SELECT *, degrees(atan2(2 * (qw * qz + qx * qy), qw * qw + qx * qx - qy * qy - qz * qz) - pi() / 2) AS yaw FROM tracks
      WHERE recording IN (SELECT recording FROM tracks WHERE object_id = 1))
    SELECT a.recording, a.object_id, a.t_ns, round({D3}, 6) AS relevance, round(a.yaw, 6) AS yaw
    FROM y a LEFT JOIN (SELECT * FROM tracks WHERE object_id = 1) e ON a.recording = e.recording AND a.t_ns = e.t_ns""",
)
def relevant_trajectories(spark, folder):
    rows = tracks(spark, folder)
    out = moving.relevant_tracks(rows, actors(rows), KEYS)
    return out.select("recording", "object_id", "t_ns", rounded("relevance").alias("relevance"), rounded("yaw").alias("yaw"))


@query(
    "track_spans",
    f"""WITH {TRACKS_SQL}, s AS (SELECT recording, object_id, min(t_ns) AS s, max(t_ns) AS e FROM tracks GROUP BY 1, 2)
    SELECT a.recording, a.object_id, greatest(a.s, b.s) AS start_ns, least(a.e, b.e) AS end_ns FROM s a JOIN s b ON a.recording = b.recording
    WHERE b.object_id = 1 AND a.object_id <> 1""",
)
def track_spans(spark, folder):
    ego, ado, _ = split(spark, folder)
    return moving.shared_span(ado, ego, KEYS)


@query(
    "thinned_tracks",
    f"""WITH {TRACKS_SQL}, o AS (SELECT recording FROM tracks GROUP BY 1 HAVING count(DISTINCT object_id) >= 7)
    SELECT recording, object_id, t_ns FROM (SELECT *, row_number() OVER (PARTITION BY recording, object_id ORDER BY t_ns) - 1 AS r FROM tracks
      WHERE recording IN (SELECT recording FROM o)) WHERE r % 5 = 0""",
)
def thinned_tracks(spark, folder):
    full = moving.enough_objects(tracks(spark, folder), KEYS, 7)
    return moving.thin_tracks(full, KEYS, 5, 24 * SECOND).select("recording", "object_id", "t_ns")


HAZARD_SQL = f"""{EGO_SQL},
near AS (SELECT a.recording, a.object_id, min({D3}) AS near, min(a.t_ns) AS first_seen FROM ado a LEFT JOIN ego e ON a.recording = e.recording AND a.t_ns = e.t_ns GROUP BY 1, 2),
span AS (SELECT recording, min(t_ns) AS s, max(t_ns) AS e FROM ego GROUP BY 1),
scored AS (SELECT n.*, CASE WHEN role = 'pedestrian' THEN 0 ELSE 1 END AS late,
    CASE WHEN role = 'pedestrian' THEN 0 ELSE abs(start_epoch_ns - s) + abs(end_epoch_ns - e) + coalesce(near, 'inf'::DOUBLE)
      + CASE WHEN actor_type = 'vehicle.mercedes.coupe_2020' THEN 0 ELSE 10000 END END AS score
  FROM near n JOIN actors USING (recording, object_id) JOIN span USING (recording)),
hazard AS (SELECT recording, object_id AS hazard_id FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY late, score, first_seen, object_id) AS r FROM scored) WHERE r = 1)
"""


@query("hazard_choice", f"WITH {HAZARD_SQL} SELECT recording, hazard_id FROM hazard")
def hazard_choice(spark, folder):
    _, summaries, few = written_scenes(spark, folder)
    return moving.choose_hazard(summaries, few, KEYS)


@query(
    "hazard_tracks",
    f"WITH {HAZARD_SQL} SELECT a.recording, a.t_ns, a.pose_x, a.pose_y FROM ado a JOIN hazard h ON a.recording = h.recording AND a.object_id = hazard_id",
)
def hazard_tracks(spark, folder):
    found, summaries, few = written_scenes(spark, folder)
    chosen = moving.choose_hazard(summaries, few, KEYS)
    return moving.hazard_tracks(found, chosen, KEYS).select("recording", "t_ns", "pose_x", "pose_y")


# The stand-in world is smaller than a road: distances are scaled, and a step back is two time steps.
REMOVAL_SQL = f"""{HAZARD_SQL},
ends AS (SELECT recording, max(t_ns) AS e_end FROM ego GROUP BY 1),
lastrow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording, object_id ORDER BY t_ns DESC) AS r,
    min(t_ns) OVER (PARTITION BY recording, object_id) AS first_ns FROM ado) WHERE r = 1),
j AS (SELECT a.recording, a.object_id, a.t_ns, a.first_ns, e_end, {D3} AS dist,
    (degrees(atan2(a.pose_y - e.pose_y, a.pose_x - e.pose_x)) - e.yaw + 180) AS raw,
    sqrt((a.pose_x - b.pose_x) * (a.pose_x - b.pose_x) + (a.pose_y - b.pose_y) * (a.pose_y - b.pose_y) + (a.pose_z - b.pose_z) * (a.pose_z - b.pose_z)) AS moved,
    sqrt((a.pose_x - h.pose_x) * (a.pose_x - h.pose_x) + (a.pose_y - h.pose_y) * (a.pose_y - h.pose_y) + (a.pose_z - h.pose_z) * (a.pose_z - h.pose_z)) AS from_hazard
  FROM lastrow a JOIN ends ON ends.recording = a.recording LEFT JOIN ego e ON a.recording = e.recording AND a.t_ns = e.t_ns
  LEFT JOIN ado b ON a.recording = b.recording AND a.object_id = b.object_id AND b.t_ns = a.t_ns - 2000000000
  LEFT JOIN (SELECT x.* FROM ado x JOIN hazard z ON x.recording = z.recording AND x.object_id = z.hazard_id) h ON a.recording = h.recording AND a.t_ns = h.t_ns),
removals AS (SELECT recording, object_id, t_ns AS time_ns, dist, raw - 360 * floor(raw / 360) - 180 AS direction,
    CASE WHEN t_ns = e_end THEN 'end' WHEN dist >= 60 THEN 'far' WHEN moved <= 25 THEN 'still' WHEN recording % 2 = 0 AND from_hazard <= 45 THEN 'hazard'
         WHEN first_ns = 0 THEN 'previous' ELSE 'unknown' END AS cause FROM j),
shown AS (SELECT *, dist < 100 AND direction BETWEEN 45 AND 135 AS on_screen FROM removals)
"""


def removals(spark, folder):
    found, summaries, few = written_scenes(spark, folder)
    chosen = moving.choose_hazard(summaries, few, KEYS)
    rule = F.col("recording") % 2 == 0
    return moving.removal_stats(found, summaries, chosen, KEYS, rule, far=60.0, still=25.0, still_ns=2 * SECOND, near_hazard=45.0)


@query(
    "ado_removal",
    f"""WITH {REMOVAL_SQL} SELECT recording, object_id, time_ns, round(dist, 6) AS distance_from_ego, round(direction, 6) AS direction_from_ego_deg, on_screen, cause FROM shown""",
)
def ado_removal(spark, folder):
    return removals(spark, folder).withColumns(
        {c: rounded(c) for c in ("distance_from_ego", "direction_from_ego_deg")}
    )


@query(
    "ado_removal_causes",
    f"WITH {REMOVAL_SQL} SELECT cause, count(*) AS removals, count(*) FILTER (on_screen AND cause IN ('still', 'hazard', 'unknown')) AS visible FROM shown GROUP BY 1",
)
def ado_removal_causes(spark, folder):
    few = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("recording"), F.col("s_nationkey").alias("seconds"))
    return moving.removal_totals(removals(spark, folder), few, KEYS, F.col("seconds"))[0]


@query(
    "ado_removal_totals",
    f"""WITH {REMOVAL_SQL}, g AS (SELECT recording, count(*) AS r, count(*) FILTER (on_screen AND cause IN ('still', 'hazard', 'unknown')) AS v FROM shown GROUP BY 1)
    SELECT count(*) AS scenarios, CAST(sum(r) AS BIGINT) AS removals, CAST(sum(s_nationkey) AS BIGINT) AS duration, CAST(sum(v) AS BIGINT) AS visible
    FROM g JOIN supplier ON s_suppkey = recording""",
)
def ado_removal_totals(spark, folder):
    few = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("recording"), F.col("s_nationkey").alias("seconds"))
    return moving.removal_totals(removals(spark, folder), few, KEYS, F.col("seconds"))[1]


@query(
    "chunk_top_objects",
    f"""WITH {TRACKS_SQL}, a AS (SELECT a.recording, a.t_ns // 24000000000 AS chunk, a.object_id, min({D3}) AS relevance
      FROM tracks a LEFT JOIN (SELECT * FROM tracks WHERE object_id = 1) e ON a.recording = e.recording AND a.t_ns = e.t_ns GROUP BY 1, 2, 3)
    SELECT recording, chunk, object_id, CAST(r - 1 AS INT) AS object_slot, round(relevance, 6) AS relevance
    FROM (SELECT *, row_number() OVER (PARTITION BY recording, chunk ORDER BY relevance NULLS LAST, object_id) AS r FROM a) WHERE r <= 3""",
)
def chunk_top_objects(spark, folder):
    rows = tracks(spark, folder)
    near = moving.relevant_tracks(rows, actors(rows), KEYS).withColumn("chunk", F.expr("t_ns div 24000000000"))
    best = moving.top_objects(moving.chunk_relevance(near, ["recording", "chunk"]), ["recording", "chunk"], 3)
    return best.withColumn("relevance", rounded("relevance"))


@query(
    "key_actors",
    f"""WITH {TRACKS_SQL}, k AS (SELECT *, start_epoch_ns / 1e9::DOUBLE AS seen, CASE WHEN recording % 2 = 0 THEN 'mercedes' ELSE 'audi' END AS wanted FROM actors),
    e AS (SELECT recording, object_id AS ego_id, seen AS ego_seen FROM k WHERE role = 'hero')
    SELECT e.recording, ego_id, (SELECT min(object_id) FROM k WHERE k.recording = e.recording AND contains(actor_type, wanted) AND seen - ego_seen < 0.01) AS hazard_id FROM e""",
)
def key_actors(spark, folder):
    few = actors(tracks(spark, folder)).withColumn("seen", F.col("start_epoch_ns") / 1e9).withColumn("kind", F.col("recording") % 2)
    kinds = few.select("kind").distinct().withColumn("hazard_type", F.when(F.col("kind") == 0, "mercedes").otherwise("audi"))
    return moving.key_actors(few, kinds, KEYS, "kind", "seen")


@query(
    "attributes_in_chunks",
    f"""WITH {TRACKS_SQL}, s AS (SELECT recording, max(t_ns) AS e FROM tracks GROUP BY 1), g AS (SELECT recording, (e + 999999999) // 1000000000 AS n FROM s),
    c AS (SELECT recording, CAST(k AS BIGINT) AS chunk_number, k * 7 * 1000000000 AS a, (k * 7 + 4) * 1000000000 AS b
      FROM (SELECT recording, unnest(range(greatest(0, CAST(floor((n - 5) / 7.0) AS BIGINT) + 1))) AS k FROM g))
    SELECT x.recording, object_id, chunk_number FROM actors x JOIN c ON x.recording = c.recording AND x.start_epoch_ns <= b AND x.end_epoch_ns >= a""",
)
def attributes_in_chunks(spark, folder):
    rows = tracks(spark, folder)
    spans = rows.groupBy("recording").agg(F.lit(0).cast("long").alias("start_time"), F.max("t_ns").alias("end_time"))
    cut = chunks.chunk_recordings(spans, chunks.ChunkSpec("start", duration=5.0, stride=7.0, per_recording=None, fps=1), KEYS)
    found = chunks.attributes_in_chunks(actors(rows), cut, KEYS, 10 * SECOND)
    return found.select("recording", "object_id", "chunk_number")


@query(
    "object_trails",
    f"""WITH {EGO_SQL} SELECT a.recording, a.object_id, e.t_ns AS now_ns, count(*) AS points, min(a.t_ns) AS first_ns,
      round(sum((a.pose_x - e.pose_x) * cos(radians(e.yaw)) + (a.pose_y - e.pose_y) * sin(radians(e.yaw))), 4) + 0.0 AS total
    FROM tracks a JOIN ego e ON a.recording = e.recording AND a.t_ns BETWEEN e.t_ns - 3000000000 AND e.t_ns GROUP BY 1, 2, 3""",
)
def object_trails(spark, folder):
    """One array per object and ego time."""
    rows = tracks(spark, folder)
    ego, _, _ = split(spark, folder)
    out = moving.trails(rows, ego.withColumn("yaw_rad", F.radians("yaw")), KEYS, 3 * SECOND)
    total = F.aggregate("trail", F.lit(0.0), lambda acc, p: acc + p["right"])
    return out.select("recording", "object_id", "now_ns", F.size("trail").cast("long").alias("points"), F.col("trail")[0]["t_ns"].alias("first_ns"), (rounded(total, 4) + 0.0).alias("total"))


@query(
    "trailing_trajectories",
    f"""WITH {EGO_SQL} SELECT a.recording, a.object_id, e.t_ns AS now_ns, a.t_ns,
      round((a.pose_x - e.pose_x) * cos(radians(e.yaw)) + (a.pose_y - e.pose_y) * sin(radians(e.yaw)), 6) AS "right",
      round((a.pose_y - e.pose_y) * cos(radians(e.yaw)) - (a.pose_x - e.pose_x) * sin(radians(e.yaw)), 6) AS ahead
    FROM tracks a JOIN ego e ON a.recording = e.recording AND a.t_ns BETWEEN e.t_ns - 3000000000 AND e.t_ns""",
)
def trailing_trajectories(spark, folder):
    rows = tracks(spark, folder)
    ego, _, _ = split(spark, folder)
    out = moving.trailing_trajectories(rows, ego.withColumn("yaw_rad", F.radians("yaw")), KEYS, 3 * SECOND)
    return out.withColumns({c: rounded(c) for c in ("right", "ahead")})


def least_squares_sql(keep: str) -> str:
    """Weighted cubic through the rows within 2.5 s by its 4 x 4 normal equations, solved by elimination over columns."""
    powers = [f"sum(w * w * pow(tau, {k})) AS s{k}" for k in range(7)]
    sides = [f"sum(w * w * pow(tau, {k}) * {v}) AS {v}{k}" for v in ("r", "a") for k in range(4)]
    # Gauss: row i of the symmetric system is s_i .. s_{i+3} | r_i | a_i; each stage removes one unknown
    names = ["c0", "c1", "c2", "c3", "r", "a"]
    stages, source = [], "sums"
    rows = {i: {**{f"c{j}": f"s{i + j}" for j in range(4)}, "r": f"r{i}", "a": f"a{i}"} for i in range(4)}
    for k in range(3):
        cells, after = [], {}
        for i in rows:
            if i <= k:
                after[i] = {}
                for n, e in rows[i].items():
                    cells.append(f"{e} AS e{k}_{i}_{n}")
                    after[i][n] = f"e{k}_{i}_{n}"
                continue
            after[i] = {}
            for n in names:
                cells.append(f"{rows[i][n]} - {rows[i][f'c{k}']} / {rows[k][f'c{k}']} * {rows[k][n]} AS e{k}_{i}_{n}")
                after[i][n] = f"e{k}_{i}_{n}"
        stages.append(f"g{k} AS (SELECT {keep}, yaw, good, {', '.join(cells)} FROM {source})")
        source, rows = f"g{k}", after
    solved = {}
    for v in ("r", "a"):
        solved[v, 3] = f"({rows[3][v]} / {rows[3]['c3']})"
        solved[v, 2] = f"(({rows[2][v]} - {rows[2]['c3']} * {solved[v, 3]}) / {rows[2]['c2']})"
        solved[v, 1] = f"(({rows[1][v]} - {rows[1]['c2']} * {solved[v, 2]} - {rows[1]['c3']} * {solved[v, 3]}) / {rows[1]['c1']})"
    out = []
    for k, (kind, factor) in enumerate((("speed", 1), ("acceleration", 2), ("jerk", 6)), 1):
        out += [f"CASE WHEN good >= 4 THEN round({factor} * {solved[v, k]}, 4) + 0.0 END AS {axis}_{kind}" for v, axis in (("r", "lateral"), ("a", "longitudinal"))]
    return f"""WITH {TRACKS_SQL},
    ego AS (SELECT recording, t_ns, pose_x, pose_y, pose_z, atan2(2 * (qw * qz + qx * qy), qw * qw + qx * qx - qy * qy - qz * qz) - pi() / 2 AS turn FROM tracks WHERE object_id = 1),
    near AS (SELECT e.{keep.replace(', ', ', e.')}, e.turn, cos((n.t_ns - e.t_ns) / 1e9 / 2.5 * (pi() / 2)) AS w, (n.t_ns - e.t_ns) / 1e9::DOUBLE AS tau,
      first_value(n.pose_x) OVER s AS x0, first_value(n.pose_y) OVER s AS y0, n.pose_x AS x, n.pose_y AS y
      FROM ego e JOIN ego n ON n.recording = e.recording AND n.t_ns BETWEEN e.t_ns - 2500000000 AND e.t_ns + 2500000000 WINDOW s AS (PARTITION BY e.recording, e.t_ns ORDER BY n.t_ns)),
    seen AS (SELECT *, (x - x0) * cos(turn) + (y - y0) * sin(turn) AS r, (y - y0) * cos(turn) - (x - x0) * sin(turn) AS a FROM near),
    sums AS (SELECT {keep}, round(degrees(any_value(turn)), 6) AS yaw, count(*) FILTER (w >= 1e-9) AS good, {', '.join(powers + sides)} FROM seen GROUP BY {keep}),
    {', '.join(stages)}
    SELECT {keep}, yaw, {', '.join(out)} FROM {source}"""


@query("ego_kinematics", least_squares_sql("recording, t_ns"))
def ego_kinematics(spark, folder):
    """A weighted local cubic per row; the SQL writes out its normal equations."""
    ego, _, _ = split(spark, folder)
    out = steering.ego_kinematics(ego.drop("yaw"), KEYS, smoothing=False)
    return out.select("recording", "t_ns", rounded("yaw").alias("yaw"), *[(rounded(c, 4) + 0.0).alias(c) for c in steering.KINEMATICS])


@query("ego_kinematics_smoothed")
def ego_kinematics_smoothed(spark, folder):
    """The same with knots where a cubic is not close enough, which on these made-up tracks is nearly everywhere."""
    ego, _, _ = split(spark, folder)
    return steering.ego_kinematics(ego.drop("yaw"), KEYS)


# Gaze: the sensor's value over 300 is the horizontal, k over 99 the vertical screen fraction.
GAZE_SQL = f"""{SIGNAL_SQL},
gaze AS (SELECT user_id, event_id, t_ns, x / 300 AS gx, (y + 50) / 99 AS gy FROM signal)
"""


def gaze_rows(spark, folder):
    return signal(spark, folder).select("user_id", "event_id", "t_ns", (F.col("x") / 300).alias("gx"), ((F.col("y") + 50) / 99).alias("gy"))


@query(
    "gaze_pitch_yaw",
    f"""WITH {TRACKS_SQL} SELECT recording, object_id, t_ns, round(degrees(atan2(pose_y - qx, qz - pose_z)), 6) AS pitch,
      round(degrees(atan2(pose_x - qy, qz - pose_z)), 6) AS yaw FROM tracks""",
)
def gaze_pitch_yaw(spark, folder):
    return tracks(spark, folder).select(
        "recording",
        "object_id",
        "t_ns",
        rounded(gaze_pitch("pose_y", "pose_z", "qx", "qz")).alias("pitch"),
        rounded(gaze_yaw("pose_x", "pose_z", "qy", "qz")).alias("yaw"),
    )


@query(
    "gaze_screen",
    f"""WITH {GAZE_SQL}, p AS (SELECT *, round_even(gx * 960, 0) AS a, round_even(gy * 400, 0) AS b FROM gaze)
    SELECT event_id, CAST(CASE WHEN a >= 0 AND a < 960 THEN a END AS INT) AS px, CAST(CASE WHEN b >= 0 AND b < 400 THEN b END AS INT) AS py,
      round(sin(radians((gx - 0.5) * 90)), 6) AS look_right, round(cos(radians((gx - 0.5) * 90)), 6) AS look_ahead,
      round(coalesce(gx * 3840 * 0.229::DOUBLE, -1000), 6) AS x_mm FROM p""",
)
def gaze_screen(spark, folder):
    right, ahead = gaze_direction("gx")
    return gaze_rows(spark, folder).select(
        "event_id",
        gaze_pixel("gx", 960).alias("px"),
        gaze_pixel("gy", 400).alias("py"),
        rounded(right).alias("look_right"),
        rounded(ahead).alias("look_ahead"),
        rounded(gaze_millimetres("gx", 3840)).alias("x_mm"),
    )


@query(
    "gaze_complete",
    f"WITH {GAZE_SQL} SELECT event_id FROM gaze WHERE gx IS NOT NULL AND gy IS NOT NULL",
)
def gaze_complete(spark, folder):
    return eyes.complete_gaze(gaze_rows(spark, folder), ["gx", "gy"]).select("event_id")


@query(
    "gaze_value_in_frame",
    f"""WITH {GAZE_SQL}, p AS (SELECT *, round_even(gx * 8, 0) AS a, round_even(gy * 8, 0) AS b FROM gaze)
    SELECT event_id, round(CASE WHEN a >= 0 AND a < 8 AND b >= 0 AND b < 8 THEN embedding[CAST(b * 8 + a AS INT) + 1]::DOUBLE END, 6) AS depth
    FROM p LEFT JOIN embeddings ON vec_id = user_id""",
)
def gaze_value_in_frame(spark, folder):
    frames = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "user_id")
    out = eyes.value_at_gaze(frames, gaze_rows(spark, folder), ["user_id"], "embedding", 8, 8, "gx", "gy", "depth")
    return out.select("event_id", rounded(F.col("depth").cast("double")).alias("depth"))


@query(
    "gaze_value_in_frame_at_time",
    f"""WITH {GAZE_SQL}, p AS (SELECT *, round_even(gx * 8, 0) AS a, round_even(gy * 8, 0) AS b FROM gaze),
    f AS (SELECT DISTINCT user_id, t_ns, CASE WHEN t_ns // 1000 % 2 = 0 THEN embedding ELSE list_reverse(embedding) END AS pixels FROM signal JOIN embeddings ON vec_id = user_id WHERE event_type <> 'purchase')
    SELECT event_id, round(CASE WHEN a >= 0 AND a < 8 AND b >= 0 AND b < 8 THEN pixels[CAST(b * 8 + a AS INT) + 1]::DOUBLE END, 6) AS depth
    FROM p LEFT JOIN f ON f.user_id = p.user_id AND f.t_ns = p.t_ns""",
)
def gaze_value_in_frame_at_time(spark, folder):
    """Frames of a recording differ from time to time; some times have none."""
    shown = signal(spark, folder).where("event_type <> 'purchase'").join(table(spark, folder, "embeddings"), F.col("vec_id") == F.col("user_id"))
    turned = F.when(F.expr("t_ns div 1000 % 2 = 0"), F.col("embedding")).otherwise(F.reverse("embedding"))
    frames = shown.select("user_id", "t_ns", turned.alias("pixels")).distinct()
    out = eyes.value_at_gaze(frames, gaze_rows(spark, folder), ["user_id", "t_ns"], "pixels", 8, 8, "gx", "gy", "depth")
    return out.select("event_id", rounded(F.col("depth").cast("double")).alias("depth"))


@query(
    "gaze_latest_within",
    f"""WITH {GAZE_SQL}, f AS (SELECT user_id, k, k * 1000000000 AS t FROM (SELECT user_id, unnest(range((end_time + 999999999) // 1000000000)) AS k FROM recordings)),
    j AS (SELECT f.user_id, k, t, g.event_id, g.t_ns, g.gx, row_number() OVER (PARTITION BY f.user_id, k ORDER BY g.t_ns DESC, g.event_id DESC) AS r
      FROM f JOIN gaze g ON f.user_id = g.user_id AND g.t_ns <= t AND g.t_ns >= t - 6000000000)
    SELECT user_id, k AS frame, t_ns AS latest_time, event_id AS latest_event_id, round(gx, 6) AS latest_gx FROM j WHERE r = 1
    UNION ALL SELECT user_id, k, NULL, NULL, NULL FROM f WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.user_id = f.user_id AND j.k = f.k)""",
)
def gaze_latest_within(spark, folder):
    frames = frame_grid(recordings(signal(spark, folder)), 1, keys=["user_id"]).select("user_id", "frame", "t_ns")
    out = eyes.latest_within(frames, gaze_rows(spark, folder), ["user_id"], 6 * SECOND, ["event_id", "gx"], "event_id")
    return out.select("user_id", "frame", "latest_time", "latest_event_id", rounded("latest_gx").alias("latest_gx"))


@query(
    "gaze_in_frames",
    f"""WITH {GAZE_SQL}, f AS (SELECT user_id, t_ns, event_id AS frame, lead(t_ns) OVER (PARTITION BY user_id ORDER BY t_ns, event_id) AS nxt FROM signal WHERE event_type = 'view')
    SELECT g.event_id, f.frame, CAST(trunc(gx * 960) AS INT) AS px, 960 - CAST(trunc(gx * 960) AS INT) AS mirrored
    FROM gaze g JOIN f ON g.user_id = f.user_id AND g.t_ns >= f.t_ns AND g.t_ns < nxt""",
)
def gaze_in_frames(spark, folder):
    frames = signal(spark, folder).where("event_type = 'view'").select("user_id", "t_ns", F.col("event_id").alias("frame"))
    shown = eyes.gaze_in_frames(gaze_rows(spark, folder), frames, ["user_id"], SLOT)
    return shown.select(
        "event_id", "frame", eyes.frame_pixel(F.col("gx"), 960).alias("px"), eyes.frame_pixel(F.col("gx"), 960, True).alias("mirrored")
    )


AREA_SQL = f"""{GAZE_SQL},
areas AS (SELECT user_id, event_id, t_ns, CASE WHEN gx BETWEEN 0 AND 1 AND gy BETWEEN 0 AND 1
    THEN CAST(least(floor(gy * 1), 0) * 3 + least(floor(gx * 3), 2) AS INT) END AS area,
    row_number() OVER (PARTITION BY user_id ORDER BY t_ns) - 1 AS r FROM gaze),
moves AS (SELECT *, lag(area) OVER (PARTITION BY user_id ORDER BY t_ns) AS origin FROM areas)
"""


def areas(spark, folder):
    rows = gaze_rows(spark, folder)
    return rows.select("user_id", "event_id", "t_ns", eyes.area_of_interest(F.col("gx"), F.col("gy"), 3, 1).alias("area"))


@query(
    "gaze_entropy_rolling",
    f"""WITH {AREA_SQL},
    c AS (SELECT a.user_id, a.event_id, b.area, count(*) AS n FROM areas a JOIN areas b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 20 AND a.r - 1
      WHERE a.r >= 20 AND b.area IS NOT NULL GROUP BY 1, 2, 3),
    p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY event_id) AS p FROM c),
    m AS (SELECT a.event_id, b.origin, b.area, count(*) AS n FROM areas a JOIN moves b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 19 AND a.r - 1
      WHERE a.r >= 20 AND b.area IS NOT NULL AND b.origin IS NOT NULL GROUP BY 1, 2, 3),
    q AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY event_id, origin) AS q FROM m),
    h AS (SELECT event_id, origin, -sum(q * log2(q)) AS h FROM q GROUP BY 1, 2),
    s AS (SELECT p.event_id, -sum(p * log2(p)) + 0 AS st, sum(p * coalesce(h, 0)) AS tr FROM p LEFT JOIN h ON p.event_id = h.event_id AND p.area = h.origin GROUP BY 1)
    SELECT a.event_id, round(st, 6) AS stationary_entropy, round(tr, 6) AS transition_entropy FROM areas a LEFT JOIN s ON a.event_id = s.event_id""",
)
def gaze_entropy_rolling(spark, folder):
    out = eyes.rolling_entropy(areas(spark, folder), ["user_id"], "area", 3, 20, SLOT, segment=40)
    return out.select("event_id", *[(rounded(c) + 0.0).alias(c) for c in ("stationary_entropy", "transition_entropy")])


@query(
    "gaze_entropy_whole",
    f"""WITH {AREA_SQL},
    c AS (SELECT user_id, area, count(*) AS n FROM areas WHERE area IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
    m AS (SELECT user_id, origin, area, count(*) AS n FROM moves WHERE area IS NOT NULL AND origin IS NOT NULL GROUP BY 1, 2, 3),
    q AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY user_id, origin) AS q FROM m),
    h AS (SELECT user_id, origin, -sum(q * log2(q)) AS h FROM q GROUP BY 1, 2)
    SELECT p.user_id, round(-sum(p * log2(p)), 6) AS stationary_entropy, round(sum(p * coalesce(h, 0)), 6) AS transition_entropy
    FROM p LEFT JOIN h ON p.user_id = h.user_id AND p.area = h.origin GROUP BY 1""",
)
def gaze_entropy_whole(spark, folder):
    out = eyes.recording_entropy(areas(spark, folder), ["user_id"], "area", 3, SLOT)
    return out.select("user_id", *[rounded(c).alias(c) for c in ("stationary_entropy", "transition_entropy")])


def _ratio_sql(step: int) -> str:
    return f"""WITH {SIGNAL_SQL}, r AS (SELECT user_id, event_id, CAST(event_type = 'click' AS INT) AS f, CAST(event_type = 'view' AS INT) AS s,
        row_number() OVER (PARTITION BY user_id ORDER BY t_ns) - 1 AS r FROM signal),
      b AS (SELECT a.user_id, a.event_id, sum(b.f) AS f, sum(b.s) AS s FROM r a JOIN r b ON a.user_id = b.user_id
        AND b.r BETWEEN (a.r - (a.r - 10) % {step}) - 10 AND (a.r - (a.r - 10) % {step}) - 1 WHERE a.r >= 10 GROUP BY 1, 2)
    SELECT r.event_id, round(b.f / nullif(b.s, 0)::DOUBLE, 6) AS fixation_saccade_ratio, round(b.s / nullif(b.f, 0)::DOUBLE, 6) AS saccade_fixation_ratio
    FROM r LEFT JOIN b ON r.event_id = b.event_id"""


def _ratios(step: int):
    def run(spark, folder):
        rows = signal(spark, folder).select(
            "user_id", "event_id", "t_ns", (F.col("event_type") == "click").cast("int").alias("fixation"), (F.col("event_type") == "view").cast("int").alias("saccade")
        )
        out = eyes.fixation_saccade_ratio(rows, ["user_id"], SLOT, window_s=5.0, fps=2, step=step, segment=25)
        return out.select("event_id", *[rounded(c).alias(c) for c in ("fixation_saccade_ratio", "saccade_fixation_ratio")])

    return run


query("fixation_saccade_ratio", _ratio_sql(1))(_ratios(1))
query("fixation_saccade_ratio_stepped", _ratio_sql(3))(_ratios(3))


def gaze_mm(spark, folder):
    return gaze_rows(spark, folder).select("user_id", "event_id", "t_ns", (F.col("gx") * 100).alias("x_mm"), (F.col("gy") * 100).alias("y_mm"))


@query(
    "saccade_marks",
    f"""WITH {GAZE_SQL}, s AS (SELECT user_id, t_ns, gx * 100 AS x, gy * 100 AS y FROM gaze WHERE gx IS NOT NULL AND gy IS NOT NULL),
    v AS (SELECT *, lag(t_ns) OVER w AS before, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / ((t_ns - lag(t_ns) OVER w) / 1e9::DOUBLE) AS v
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t_ns)),
    a AS (SELECT *, coalesce(v > 6, false) OR coalesce(v - lag(v) OVER (PARTITION BY user_id ORDER BY t_ns) > 5, false) AS fast FROM v),
    g AS (SELECT *, sum(CASE WHEN fast AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_ns) AS run
      FROM (SELECT *, lag(fast) OVER (PARTITION BY user_id ORDER BY t_ns) AS was FROM a)),
    i AS (SELECT user_id, run, min(before) AS s, max(t_ns) AS e FROM g WHERE fast GROUP BY 1, 2 HAVING max(t_ns) - min(before) >= 2000000000)
    SELECT event_id, CAST(EXISTS (SELECT 1 FROM i WHERE i.user_id = z.user_id AND z.t_ns BETWEEN s AND e) AS INT) AS saccade FROM gaze z""",
)
def saccade_marks(spark, folder):
    rows = gaze_mm(spark, folder)
    spans = eyes.detect_saccades(rows, ["user_id"], SLOT, max_velocity=6.0, max_acceleration=5.0, min_ms=2000.0)
    return eyes.mark_intervals(rows, spans, ["user_id"], "saccade", 20 * SECOND).select("event_id", "saccade")


@query(
    "fixation_marks",
    f"""WITH RECURSIVE {GAZE_SQL}, p AS (
      SELECT user_id, t_ns AS t, gx * 100 AS x, gy * 100 AS y, row_number() OVER (PARTITION BY user_id ORDER BY t_ns, gx, gy) AS i
      FROM gaze WHERE gx IS NOT NULL AND gy IS NOT NULL),
    walk AS (SELECT user_id, i, x, y, CAST(NULL AS BIGINT) AS began, t AS seen, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM p WHERE i = 1
      UNION ALL SELECT user_id, i, CASE WHEN stays THEN ax ELSE x END, CASE WHEN stays THEN ay ELSE y END,
        CASE WHEN stays THEN before WHEN near AND before IS NULL THEN t END, t, CASE WHEN NOT near THEN before END, CASE WHEN NOT near AND before IS NOT NULL THEN seen END
      FROM (SELECT *, near AND before IS NOT NULL AS stays FROM (SELECT p.user_id, p.i, p.x, p.y, p.t, w.x AS ax, w.y AS ay, w.began AS before, w.seen,
          sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y)) <= 40 AS near FROM walk w JOIN p ON p.user_id = w.user_id AND p.i = w.i + 1))),
    ends AS (SELECT w.user_id, w.began AS s, w.seen AS e FROM walk w JOIN (SELECT user_id, max(i) AS i FROM p GROUP BY 1) m ON m.user_id = w.user_id AND m.i = w.i WHERE w.began IS NOT NULL),
    kept AS (SELECT * FROM (SELECT user_id, s, e FROM walk WHERE s IS NOT NULL UNION ALL SELECT * FROM ends) WHERE e - s >= 2000000000)
    SELECT event_id, CAST(EXISTS (SELECT 1 FROM kept k WHERE k.user_id = z.user_id AND z.t_ns BETWEEN k.s AND k.e) AS INT) AS fixation FROM gaze z""",
)
def fixation_marks(spark, folder):
    rows = gaze_mm(spark, folder)
    spans = eyes.detect_fixations(rows, ["user_id"], SLOT, max_distance=40.0, min_ms=2000.0)
    return eyes.mark_intervals(rows, spans, ["user_id"], "fixation", 20 * SECOND).select("event_id", "fixation")


@query(
    "both_eyes",
    f"""WITH {GAZE_SQL}, l AS (SELECT user_id, event_id, gx AS v FROM gaze WHERE gx IS NOT NULL), r AS (SELECT user_id, event_id, gy AS v FROM gaze WHERE gy IS NOT NULL)
    SELECT coalesce(l.event_id, r.event_id) AS event_id, round(l.v, 6) AS gaze_left_fraction, round(r.v, 6) AS gaze_right_fraction
    FROM l FULL JOIN r ON l.user_id = r.user_id AND l.event_id = r.event_id""",
)
def both_eyes(spark, folder):
    rows = gaze_rows(spark, folder)
    left = rows.where("gx IS NOT NULL").select("user_id", "event_id", F.col("gx").alias("fraction"))
    right = rows.where("gy IS NOT NULL").select("user_id", "event_id", F.col("gy").alias("fraction"))
    out = eyes.both_eyes(left, right, ["user_id", "event_id"], ["fraction"])
    return out.select("event_id", *[rounded(c).alias(c) for c in ("gaze_left_fraction", "gaze_right_fraction")])


WHEEL_SQL = f"""{SIGNAL_SQL},
wheel AS (SELECT user_id, event_id, t_ns, y AS angle FROM signal WHERE y IS NOT NULL),
steps AS (SELECT *, angle - lag(angle) OVER w AS step_in, lead(angle) OVER w - angle AS step_out FROM wheel WINDOW w AS (PARTITION BY user_id ORDER BY t_ns)),
still AS (SELECT *, coalesce(step_in = 0, false) OR coalesce(step_in > 0 AND step_out < 0, false) AS is_stationary FROM steps)
"""


def wheel(spark, folder):
    return signal(spark, folder).where("y IS NOT NULL").select("user_id", "event_id", "t_ns", F.col("y").alias("angle"))


@query("stationary_points", f"WITH {WHEEL_SQL} SELECT event_id, is_stationary FROM still")
def stationary_points(spark, folder):
    return steering.stationary_points(wheel(spark, folder), ["user_id"], "angle", SLOT).select("event_id", "is_stationary")


@query(
    "steering_reversals",
    f"""WITH RECURSIVE {WHEEL_SQL},
    pts AS (SELECT user_id, event_id, sgn, angle * sgn AS v, row_number() OVER (PARTITION BY user_id, sgn ORDER BY t_ns) AS i
      FROM still CROSS JOIN (VALUES (1), (-1)) s(sgn) WHERE is_stationary),
    walk AS (SELECT user_id, event_id, sgn, i, v AS level, false AS hit FROM pts WHERE i = 1
      UNION ALL SELECT p.user_id, p.event_id, p.sgn, p.i, CASE WHEN p.v - w.level >= 25 OR p.v < w.level THEN p.v ELSE w.level END, p.v - w.level >= 25
      FROM walk w JOIN pts p ON p.user_id = w.user_id AND p.sgn = w.sgn AND p.i = w.i + 1)
    SELECT w.event_id, CAST(EXISTS (SELECT 1 FROM walk k WHERE k.event_id = w.event_id AND hit) AS INT) AS reversals_25_0 FROM wheel w""",
)
def steering_reversals(spark, folder):
    return steering.mark_reversals(wheel(spark, folder), ["user_id"], "angle", [25.0], SLOT).select("event_id", "reversals_25_0")


def _filter_sql(cutoff: float, fps: float) -> str:
    """The recursive filter sample by sample, forth and back, over rows extended by point reflection."""
    (b0, b1, b2), (_, a1, a2) = (c.tolist() for c in steering.butterworth_low_pass(cutoff, fps))
    edge = steering.EDGE_ROWS

    def once(name: str, source: str) -> str:
        step = f"{b0!r}::DOUBLE * p.u + {b1!r}::DOUBLE * w.u + {b2!r}::DOUBLE * w.u2 - {a1!r}::DOUBLE * w.y - {a2!r}::DOUBLE * w.y2"
        return f"""{name} AS (SELECT user_id, i, u, u AS u2, u AS y, u AS y2 FROM {source} WHERE i = 0
      UNION ALL SELECT p.user_id, p.i, p.u, w.u, {step}, w.y FROM {name} w JOIN {source} p ON p.user_id = w.user_id AND p.i = w.i + 1)"""

    return f"""rows AS (SELECT user_id, event_id, t_ns, angle AS v, row_number() OVER (PARTITION BY user_id ORDER BY t_ns, angle, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM wheel),
    ends AS (SELECT user_id, any_value(n) AS n, min(v) FILTER (k = 0) AS v0, min(v) FILTER (k = n - 1) AS v1 FROM rows WHERE n > {edge} GROUP BY user_id),
    fed AS (SELECT r.user_id, k + {edge} AS i, v AS u FROM rows r JOIN ends e ON e.user_id = r.user_id
      UNION ALL SELECT r.user_id, {edge} - k, 2 * v0 - v FROM rows r JOIN ends e ON e.user_id = r.user_id WHERE k BETWEEN 1 AND {edge}
      UNION ALL SELECT r.user_id, 2 * e.n - 2 - k + {edge}, 2 * v1 - v FROM rows r JOIN ends e ON e.user_id = r.user_id WHERE k BETWEEN e.n - 1 - {edge} AND e.n - 2),
    {once("forth", "fed")},
    turned AS (SELECT f.user_id, e.n + {2 * edge - 1} - i AS i, y AS u FROM forth f JOIN ends e ON e.user_id = f.user_id),
    {once("back", "turned")}"""


@query(
    "steering_smoothed",
    f"""WITH RECURSIVE {WHEEL_SQL}, {_filter_sql(2.0, 10.0)}
    SELECT r.user_id, event_id, t_ns, round(y, 6) + 0.0 AS smoothed FROM rows r LEFT JOIN back b ON b.user_id = r.user_id AND r.n + {steering.EDGE_ROWS} - 1 - r.k = b.i""",
)
def steering_smoothed(spark, folder):
    out = steering.smooth_low_pass(wheel(spark, folder), ["user_id"], "angle", SLOT)
    return out.select("user_id", "event_id", "t_ns", (rounded("smoothed") + 0.0).alias("smoothed"))


@query(
    "log_time_delta",
    """WITH d AS (SELECT user_id, event_id, row_number() OVER w AS r, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT *, avg(d) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS a FROM d)
    SELECT event_id, CASE WHEN r > 30 THEN round(a, 3) END AS mean_delta_us FROM m""",
)
def log_time_delta(spark, folder):
    from driverscope.plans.standins import epoch_us

    e = table(spark, folder, "events")
    rows = e.select("user_id", "event_id", F.expr(epoch_us(e, "ts")).alias("us"))
    return rolling_step_mean(rows, ["user_id"], "us", 30, 24 * 3_600_000_000, tie="event_id").select("event_id", rounded("mean_step", 3).alias("mean_delta_us"))
