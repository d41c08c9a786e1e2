"""Chunks, chunk aggregates and normalisation over the sensor stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driverscope.operators.aggregates import aggregate_chunks, apply_normaliser, fit_normaliser, normalise_split, on_chunks
from driverscope.operators.chunks import (
    ChunkSpec,
    blocked_starts,
    chunk_recordings,
    drawn_starts,
    frame_count,
    frame_grid,
    mix,
    open_starts,
    overlap_share,
    overlapping,
    rows_in_chunks,
    rows_in_intervals,
)
from driverscope.operators.ordered import time_bin
from driverscope.plans.catalogue import query, rounded
from driverscope.plans.standins import SIGNAL_SQL, recordings, signal
from driverscope.schema import Aggregate, FeatureSpec

SECOND = 1_000_000_000
# 90 s chunks that end 30 s before the recording does, one a minute.
STUDY = ChunkSpec(strategy="end", duration=90.0, stride=60.0, end_offset=30.0, per_recording=None, fps=10)
HEAD = ChunkSpec(strategy="start", duration=60.0, stride=45.0, start_offset=-500.0, per_recording=4, fps=10)

STUDY_CHUNKS_SQL = """
grid AS (SELECT user_id, (end_time * 10 + 999999999) // 1000000000 AS n FROM recordings),
chunks AS (
  SELECT user_id, CAST(c AS BIGINT) AS chunk_number,
         (n - 1200 - 600 * c) * 1000000000 // 10 AS start_ns, (n - 1200 - 600 * c + 899) * 1000000000 // 10 AS end_ns
  FROM (SELECT user_id, n, unnest(range(greatest(0, CAST(floor((n - 1200) / 600.0) AS BIGINT) + 1))) AS c FROM grid))
"""
MEMBERS_SQL = """
members AS (SELECT s.*, c.chunk_number FROM signal s JOIN chunks c ON s.user_id = c.user_id AND s.t_ns BETWEEN c.start_ns AND c.end_ns)
"""


def members(spark: SparkSession, folder: str) -> DataFrame:
    rows = signal(spark, folder)
    return rows_in_chunks(rows, recordings(rows), STUDY, ["user_id"])


def per_chunk(spark: SparkSession, folder: str, wanted: list[Aggregate]) -> DataFrame:
    """Aggregates of every study chunk, those without rows included."""
    keys = ["user_id", "chunk_number"]
    chunks = chunk_recordings(recordings(signal(spark, folder)), STUDY, ["user_id"]).select(*keys)
    return on_chunks(chunks, [aggregate_chunks(members(spark, folder), keys, wanted, 10, order=["t_ns", "event_id"])], keys)


@query(
    "chunk_tiling_end",
    f"WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL} SELECT user_id, chunk_number, start_ns, end_ns FROM chunks",
)
def chunk_tiling_end(spark, folder):
    return chunk_recordings(recordings(signal(spark, folder)), STUDY, ["user_id"]).select(
        "user_id", "chunk_number", "start_ns", "end_ns"
    )


# Anomalies of a recording: 20 s from second 5*(user % 90), which blocks chunks covered to a tenth or more.
@query(
    "chunk_tiling_start_without_anomalies",
    f"""WITH {SIGNAL_SQL},
    grid AS (SELECT user_id, (end_time * 10 + 999999999) // 1000000000 AS n FROM recordings),
    c AS (SELECT user_id, CAST(c AS BIGINT) AS chunk_number, (n - 5000 + 450 * c) * 1000000000 // 10 AS start_ns,
                 (n - 5000 + 450 * c + 599) * 1000000000 // 10 AS end_ns
          FROM (SELECT user_id, n, unnest(range(greatest(0, least(4, CAST(floor((n - (n - 5000) - 600) / 450.0) AS BIGINT) + 1)))) AS c
                FROM grid)),
    a AS (SELECT *, (user_id % 90) * 5000000000 AS a1, (user_id % 90) * 5000000000 + 20000000000 AS a2 FROM c)
    SELECT user_id, chunk_number, start_ns, end_ns FROM a
    WHERE NOT (a1 <= end_ns AND a2 >= start_ns AND (least(a2, end_ns) - greatest(a1, start_ns))::DOUBLE / (end_ns - start_ns) >= 0.1)""",
)
def chunk_tiling_start_without_anomalies(spark, folder):
    from dataclasses import replace

    begin = (F.col("user_id") % 90) * F.lit(5 * SECOND)
    found = F.array(F.struct(begin.alias("start_ns"), (begin + F.lit(20 * SECOND)).alias("end_ns")))
    shown = recordings(signal(spark, folder)).withColumn("anomalies", found)
    spec = replace(HEAD, remove_anomalies=0.1)
    return chunk_recordings(shown, spec, ["user_id"], anomalies="anomalies").select("user_id", "chunk_number", "start_ns", "end_ns")


@query(
    "chunk_full",
    f"""WITH {SIGNAL_SQL}, grid AS (SELECT user_id, (end_time * 10 + 999999999) // 1000000000 AS n FROM recordings)
    SELECT user_id, CAST(0 AS BIGINT) AS chunk_number, CAST(2500000000 AS BIGINT) AS start_ns,
           (n - 1) * 1000000000 // 10 - CAST(round((n - 1) * 1000000000 // 10 - 600 * 1e9) AS BIGINT) AS end_ns
    FROM grid WHERE n > 0""",
)
def chunk_full(spark, folder):
    spec = ChunkSpec(strategy="full", start_offset=2.5, end_offset=-600.0, fps=10)
    return chunk_recordings(recordings(signal(spark, folder)), spec, ["user_id"]).select(
        "user_id", "chunk_number", "start_ns", "end_ns"
    )


@query(
    "chunk_random",
    f"""WITH {SIGNAL_SQL}, grid AS (SELECT user_id, (end_time + 999999999) // 1000000000 AS n FROM recordings),
    starts AS (SELECT user_id, n, f + 10 AS first FROM (SELECT user_id, n, unnest(range(greatest(0, n - 10 - 60 + 1))) AS f FROM grid)),
    timed AS (SELECT user_id, first, first * 1000000000 AS start_ns, (first + 59) * 1000000000 AS end_ns,
                     (user_id % 20) * 10000000000 AS a1, (user_id % 20) * 10000000000 + 30000000000 AS a2 FROM starts),
    open AS (SELECT *, (user_id * 100003 + first) % 2147483647 AS v FROM timed WHERE NOT (a1 <= end_ns AND a2 >= start_ns)),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY (((v * v) % 2147483647) * 48271 + v * 16807 + 42) % 2147483647, first) - 1 AS chunk_number FROM open)
    SELECT user_id, chunk_number, start_ns, end_ns FROM drawn WHERE chunk_number < 3""",
)
def chunk_random(spark, folder):
    begin = (F.col("user_id") % 20) * F.lit(10 * SECOND)
    found = F.array(F.struct(begin.alias("start_ns"), (begin + F.lit(30 * SECOND)).alias("end_ns")))
    shown = recordings(signal(spark, folder)).withColumn("anomalies", found)
    spec = ChunkSpec(strategy="random", duration=60.0, start_offset=10.0, per_recording=3, fps=1, seed=42)
    draw = mix(F.col("user_id") * 100003 + F.col("__first"), 42)
    return chunk_recordings(shown, spec, ["user_id"], anomalies="anomalies", rank=draw).select(
        "user_id", "chunk_number", "start_ns", "end_ns"
    )


@query(
    "chunk_random_drawn",
    f"""WITH {SIGNAL_SQL}, grid AS (SELECT user_id, (end_time + 999999999) // 1000000000 AS n FROM recordings),
    starts AS (SELECT user_id, f + 10 AS first FROM (SELECT user_id, unnest(range(greatest(0, n - 10 - 60 + 1))) AS f FROM grid)),
    open AS (SELECT user_id, first, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS m FROM starts
      WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0, 30), (45, 50), (200, 215)) a(b, e) WHERE ((user_id % 20) * 10 + b) * 1000000000 <= (first + 59) * 1000000000 AND ((user_id % 20) * 10 + e) * 1000000000 >= first * 1000000000)),
    j AS (SELECT user_id, m, unnest(range(m - least(m, 3), m)) AS j FROM (SELECT DISTINCT user_id, m FROM open)),
    v AS (SELECT *, (user_id * 100003 + j) % 2147483647 AS v FROM j),
    t AS (SELECT user_id, j, row_number() OVER (PARTITION BY user_id ORDER BY j) AS k, ((v * v) % 2147483647 * 48271 + v * 16807 + 42) % 2147483647 % (j + 1) AS t FROM v),
    a AS (SELECT user_id, max(t) FILTER (k = 1) AS s1, max(t) FILTER (k = 2) AS t2, max(j) FILTER (k = 2) AS j2, max(t) FILTER (k = 3) AS t3, max(j) FILTER (k = 3) AS j3 FROM t GROUP BY 1),
    b AS (SELECT *, CASE WHEN t2 = s1 THEN j2 ELSE t2 END AS s2 FROM a),
    c AS (SELECT *, CASE WHEN t3 = s1 OR t3 = s2 THEN j3 ELSE t3 END AS s3 FROM b),
    d AS (SELECT user_id, 0 AS chunk_number, s1 AS r FROM c UNION ALL SELECT user_id, 1, s2 FROM c UNION ALL SELECT user_id, 2, s3 FROM c)
    SELECT d.user_id, chunk_number, first * 1000000000 AS start_ns, (first + 59) * 1000000000 AS end_ns FROM d JOIN open o ON o.user_id = d.user_id AND o.r = d.r""",
)
def chunk_random_drawn(spark, folder):
    """Three distinct chunks of each recording's admissible starts, drawn without unfolding its frames."""
    begin = (F.col("user_id") % 20) * 10
    found = F.array(*[F.struct(((begin + a) * SECOND).alias("start_ns"), ((begin + b) * SECOND).alias("end_ns")) for a, b in ((0, 30), (45, 50), (200, 215))])
    shown = recordings(signal(spark, folder)).withColumn("anomalies", found).withColumn("__open", open_starts(blocked_starts(found, 60, 1, 0.0), F.lit(10), frame_count(F.col("start_time"), F.col("end_time"), 1) - 60))
    starts = drawn_starts(F.col("__open"), F.lit(3).cast("long"), lambda j: mix(F.col("user_id") * 100003 + j, 42))
    return shown.select("user_id", F.posexplode(starts).alias("chunk_number", "first")).select(
        "user_id", "chunk_number", (F.col("first") * SECOND).alias("start_ns"), ((F.col("first") + 59) * SECOND).alias("end_ns")
    )


@query(
    "frame_grid_60",
    f"""WITH {SIGNAL_SQL}, grid AS (SELECT user_id, (end_time * 60 + 999999999) // 1000000000 AS n FROM recordings),
    frames AS (SELECT user_id, unnest(range(n)) AS k FROM grid)
    SELECT user_id, k * 1000000000 // 60 // 60000000000 AS minute, count(*) AS frames,
           min(k * 1000000000 // 60) AS first_ns, max(k * 1000000000 // 60) AS last_ns FROM frames GROUP BY 1, 2""",
)
def frame_grid_60(spark, folder):
    frames = frame_grid(recordings(signal(spark, folder)), 60, keys=["user_id"])
    return frames.groupBy("user_id", F.expr("t_ns div 60000000000").alias("minute")).agg(
        F.count("*").alias("frames"), F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns")
    )




@query(
    "chunk_features",
    f"""WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL}, {MEMBERS_SQL},
    m AS (SELECT *, lag(y) OVER w AS p,
              last_value(flag IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
          FROM members WINDOW w AS (PARTITION BY user_id, chunk_number ORDER BY t_ns, event_id))
    SELECT user_id, chunk_number,
      CASE WHEN count(y) > 0 THEN round(avg(y), 6) END AS y__mean,
      CASE WHEN count(y) > 0 THEN round(avg(abs(y)), 6) END AS y__abs_mean,
      CASE WHEN count(y) > 0 THEN round(coalesce(avg(CASE WHEN y > 0 THEN y END), 0), 6) END AS y__pos_mean,
      CASE WHEN count(y) > 0 THEN round(coalesce(-avg(CASE WHEN y < 0 THEN y END), 0), 6) END AS y__neg_mean,
      CASE WHEN count(y) > 0 THEN round(sum(y) / (count(y) / 600.0), 6) END AS y__sum_rate,
      round(stddev_pop(y), 6) AS y__std,
      CASE WHEN count(flag) > 0 THEN round(coalesce(sum(CASE WHEN flag IS NOT NULL AND known IS NOT NULL
           THEN CAST((flag = 1) <> (known = 1) AS INT) END), 0) / (count(flag) / 600.0), 6) END AS flag__change_rate,
      CASE WHEN count(y) > 0 THEN round(coalesce(sqrt(sum((y - p) * (y - p))) / nullif(stddev_pop(y), 0), 0), 6) END AS y__cid_ce
    FROM chunks LEFT JOIN m USING (user_id, chunk_number) GROUP BY 1, 2""",
)
def chunk_features(spark, folder):
    wanted = [Aggregate(("y",), f) for f in ("mean", "abs_mean", "pos_mean", "neg_mean", "sum_rate", "std")]
    wanted += [Aggregate(("flag",), "change_rate"), Aggregate(("y",), "cid_ce")]
    out = per_chunk(spark, folder, wanted)
    return out.select("user_id", "chunk_number", *[rounded(a.output).alias(a.output) for a in wanted])


@query(
    "chunk_moments",
    f"""WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL}, {MEMBERS_SQL},
    c AS (SELECT *, y - avg(y) OVER (PARTITION BY user_id, chunk_number) AS d FROM members)
    SELECT user_id, chunk_number,
      round(CASE WHEN stddev_pop(y) > 0 THEN avg(d * d * d) / pow(avg(d * d), 1.5) END, 7) AS y__skewness,
      round(CASE WHEN stddev_pop(y) > 0 THEN avg(d * d * d * d) / pow(avg(d * d), 2) - 3 END, 7) AS y__kurtosis
    FROM chunks LEFT JOIN c USING (user_id, chunk_number) GROUP BY 1, 2""",
)
def chunk_moments(spark, folder):
    wanted = [Aggregate(("y",), "skewness"), Aggregate(("y",), "kurtosis")]
    out = per_chunk(spark, folder, wanted)
    return out.select("user_id", "chunk_number", *[rounded(a.output, 7).alias(a.output) for a in wanted])


@query(
    "chunk_pooled_columns",
    f"""WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL}, {MEMBERS_SQL},
    g AS (SELECT user_id, chunk_number, count(x) AS wx, count(y) AS wy, avg(x) AS mx, avg(y) AS my,
                 coalesce(avg(CASE WHEN x > 0 THEN x END), 0) AS px, coalesce(avg(CASE WHEN y > 0 THEN y END), 0) AS py,
                 stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM chunks LEFT JOIN members USING (user_id, chunk_number) GROUP BY 1, 2)
    SELECT user_id, chunk_number, round((wx * mx + wy * my) / nullif(wx + wy, 0), 8) AS both__mean,
           round((wx * px + wy * py) / nullif(wx + wy, 0), 8) AS both__pos_mean,
           round((wx * sx + wy * sy) / nullif(wx + wy, 0), 8) AS both__std FROM g""",
)
def chunk_pooled_columns(spark, folder):
    wanted = [Aggregate(("x", "y"), f, "both") for f in ("mean", "pos_mean", "std")]
    out = per_chunk(spark, folder, wanted)
    return out.select("user_id", "chunk_number", *[rounded(a.output, 8).alias(a.output) for a in wanted])


@query(
    "recording_features_binned",
    f"""WITH {SIGNAL_SQL},
    m AS (SELECT *, lag(y) OVER w AS p,
              last_value(flag IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
          FROM signal WINDOW w AS (PARTITION BY user_id ORDER BY t_ns, event_id))
    SELECT user_id,
      round(coalesce(sum(CASE WHEN flag IS NOT NULL AND known IS NOT NULL THEN CAST((flag = 1) <> (known = 1) AS INT) END), 0)
            / (count(flag) / 600.0), 6) AS flag__change_rate,
      round(coalesce(sqrt(sum((y - p) * (y - p))) / nullif(stddev_pop(y), 0), 0), 6) AS y__cid_ce
    FROM m GROUP BY 1 HAVING count(flag) > 0 AND count(y) > 0""",
)
def recording_features_binned(spark, folder):
    """Whole recordings have no length bound, so neighbours are found per time slot."""
    wanted = [Aggregate(("flag",), "change_rate"), Aggregate(("y",), "cid_ce")]
    out = aggregate_chunks(
        signal(spark, folder), ["user_id"], wanted, 10, order=["t_ns", "event_id"], bin=time_bin("t_ns", 60 * SECOND)
    )
    out = out.where(F.col("flag__change_rate").isNotNull() & F.col("y__cid_ce").isNotNull())
    return out.select("user_id", *[rounded(a.output).alias(a.output) for a in wanted])


def _scored(method: str):
    def run(spark, folder):
        rows = members(spark, folder)
        chunk = aggregate_chunks(rows, ["user_id", "chunk_number"], [Aggregate(("y",), "mean"), Aggregate(("x",), "mean")], 10)
        names = ["y__mean", "x__mean"]
        out = apply_normaliser(chunk, fit_normaliser(chunk, names, method, "user_id"), names, method, "user_id")
        return out.select("user_id", "chunk_number", *[rounded(n).alias(n) for n in names])

    return run


def _scored_sql(over: str) -> str:
    return f"""WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL}, {MEMBERS_SQL},
    g AS (SELECT user_id, chunk_number, avg(y) AS y__mean, avg(x) AS x__mean FROM members GROUP BY 1, 2)
    SELECT user_id, chunk_number,
      round((y__mean - avg(y__mean) OVER ({over})) / nullif(stddev_samp(y__mean) OVER ({over}), 0), 6) AS y__mean,
      round((x__mean - avg(x__mean) OVER ({over})) / nullif(stddev_samp(x__mean) OVER ({over}), 0), 6) AS x__mean FROM g"""


query("zscore_population", _scored_sql(""))(_scored("population"))
query("zscore_subject", _scored_sql("PARTITION BY user_id"))(_scored("subject"))


@query(
    "zscore_split",
    f"""WITH {SIGNAL_SQL},
    tr AS (SELECT * FROM signal WHERE user_id % 5 <> 0),
    st AS (SELECT avg(y) AS mu, stddev_samp(y) AS sd FROM tr),
    te AS (SELECT * FROM signal WHERE user_id % 5 = 0),
    own AS (SELECT user_id, avg(x) AS mu, stddev_samp(x) AS sd FROM te GROUP BY 1)
    SELECT te.event_id, round((y - st.mu) / st.sd, 6) AS y, round((x - own.mu) / nullif(own.sd, 0), 6) AS x
    FROM te CROSS JOIN st JOIN own ON te.user_id = own.user_id""",
)
def zscore_split(spark, folder):
    """Population statistics come from train; test subjects, unseen in train, get their own."""
    rows = signal(spark, folder)
    train, test = rows.where("user_id % 5 <> 0"), rows.where("user_id % 5 = 0")
    _, scored = normalise_split(train, test, ["y"], "population", "user_id")
    _, scored = normalise_split(train, scored, ["x"], "subject", "user_id")
    return scored.select("event_id", rounded("y").alias("y"), rounded("x").alias("x"))


@query(
    "chunk_anomaly_overlap",
    f"""WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL},
    a AS (SELECT user_id, event_id, t_ns AS a1, t_ns + 12000000000 AS a2 FROM signal WHERE event_type = 'error')
    SELECT c.user_id, chunk_number, event_id, round((least(a2, end_ns) - greatest(a1, start_ns))::DOUBLE / (end_ns - start_ns), 6) AS share
    FROM chunks c JOIN a ON c.user_id = a.user_id AND a1 <= end_ns AND a2 >= start_ns""",
)
def chunk_anomaly_overlap(spark, folder):
    rows = signal(spark, folder)
    found = rows.where("event_type = 'error'").select(
        "user_id", "event_id", F.col("t_ns").alias("a1"), (F.col("t_ns") + F.lit(12 * SECOND)).alias("a2")
    )
    cut = chunk_recordings(recordings(rows), STUDY, ["user_id"])
    pairs = overlapping(cut, found, ["user_id"], ("start_ns", "end_ns"), ("a1", "a2"), 60 * SECOND)
    share = overlap_share(F.col("start_ns"), F.col("end_ns"), F.col("a1"), F.col("a2"))
    return pairs.select("user_id", "chunk_number", "event_id", rounded(share).alias("share"))


@query(
    "rows_between_events",
    f"""WITH {SIGNAL_SQL},
    iv AS (SELECT user_id, event_id AS opened, t_ns AS s, t_ns + 7000000000 + user_id * 1000000 AS e FROM signal WHERE event_type = 'signup')
    SELECT opened, count(*) AS n, round(sum(y), 6) AS total FROM signal r JOIN iv ON r.user_id = iv.user_id AND t_ns >= s AND t_ns < e
    GROUP BY 1""",
)
def rows_between_events(spark, folder):
    rows = signal(spark, folder)
    spans = rows.where("event_type = 'signup'").select(
        "user_id",
        F.col("event_id").alias("opened"),
        F.col("t_ns").alias("s"),
        (F.col("t_ns") + F.lit(7 * SECOND) + F.col("user_id") * 1_000_000).alias("e"),
    )
    hits = rows_in_intervals(rows, spans, ["user_id"], "t_ns", "s", "e", 10 * SECOND, closed_end=False)
    return hits.groupBy("opened").agg(F.count("*").alias("n"), rounded(F.sum("y")).alias("total"))




# The published set on the stand-in: the signal supplies every table, at the tables' own rates.
MAIN_COLUMNS = {
    "ego_tracks": {"longitudinal_speed": "y", "longitudinal_acceleration": "x - 50"},
    "steering_reversals": {"reversals_0_5": "flag", "reversals_2_5": "1 - flag"},
    "experiment_tobii_frame": {"tobii_left_eye_pupil_diameter": "x", "tobii_right_eye_pupil_diameter": "y"},
    "gaze_pitch_yaw": {"gaze_left_pitch": "x", "gaze_right_pitch": "y", "gaze_left_yaw": "y", "gaze_right_yaw": "flag"},
    "gaze_fixation_saccade": {
        "gaze_left_saccade": "flag", "gaze_right_saccade": "1 - flag", "gaze_left_fixation": "flag", "gaze_right_fixation": "sign(y)"
    },
}


def _changes(column: str) -> str:
    known = f"last_value({column} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN {column} IS NOT NULL AND {known} IS NOT NULL THEN CAST(({column} = 1) <> ({known} = 1) AS INT) END"


@query(
    "feature_set_main",
    f"""WITH {SIGNAL_SQL},
    grid AS (SELECT user_id, (end_time * 60 + 999999999) // 1000000000 AS n FROM recordings),
    c AS (SELECT user_id, (n - 1800 - 5400) * 1000000000 // 60 AS a, (n - 1800 - 1) * 1000000000 // 60 AS b FROM grid WHERE n >= 7200),
    m0 AS (SELECT s.*, sign(y) AS sy FROM signal s JOIN c ON s.user_id = c.user_id AND t_ns BETWEEN a AND b),
    m AS (SELECT *, {_changes('flag')} AS cf, {_changes('sy')} AS cs FROM m0),
    g AS (SELECT user_id, count(x) AS wx, count(y) AS wy, count(flag) AS wf, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(flag) AS sf,
      avg(CASE WHEN y > 0 THEN y END) AS py, avg(CASE WHEN x > 50 THEN x - 50 END) AS pa, -avg(CASE WHEN x < 50 THEN x - 50 END) AS na,
      sum(flag) / (count(flag) / 600.0::DOUBLE) AS r1, sum(1 - flag) / (count(flag) / 600.0::DOUBLE) AS r2,
      coalesce(sum(cf), 0) / (count(flag) / 3600.0::DOUBLE) AS kf, coalesce(sum(cs), 0) / (count(y) / 3600.0::DOUBLE) AS ks FROM m GROUP BY 1)
    SELECT user_id, CAST(0 AS BIGINT) AS chunk_number, CASE WHEN wy > 0 THEN round(coalesce(py, 0), 6) END AS longitudinal_speed__pos_mean,
      CASE WHEN wx > 0 THEN round(coalesce(pa, 0), 6) END AS longitudinal_acceleration__pos_mean, CASE WHEN wx > 0 THEN round(coalesce(na, 0), 6) END AS longitudinal_acceleration__neg_mean,
      CASE WHEN wf > 0 THEN round(r1, 6) END AS reversals_0_5__sum_rate, CASE WHEN wf > 0 THEN round(r2, 6) END AS reversals_2_5__sum_rate,
      CASE WHEN wx > 0 AND wy > 0 THEN round((wx * mx + wy * my) / (wx + wy), 6) END AS tobii_eye_pupil_diameter__mean,
      CASE WHEN wx > 0 AND wy > 0 THEN round((wx * sx + wy * sy) / (wx + wy), 6) END AS gaze_pitch__std, CASE WHEN wf > 0 AND wy > 0 THEN round((wy * sy + wf * sf) / (wy + wf), 6) END AS gaze_yaw__std,
      CASE WHEN wf > 0 THEN round(kf, 6) END AS gaze_saccade__change_rate, CASE WHEN wf > 0 AND wy > 0 THEN round((wf * kf + wy * ks) / (wf + wy), 6) END AS gaze_fixation__change_rate
    FROM c LEFT JOIN g USING (user_id)""",
)
def feature_set_main(spark, folder):
    from driverscope.plans.feature_set import feature_set

    rows = signal(spark, folder)
    tables = {
        name: rows.select("user_id", "event_id", "t_ns", *[F.expr(e).cast("double").alias(c) for c, e in columns.items()])
        for name, columns in MAIN_COLUMNS.items()
    }
    out = feature_set(tables, recordings(rows), ["user_id"], time="t_ns", order=["t_ns", "event_id"])
    names = [c for c in out.columns if "__" in c]
    return out.select("user_id", "chunk_number", *[rounded(c).alias(c) for c in names])


@query(
    "feature_set_normalised",
    f"""WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL}, {MEMBERS_SQL},
    z AS (SELECT user_id, chunk_number, (y - avg(y) OVER u) / nullif(stddev_samp(y) OVER u, 0) AS zy FROM members WINDOW u AS (PARTITION BY user_id)),
    a AS (SELECT user_id, chunk_number, avg(abs(zy)) AS m, stddev_pop(zy) AS s FROM z GROUP BY 1, 2),
    p AS (SELECT avg(m) AS mm, stddev_samp(m) AS ms, avg(s) AS sm, stddev_samp(s) AS ss FROM a WHERE user_id % 3 <> 0)
    SELECT user_id, chunk_number, round((m - mm) / nullif(ms, 0), 6) AS y__abs_mean, round((s - sm) / nullif(ss, 0), 6) AS y__std
    FROM chunks LEFT JOIN a USING (user_id, chunk_number) CROSS JOIN p""",
)
def feature_set_normalised(spark, folder):
    """Rows as z-scores of their subject, aggregates as z-scores of the training subjects (two thirds)."""
    from driverscope.plans.feature_set import feature_set

    rows = signal(spark, folder)
    wanted = (Aggregate(("y",), "abs_mean"), Aggregate(("y",), "std"))
    spec = FeatureSpec("signal", "signal", 10, aggregates=wanted, normalize="subject", normalize_aggregate="population")
    out = feature_set({"signal": rows}, recordings(rows), ["user_id"], [spec], STUDY, time="t_ns", subject="user_id", train=F.col("user_id") % 3 != 0)
    return out.select("user_id", "chunk_number", *[rounded(a.output).alias(a.output) for a in wanted])
