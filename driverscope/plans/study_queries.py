"""The study's own file layout: written from the tables, read back through the readers; stored and ordered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverscope.operators import chunks, collate, folds, stats, steering
from driverscope.operators.aggregates import aggregate_chunks
from driverscope.operators.timing import renumber_frames
from driverscope.plans import reports
from driverscope.plans.catalogue import query, rounded, table
from driverscope.plans.chunk_queries import MEMBERS_SQL, STUDY, STUDY_CHUNKS_SQL
from driverscope.plans.motion_queries import KEYS, least_squares_sql, split
from driverscope.plans.score_queries import PAIRS_SQL, RESULT_CELLS
from driverscope.plans.standins import INDEX_SQL, PREDICTIONS_SQL, SIGNAL_SQL, predictions, raw_scenarios, recordings, signal
from driverscope.schema import TIME, Aggregate, FeatureSpec
from driverscope.session import scratch_path
from driverscope.sources import recordings as files, sinks

SECOND = 1_000_000_000
ROOT = "Resampled/Participants"


def export(df, root, file, columns, order):
    """Write the files now; they have as many rows as the table."""
    sinks.export_tree(df, root, file, columns, order).agg(F.sum("rows")).first()


def user_place(name: str):
    """A recording's file: seven participants, two rounds, the user as scenario."""
    user = F.col("user_id")
    return F.format_string(f"P%s/R%s/driving/u%s/no_task/{name}", user % 7, user % 2 + 1, user)


def user_of(scenario="scenario"):
    return F.substring(scenario, 2, 20).cast("long").alias("user_id")


def timed(spark, folder):
    return renumber_frames(signal(spark, folder), ["user_id"], "t_ns", 60 * SECOND).withColumnRenamed("t_ns", TIME)


FRAMES_SQL = f"{SIGNAL_SQL}, timed AS (SELECT user_id, t_ns, x, y, row_number() OVER (PARTITION BY user_id ORDER BY t_ns) - 1 AS frame FROM signal)"


@query(
    "scan_frame_timing",
    f"WITH {FRAMES_SQL} SELECT user_id, 'P' || (user_id % 7) AS participant_name, count(*) AS n, CAST(sum(t_ns // 1000) AS BIGINT) AS us, CAST(sum(frame * (t_ns // 1000 % 1000)) AS BIGINT) AS weighed FROM timed GROUP BY user_id",
)
def scan_frame_timing(spark, folder):
    """Frame timings of all recordings as files with one video beside each, read back as one table."""
    base = scratch_path(spark, "timing")
    rows = timed(spark, folder)
    export(rows, f"{base}/{ROOT}", user_place("front/frame_timing.csv"), [TIME, "resampled_frame"], [TIME])
    export(rows.select("user_id").distinct(), f"{base}/{ROOT}", user_place("front/video.mp4"), ["user_id"], [])
    back = files.scan_frame_timing(spark, base, "Resampled", "front", one_video=True)
    return back.groupBy(user_of(), "participant_name").agg(
        F.count("*").alias("n"),
        F.sum(F.expr(f"{TIME} div 1000")).alias("us"),
        F.sum(F.col("resampled_frame").cast("long") * F.expr(f"{TIME} div 1000 % 1000")).alias("weighed"),
    )


@query(
    "scan_feature_of_participants",
    f"""WITH {SIGNAL_SQL} SELECT user_id, t_ns, round(x, 6) AS gaze_x FROM signal WHERE user_id % 7 IN (2, 5) AND user_id % 2 = 1""",
)
def scan_feature_of_participants(spark, folder):
    """Two participants' second rounds: the filter decides which directories are listed and read."""
    base = scratch_path(spark, "pruned")
    rows = signal(spark, folder).select("user_id", F.col("t_ns").alias(TIME), F.coalesce(F.col("x").cast("string"), F.lit("NaN")).alias("gaze x"))
    export(rows, f"{base}/{ROOT}", user_place("gaze.csv"), [TIME, "gaze x"], [TIME])
    spec = FeatureSpec("gaze", "Resampled", 10, aggregates=(Aggregate(("gaze_x",), "mean"),))
    found = files.scan_feature(spark, base, spec, participants=["P2", "P5"]).where(F.col("round") == "R2")
    return found.select(user_of(), F.col(TIME).alias("t_ns"), rounded("gaze_x").alias("gaze_x"))


SHEET = files.ANNOTATED_SCENARIOS
SHEET_SQL = f"""{INDEX_SQL}, cells AS (
  SELECT participant_name, scenario_index % 8 AS place, arg_max(anomaly_cell, scenario_index) AS a, arg_max(hazard_cell, scenario_index) AS h, arg_max(crash_cell, scenario_index) AS c, max(scenario_index) AS s
  FROM scenarios GROUP BY 1, 2),
people8 AS (SELECT DISTINCT participant_name FROM scenarios),
sheet AS (SELECT p.participant_name, k.place, cells.* EXCLUDE (participant_name, place) FROM people8 p CROSS JOIN (SELECT unnest(range(8)) AS place) k LEFT JOIN cells ON cells.participant_name = p.participant_name AND cells.place = k.place)"""


@query(
    "scan_annotations",
    f"""WITH {SHEET_SQL} SELECT participant_name, (ARRAY{SHEET!r})[place + 1] AS scenario_short,
      CASE WHEN s % 4 = 0 THEN [s % 40, s % 40 + 7, s % 40 + 60, s % 40 + 64] ELSE [] END AS seconds,
      CASE WHEN s % 7 = 0 THEN -1 WHEN s % 7 = 1 THEN 1 ELSE 0 END AS outcome,
      CASE s % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 0 END AS crashes FROM sheet""",
)
def scan_annotations(spark, folder):
    """One sheet with two header rows and three blocks of eight scenarios, a line per participant."""
    path = scratch_path(spark, "sheet")
    latest = raw_scenarios(spark, folder).groupBy("participant_name", (F.col("scenario_index") % 8).alias("place")).agg(
        *[F.max_by(f"{kind}_cell", "scenario_index").alias(kind) for kind in ("anomaly", "hazard", "crash")]
    )
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    blocks = [F.max(F.when(F.col("place") == k, F.col(kind))) for kind in ("anomaly", "hazard", "crash") for k in range(8)]
    lines = latest.groupBy("participant_name").agg(F.concat_ws(",", "participant_name", *[quoted(b) for b in blocks]).alias("line"))
    head = spark.createDataFrame([(0, "Participant" + ",x" * 24), (1, "P" + ",y" * 24)], "at int, line string")
    # the study's sheet is one file, a line per participant
    sheet = head.unionByName(lines.select(F.lit(2).alias("at"), "line")).repartitionByRange(1, "at").sortWithinPartitions("at", "line")
    sheet.select("line").write.text(path)
    found = files.scan_annotations(spark, path)
    seconds = F.flatten(F.transform("anomalies", lambda i: F.array((i["start_ns"] / SECOND).cast("long"), (i["end_ns"] / SECOND).cast("long"))))
    return found.select("participant_name", "scenario_short", seconds.alias("seconds"), F.col("number_hazard_crashes").alias("outcome"), F.col("number_all_crashes").alias("crashes"))


@query(
    "scan_schedules",
    """SELECT l_linenumber AS pattern, l_orderkey + l_partkey / 100.0::DOUBLE AS startime, l_suppkey % 10 + 0.0::DOUBLE AS digit, count(*) AS n FROM lineitem WHERE l_linenumber <= 8 GROUP BY 1, 2, 3""",
)
def scan_schedules(spark, folder):
    """Answer schedules, one file per pattern."""
    base = scratch_path(spark, "schedules")
    lines = table(spark, folder, "lineitem").select(
        "l_linenumber", (F.col("l_orderkey") + F.col("l_partkey") / 100.0).alias("startime"), (F.col("l_suppkey") % 10).alias("digit")
    )
    export(lines, base, F.format_string("nback/nback_every2.5_pttn%s.csv", "l_linenumber"), ["startime", "digit"], ["startime"])
    back = files.scan_schedules(spark, base, "nback_task")
    return back.groupBy(F.col("pattern").cast("long").alias("pattern"), "startime", "digit").agg(F.count("*").alias("n"))


@query(
    "find_recordings",
    """WITH l AS (SELECT o_orderkey, o_custkey, lower(substr(o_orderpriority, 3)) AS scenario, o_orderkey % 2 + 1 AS round, CASE o_orderstatus WHEN 'O' THEN 'no_task' ELSE 'nback_task' END AS task FROM orders WHERE o_orderkey % 11 <> 0),
    w AS (SELECT c_custkey, s.scenario, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 2 % 2 + 1 END AS round, CASE WHEN c_custkey % 3 = 0 THEN 'no_task' END AS task FROM customer CROSS JOIN (VALUES ('urg'), ('hi'), ('not')) s(scenario))
    SELECT w.c_custkey, w.scenario, min(l.o_orderkey) AS o_orderkey FROM w JOIN l ON l.o_custkey = w.c_custkey AND starts_with(l.scenario, w.scenario)
      AND (w.round IS NULL OR w.round = l.round) AND (w.task IS NULL OR w.task = l.task) GROUP BY 1, 2 HAVING count(*) = 1""",
)
def find_recordings(spark, folder):
    """For every participant and wanted scenario the one file that matches; none or several give no row."""
    from driverscope.plans.file_queries import order_paths

    listing = order_paths(spark, folder)
    c = F.col("c_custkey")
    wanted = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("P"), c.cast("string")).alias("participant_name"),
        F.explode(F.array(F.lit("urg"), F.lit("hi"), F.lit("not"))).alias("scenario"),
        F.when(c % 2 == 0, F.expr("c_custkey div 2 % 2 + 1").cast("int")).alias("round"),
        F.when(c % 3 == 0, "no_task").alias("task"),
    )
    return files.find_each(listing, wanted, "headphone_audio.mp3").select("c_custkey", "scenario", "o_orderkey")


@query(
    "scenario_timings",
    """SELECT 'P' || CAST(c_nationkey AS VARCHAR) AS participant_name, o_orderpriority AS scenario, o_orderkey AS entry, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice, 2) END AS seconds
    FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def scenario_timings(spark, folder):
    """Timing tables, one per participant directory, with names in quotes and missing cells."""
    base = scratch_path(spark, "timings")
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    price = F.format_string("%.2f", F.col("o_totalprice").cast("double"))
    out = rows.select("c_nationkey", F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("scenario, name"), F.when(F.col("o_orderkey") % 4 > 0, price).alias("seconds"))
    export(out, base, F.format_string("P%s/key_scenario_timings.csv", "c_nationkey"), ["scenario, name", "seconds", "entry"], ["entry"])
    back = files.read_scenario_tables(spark, base, numbers=["seconds"])
    return back.select("participant_name", F.col("`scenario, name`").alias("scenario"), F.col("entry").cast("long").alias("entry"), "seconds")


@query(
    "save_and_load_tabular",
    f"WITH {FRAMES_SQL} SELECT user_id, frame * 100000000 AS resampled_epoch_ns, round(x, 6) AS x FROM timed",
)
def save_and_load_tabular(spark, folder):
    """Frame tables checked against their grids, written aside, moved into place, read back."""
    path = scratch_path(spark, "tabular")
    rows = timed(spark, folder).select("user_id", (F.col("resampled_frame") * 100_000_000).cast("long").alias(TIME), "x")
    grid = signal(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))
    sinks.save_tabular(rows, grid, path, ["user_id"])
    return spark.read.parquet(path).select("user_id", TIME, rounded("x").alias("x"))


@query("written_order", f"WITH {SIGNAL_SQL} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS overlaps FROM signal")
def written_order(spark, folder):
    """Rows that come before a smaller one in their file, and files whose ranges overlap: a sorted table has none."""
    path = scratch_path(spark, "ordered")
    rows = signal(spark, folder).select("user_id", F.col("t_ns").alias(TIME), "event_id")
    sinks.sort_for_reading(rows, ["user_id", TIME, "event_id"]).write.parquet(path)
    return sinks.order_violations(spark.read.parquet(path), ["user_id", TIME, "event_id"])


@query("permuted_rows", "SELECT o_orderkey, o_custkey FROM orders")
def permuted_rows(spark, folder):
    """A random order of all rows, kept row for row."""
    return folds.permute(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(
    "missing_folds",
    f"WITH {PREDICTIONS_SQL} SELECT CAST(f AS INT) AS fold FROM (SELECT unnest(range(8)) AS f) WHERE f NOT IN (SELECT fold FROM predictions)",
)
def missing_folds(spark, folder):
    results = predictions(spark, folder).groupBy(F.col("fold").cast("int").alias("fold")).agg(F.avg("prob").alias("uar"))
    return reports.missing_folds(results, 8)


@query("ego_with_kinematics", least_squares_sql("recording, t_ns, pose_z"))
def ego_with_kinematics(spark, folder):
    """Ego rows with the derivatives of their weighted cubic; the SQL writes out its normal equations."""
    ego, _, _ = split(spark, folder)
    out = steering.with_kinematics(ego.drop("yaw"), KEYS, smoothing=False)
    return out.select("recording", "t_ns", "pose_z", rounded("yaw").alias("yaw"), *[(rounded(c, 4) + 0.0).alias(c) for c in steering.KINEMATICS])


@query(
    "collate_frame_timing",
    f"""WITH {FRAMES_SQL}, c AS (SELECT user_id, frame // 12 AS chunk, frame, frame - min(frame) OVER (PARTITION BY user_id, frame // 12) AS frame_in_chunk, t_ns FROM timed),
    cells AS (SELECT k.user_id, k.chunk, g AS frame, c.frame AS f, c.frame_in_chunk AS p, c.t_ns AS t FROM (SELECT DISTINCT user_id, chunk FROM c) k CROSS JOIN (SELECT unnest(range(12)) AS g) LEFT JOIN c ON c.user_id = k.user_id AND c.chunk = k.chunk AND c.frame_in_chunk = g)
    SELECT user_id, chunk, frame, coalesce(f, 0) + 0.0::DOUBLE AS resampled_frame, coalesce(p, 0) + 0.0::DOUBLE AS frame_in_chunk, coalesce(t, 0) + 0.0::DOUBLE AS at, CAST(f IS NOT NULL AS INT) AS valid FROM cells""",
)
def collate_frame_timing(spark, folder):
    """Timing tables of twelve-frame chunks with the frame's place in its chunk, every value and its validity."""
    rows = timed(spark, folder).withColumn("chunk", F.floor(F.col("resampled_frame") / 12))
    out = collate.collate_frame_timing(rows, rows.select("user_id", "chunk").distinct(), ["user_id", "chunk"], ["resampled_frame", TIME], 12)
    cells = out.select("user_id", "chunk", F.posexplode(F.arrays_zip("timing", "timing_valid")).alias("frame", "cell"))
    return cells.select(
        "user_id",
        "chunk",
        F.col("frame").cast("long").alias("frame"),
        F.col("cell.timing")[0].alias("resampled_frame"),
        F.col("cell.timing")[2].alias("frame_in_chunk"),
        F.col("cell.timing")[1].alias("at"),
        F.array_min("cell.timing_valid").alias("valid"),
    )


@query(
    "collate_nested_arrays",
    """WITH e AS (SELECT vec_id, label, embedding FROM embeddings), k AS (SELECT vec_id, unnest(range(16)) AS i FROM e)
    SELECT k.vec_id, i // 4 AS frame, i // 2 % 2 AS r, i % 2 AS c, CASE WHEN label < 8 THEN CAST(embedding[4 * (i // 4 + label) + i % 4 + 1] AS DOUBLE) ELSE -1.0 END AS value,
      CAST(label < 8 AS INT) AS valid, CASE WHEN label < 8 THEN label ELSE 9 END AS kind FROM k JOIN e USING (vec_id)""",
)
def collate_nested_arrays(spark, folder):
    """Sixteen entries of four values, cut to the chunk's four times and shaped 2 x 2, and a fixed value; every number."""
    e = table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4)).alias("v"),
        F.array("label").alias("kind"),
        F.sequence(F.lit(0), F.lit(15)).alias("times"),
    )
    shapes = {"v": collate.ArrayShape((2, 2), "double", -1.0), "kind": collate.ArrayShape((1,), "int", 9, temporal=False)}
    spans = e.select("vec_id", F.col("label").alias("start"), (F.col("label") + 3).alias("end"))
    out = collate.collate_arrays(e.where("label < 8").drop("label"), spans, ["vec_id"], shapes, 4, "start", "end")
    frames = out.select("vec_id", F.col("kind")[0].alias("kind"), F.col("v_valid").alias("valid"), F.posexplode("v").alias("frame", "v"))
    rows = frames.select("vec_id", "kind", "valid", F.col("frame").cast("long").alias("frame"), F.posexplode("v").alias("r", "v"))
    return rows.select("vec_id", "kind", "valid", "frame", F.col("r").cast("long").alias("r"), F.posexplode("v").alias("c", "value")).withColumn("c", F.col("c").cast("long"))


# The whole feature test: recordings with conditions, study chunks, features per chunk, participant means, paired tests, one table.
TEST_FEATURES = [Aggregate(("y",), "mean"), Aggregate(("y",), "abs_mean"), Aggregate(("x",), "std")]
_NAMES = [a.output for a in TEST_FEATURES]
PEOPLE_SQL = """people AS (SELECT user_id, 'P' || (user_id % 23) AS participant_name, 1 + user_id // 12 % 5 // 4 AS experiment_version, user_id // 2 % 2 = 1 AS i, user_id // 4 % 2 = 1 AS cd FROM recordings)"""
FEATURE_TEST_SQL = f"""WITH {SIGNAL_SQL}, {STUDY_CHUNKS_SQL}, {MEMBERS_SQL}, {PEOPLE_SQL},
features AS (SELECT user_id, chunk_number, avg(y) AS y__mean, avg(abs(y)) AS y__abs_mean, stddev_pop(x) AS x__std FROM chunks LEFT JOIN members USING (user_id, chunk_number) GROUP BY 1, 2),
rows0 AS (SELECT k AS condition, CASE k WHEN 'cd' THEN cd ELSE i END AS side, participant_name, {', '.join(_NAMES)} FROM features JOIN people USING (user_id), (VALUES ('intoxicated'), ('cd'), ('joint')) x(k)
  WHERE CASE k WHEN 'intoxicated' THEN experiment_version = 1 AND NOT cd WHEN 'cd' THEN NOT i ELSE experiment_version = 1 AND i = cd END),
pairs AS (SELECT condition, feature, participant_name, avg(v) FILTER (NOT side) AS baseline, avg(v) FILTER (side) AS impaired
  FROM rows0 CROSS JOIN LATERAL (VALUES {', '.join(f"('{n}', {n})" for n in _NAMES)}) f(feature, v)
  GROUP BY 1, 2, 3 HAVING count(*) FILTER (side) > 0 AND count(*) FILTER (NOT side) > 0),
{PAIRS_SQL[PAIRS_SQL.index('diffs AS'):]}, whole AS (SELECT condition, feature FROM diffs GROUP BY 1, 2 HAVING count(d) = count(*)),
kept AS (SELECT t.condition, t.feature, n, CASE WHEN w.feature IS NOT NULL THEN mean_diff END AS mean_diff, CASE WHEN w.feature IS NOT NULL THEN z END AS z
  FROM tests t LEFT JOIN whole w ON w.condition = t.condition AND w.feature = t.feature)
"""


def people_of(rows):
    user = F.col("user_id")
    return rows.select(
        "user_id",
        "start_time",
        "end_time",
        F.concat(F.lit("P"), (user % 23).cast("string")).alias("participant_name"),
        F.expr("1 + user_id div 12 % 5 div 4").alias("experiment_version"),
        (F.expr("user_id div 2") % 2 == 1).alias("intoxicated"),
        (F.expr("user_id div 4") % 2 == 1).alias("cd"),
    )


@query("feature_test_table", FEATURE_TEST_SQL + f"SELECT feature, {RESULT_CELLS} FROM kept GROUP BY 1")
def feature_test_table(spark, folder):
    rows = signal(spark, folder)
    index = people_of(recordings(rows))
    keys = ["user_id", "chunk_number"]
    cut = chunks.chunk_recordings(index, STUDY, ["user_id"]).select(*keys, "participant_name", "experiment_version", "intoxicated", "cd")
    inside = chunks.rows_in_chunks(rows, index.select("user_id", "start_time", "end_time"), STUDY, ["user_id"])
    features = aggregate_chunks(inside, keys, TEST_FEATURES, 10, order=["t_ns", "event_id"])
    means = stats.paired_means(stats.condition_rows(cut.join(features, keys, "left")), _NAMES, drop_unpaired=True)
    wide = stats.result_table(stats.signed_rank(means, ["condition", "feature"]))
    return wide.withColumns({c: rounded(c) for c in wide.columns if c != "feature" and not c.endswith("significant")})
