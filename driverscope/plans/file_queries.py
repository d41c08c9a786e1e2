"""Readers and writers on files that Spark derives from the tables, and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverscope.operators.chunks import frame_count
from driverscope.operators.index import frames_with_timing, require_one, with_conditions
from driverscope.operators.timing import renumber_frames
from driverscope.plans import reports
from driverscope.plans.catalogue import query, rounded, table
from driverscope.plans.standins import INDEX_SQL, PREDICTIONS_SQL, SIGNAL_SQL, TRACKS_SQL, actors, predictions, raw_scenarios, recordings, signal, tracks
from driverscope.schema import TIME, Aggregate, FeatureSpec
from driverscope.session import scratch_path
from driverscope.sources import logs, recordings as files, sinks

SECOND = 1_000_000_000
# Written index: the customer's nation stands for the participant, so the tree has 25 directories.
WRITTEN_SQL = f"""{INDEX_SQL},
written AS (SELECT s.*, 'P' || CAST(c_nationkey AS VARCHAR) AS person FROM scenarios s JOIN customer c ON c.c_custkey = s.c_custkey)
"""


@query(
    "scan_scenario_index",
    f"""WITH {WRITTEN_SQL} SELECT person AS participant_name, round, count(*) AS n, CAST(sum(scenario_index) AS BIGINT) AS total, round(sum(duration_ds / 10.0::DOUBLE), 4) AS seconds,
      count(*) FILTER (round = 'R2') AS intoxicated FROM written GROUP BY 1, 2""",
)
def scan_scenario_index(spark, folder):
    """Write one index per participant directory, read the tree back."""
    base = scratch_path(spark, "index")
    nations = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("participant_name"))
    raw = raw_scenarios(spark, folder).drop("participant_name").join(nations, "c_custkey")
    written = raw.select(
        "scenario_index",
        "scenario_name",
        F.concat("round", F.lit("/"), "scenario_name").alias("scenario_path"),
        "round",
        "cognitive_task",
        F.lit(0).cast("long").alias("start_time"),
        (F.col("duration_ds") * 100_000_000).alias("end_time"),
        (F.col("duration_ds") / 10.0).alias("duration_s"),
        F.col("duration_ds").alias("duration_frames"),
        "participant_name",
        F.lit("scenario_index.csv").alias("file"),
    )
    spread = written.repartitionByRange("participant_name", "scenario_index")
    spread.write.partitionBy("participant_name", "file").option("header", True).csv(f"{base}/Resampled/Participants")
    index = with_conditions(files.scan_scenario_index(spark, base, "Resampled", "file=scenario_index.csv"))
    return index.groupBy("participant_name", "round").agg(
        F.count("*").alias("n"),
        F.sum("scenario_index").alias("total"),
        rounded(F.sum("duration_s"), 4).alias("seconds"),
        F.count_if("intoxicated").alias("intoxicated"),
    )


PATH_SQL = """
paths AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Clean/broken' ELSE 'Clean/Participants/P' || CAST(o_custkey AS VARCHAR) || '/R' || CAST(o_orderkey % 2 + 1 AS VARCHAR)
  || '/driving/' || lower(substr(o_orderpriority, 3)) || '/' || CASE o_orderstatus WHEN 'O' THEN 'no_task' ELSE 'nback_task' END || '/headphone_audio.mp3' END AS path FROM orders)
"""


def order_paths(spark, folder):
    key = F.col("o_orderkey")
    good = F.concat(
        F.lit("Clean/Participants/P"), F.col("o_custkey").cast("string"), F.lit("/R"), (key % 2 + 1).cast("string"), F.lit("/driving/"),
        F.lower(F.expr("substring(o_orderpriority, 3)")), F.lit("/"), F.when(F.col("o_orderstatus") == "O", "no_task").otherwise("nback_task"), F.lit("/headphone_audio.mp3"),
    )
    return table(spark, folder, "orders").select("o_orderkey", F.when(key % 11 == 0, "Clean/broken").otherwise(good).alias("path"))


@query(
    "recording_paths",
    f"""WITH {PATH_SQL} SELECT o_orderkey, string_split(path, '/')[3] AS participant_name, string_split(path, '/')[4] AS round, string_split(path, '/')[5] AS section,
      string_split(path, '/')[6] AS scenario, string_split(path, '/')[7] AS task FROM paths WHERE path LIKE '%Participants%'""",
)
def recording_paths(spark, folder):
    return files.parse_recording_paths(order_paths(spark, folder), "path").drop("path")


@query(
    "recordings_found_once",
    """SELECT o_orderkey FROM orders o WHERE (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority) = 1""",
)
def recordings_found_once(spark, folder):
    return require_one(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"]).select("o_orderkey")


@query(
    "participants_of_version",
    f"WITH {INDEX_SQL} SELECT DISTINCT participant_name FROM scenarios WHERE participant_name LIKE '72%'",
)
def participants_of_version(spark, folder):
    return files.list_participants(raw_scenarios(spark, folder), "v2")


@query(
    "fallback_recordings",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS is_raw FROM orders)
    SELECT o_orderkey FROM r WHERE NOT is_raw OR NOT EXISTS (SELECT 1 FROM r d WHERE d.o_custkey = r.o_custkey AND NOT d.is_raw)""",
)
def fallback_recordings(spark, folder):
    o = table(spark, folder, "orders")
    path = F.concat(F.lit("a/"), F.when(F.col("o_orderstatus") == "P", "sim_bag/").otherwise(""), F.lit("x.csv"))
    return files.prefer_primary(o.select("o_custkey", "o_orderkey", path.alias("__path")), ["o_custkey"]).select("o_orderkey")


@query(
    "scan_feature",
    f"""WITH {SIGNAL_SQL} SELECT user_id, count(*) AS n, count(x) AS seen, round(sum(x), 4) AS total, max(t_ns) AS last_ns FROM signal GROUP BY 1""",
)
def scan_feature(spark, folder):
    """Write the sensor rows as CSV with NaN for missing, read them back as a feature."""
    base = scratch_path(spark, "feature")
    rows = signal(spark, folder).select(
        F.col("t_ns").alias(TIME), F.coalesce(F.col("x").cast("string"), F.lit("NaN")).alias("gaze x"), F.col("user_id").cast("double").alias("person id")
    )
    target = f"{base}/Resampled/Participants/P1/R1/driving/1a/no_task"
    rows.write.option("header", True).csv(target)
    spec = FeatureSpec("gaze", "Resampled", 10, file_name="*", aggregates=(Aggregate(("gaze_x",), "mean"), Aggregate(("person_id",), "mean")))
    found = files.scan_feature(spark, base, spec)
    return found.groupBy(F.col("person_id").cast("long").alias("user_id")).agg(
        F.count("*").alias("n"), F.count("gaze_x").alias("seen"), rounded(F.sum("gaze_x"), 4).alias("total"), F.max(TIME).alias("last_ns")
    )


@query(
    "scan_feature_mixed_headers",
    f"""WITH {SIGNAL_SQL} SELECT user_id, count(*) AS n, round(sum(x), 4) AS total, round(sum(CASE WHEN user_id % 2 = 1 THEN y END), 4) AS other, max(t_ns) AS last_ns FROM signal GROUP BY 1""",
)
def scan_feature_mixed_headers(spark, folder):
    """Two participants' files with columns in another order, one of them without a column."""
    base = scratch_path(spark, "mixed")
    time, x, who, odd = F.col("t_ns").alias(TIME), F.col("x").alias("gaze x"), F.col("user_id").cast("double").alias("person id"), F.col("user_id") % 2 == 1
    for name, part, columns in (("P1", ~odd, [time, x, who]), ("P2", odd, [who, F.col("y").alias("gaze y"), x, time])):
        rows = signal(spark, folder).where(part).select(*columns)
        rows.write.option("header", True).csv(f"{base}/Resampled/Participants/{name}/R1/driving/1a/no_task")
    spec = FeatureSpec("gaze", "Resampled", 10, file_name="*", columns=("gaze_x", "gaze_y", "person_id"))
    found = files.scan_feature(spark, base, spec)
    return found.groupBy(F.col("person_id").cast("long").alias("user_id")).agg(
        F.count("*").alias("n"), rounded(F.sum("gaze_x"), 4).alias("total"), rounded(F.sum("gaze_y"), 4).alias("other"), F.max(TIME).alias("last_ns")
    )


@query(
    "save_and_load_attributes",
    f"WITH {TRACKS_SQL} SELECT recording, object_id, role, actor_type, end_epoch_ns - start_epoch_ns AS span FROM actors",
)
def save_and_load_attributes(spark, folder):
    """Object attributes through the writer and back."""
    path = scratch_path(spark, "attributes")
    sinks.save_object_attributes(actors(tracks(spark, folder)), path, ["recording"])
    back = spark.read.parquet(path)
    return back.select("recording", "object_id", "role", "actor_type", (F.col("end_epoch_ns") - F.col("start_epoch_ns")).alias("span"))


@query(
    "save_and_load_arrays",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS n, label, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * embedding[i]::DOUBLE)), 4) AS weighed FROM embeddings""",
)
def save_and_load_arrays(spark, folder):
    """Whole arrays through the writer and back; the weighed sum depends on every entry and its place."""
    path = scratch_path(spark, "arrays")
    e = table(spark, folder, "embeddings").select("vec_id", "embedding", F.array("label").alias("label"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("times"))
    sinks.save_array_dict(e, ["embedding", "label"], path)
    back = files.scan_array_dict(spark, path)
    weighed = F.aggregate(F.transform("embedding", lambda v, i: (i + 1) * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return back.select("vec_id", F.size("embedding").alias("n"), F.col("label")[0].alias("label"), rounded(weighed, 4).alias("weighed"))


@query(
    "scan_folds",
    f"WITH {INDEX_SQL} SELECT DISTINCT participant_name, CAST(fold AS INT) AS fold FROM people",
)
def scan_folds(spark, folder):
    """One line of participants per fold, written and read back."""
    path = scratch_path(spark, "fold-file")
    people = table(spark, folder, "customer").select(
        (F.col("c_custkey") % 6).alias("fold"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "P").otherwise("72"), F.col("c_custkey").cast("string")).alias("name")
    )
    lines = people.groupBy("fold").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("line"))
    # the study's fold file is one small file, a line per fold
    lines.repartitionByRange(1, "fold").sortWithinPartitions("fold").select("line").write.text(path)
    return files.scan_folds(spark, path)


@query(
    "grid_length_violations",
    f"""WITH {SIGNAL_SQL}, c AS (SELECT user_id, count(*) AS rows FROM signal GROUP BY 1)
    SELECT r.user_id, (end_time + 9999999999) // 10000000000 AS frames, rows FROM recordings r JOIN c ON r.user_id = c.user_id WHERE (end_time + 9999999999) // 10000000000 <> rows""",
)
def grid_length_violations(spark, folder):
    rows = signal(spark, folder)
    grid = recordings(rows).select("user_id", F.ceil(F.col("end_time") / (10 * SECOND)).alias("frames"))
    return sinks.length_violations(rows, grid, ["user_id"])


@query(
    "save_and_load_tracks",
    f"WITH {TRACKS_SQL} SELECT recording % 8 AS part, count(*) AS n, CAST(sum(t_ns // 1000000000) AS BIGINT) AS t, CAST(sum(object_id) AS BIGINT) AS o, round(sum(pose_x), 4) AS x FROM tracks GROUP BY 1",
)
def save_and_load_tracks(spark, folder):
    """Object tracks through the writer and back."""
    path = scratch_path(spark, "tracks")
    rows = tracks(spark, folder).withColumn("part", F.col("recording") % 8).withColumnRenamed("t_ns", TIME)
    sinks.save_object_tracks(rows, path, ["recording"], partition=["part"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("part").cast("long").alias("part")).agg(
        F.count("*").alias("n"), F.sum(F.expr(f"{TIME} div 1000000000")).alias("t"), F.sum("object_id").alias("o"), rounded(F.sum("pose_x"), 4).alias("x")
    )


@query(
    "save_and_load_predictions",
    f"""WITH {PREDICTIONS_SQL} SELECT fold, sample, max(gt) FILTER (task = 'cd') AS gt_cd, max(prob) FILTER (task = 'cd') AS prob_cd,
      max(gt) FILTER (task = 'intox') AS gt_intox, max(prob) FILTER (task = 'intox') AS prob_intox FROM predictions WHERE task IN ('cd', 'intox') GROUP BY 1, 2""",
)
def save_and_load_predictions(spark, folder):
    """Two single-task experiments written apart, read together, set side by side per fold."""
    path = scratch_path(spark, "predictions")
    rows = predictions(spark, folder).withColumn("repeat", F.lit(0))
    for task in ("cd", "intox"):
        sinks.save_predictions(rows.where(F.col("task") == task).withColumn("experiment", F.lit(f"shallow_{task}")), path)
    found = files.load_predictions(spark, path).withColumn("fold", F.col("fold").cast("long"))
    return files.merge_single_tasks(found, ["fold", "sample"], ["cd", "intox"])


@query(
    "cached_features",
    "SELECT l_suppkey, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1",
)
def cached_features(spark, folder):
    path = scratch_path(spark, "features")

    def compute():
        return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))

    files.cache_features(spark, path, compute)
    return files.cache_features(spark, path, compute)


@query(
    "metric_log",
    f"""WITH {PREDICTIONS_SQL}, e AS (SELECT sample % 12 AS epoch, task, round(avg(prob), 6) AS v FROM predictions GROUP BY 1, 2)
    SELECT epoch, max(v) FILTER (task = 'cd') AS cd, max(v) FILTER (task = 'intox') AS intox FROM e GROUP BY 1""",
)
def metric_log(spark, folder):
    rows = predictions(spark, folder).where("task IN ('cd', 'intox')")
    long = rows.groupBy((F.col("sample") % 12).alias("epoch"), F.col("task").alias("metric")).agg(rounded(F.avg("prob")).alias("value"))
    return sinks.metric_log(long, ["cd", "intox"])


LOG_SQL = """
lines AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'fold UAR=0.' || CAST(n_chars % 1000 AS VARCHAR) || '  sens=0.' || CAST(n_chars % 97 AS VARCHAR) || ' spec=1.0 AUC=0.'
  || CAST(doc_id % 89 AS VARCHAR) || ' F1=0.5 ' || text END AS line FROM documents),
found AS (SELECT doc_id, regexp_extract(line, 'UAR=(\\d+\\.\\d+)\\s+sens=(\\d+\\.\\d+)\\s+spec=(\\d+\\.\\d+)\\s+AUC=(\\d+\\.\\d+)\\s+F1=(\\d+\\.\\d+)', ['uar', 'sens', 'spec', 'auc', 'f1']) AS m FROM lines
  WHERE regexp_matches(line, 'UAR=(\\d+\\.\\d+)\\s+sens=(\\d+\\.\\d+)\\s+spec=(\\d+\\.\\d+)\\s+AUC=(\\d+\\.\\d+)\\s+F1=(\\d+\\.\\d+)'))
"""


def document_log(spark, folder):
    d, n, k = table(spark, folder, "documents"), F.col("n_chars"), F.col("doc_id")

    def text(c):
        return c.cast("string")

    line = F.concat(
        F.lit("fold UAR=0."), text(n % 1000), F.lit("  sens=0."), text(n % 97), F.lit(" spec=1.0 AUC=0."), text(k % 89), F.lit(" F1=0.5 "), F.col("text")
    )
    return logs.log_metrics(d.select("doc_id", F.when(k % 3 == 0, F.col("text")).otherwise(line).alias("value")))


@query("log_metrics", f"WITH {LOG_SQL} SELECT doc_id, m.uar::DOUBLE AS uar, m.sens::DOUBLE AS sens, m.spec::DOUBLE AS spec, m.auc::DOUBLE AS auc, m.f1::DOUBLE AS f1 FROM found")
def log_metrics(spark, folder):
    return document_log(spark, folder)


@query(
    "log_summary",
    f"WITH {LOG_SQL} SELECT round(avg(m.uar::DOUBLE), 6) AS uar_mean, round(stddev_pop(m.uar::DOUBLE), 6) AS uar_std, round(avg(m.auc::DOUBLE), 6) AS auc_mean, round(stddev_pop(m.auc::DOUBLE), 6) AS auc_std FROM found",
)
def log_summary(spark, folder):
    out = reports.fold_summary(document_log(spark, folder), ["uar", "auc"])
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "fold_results_complete",
    f"""WITH {PREDICTIONS_SQL}, m AS (SELECT fold, avg(prob) AS uar, avg(CASE WHEN fold <> 2 THEN prob * 2 END) AS auc FROM predictions GROUP BY 1)
    SELECT round(avg(uar), 6) AS uar_mean, round(stddev_pop(uar), 6) AS uar_std, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std FROM m""",
)
def fold_results_complete(spark, folder):
    """One JSON result per fold, written and read back; a summary only when all five are there."""
    path = scratch_path(spark, "folds")
    rows = predictions(spark, folder)
    results = rows.groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.avg("prob").alias("uar"), F.avg(F.when(F.col("fold") != 2, F.col("prob") * 2)).alias("auc")
    )
    results.withColumn("part", F.col("fold")).write.partitionBy("part").json(path)
    back = logs.load_fold_results(spark, f"{path}/*/*.json")
    out = reports.summary_when_complete(back.select("fold", "uar", "auc"), ["uar", "auc"])
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "manifest_select",
    """SELECT count(*) AS objects, CAST(coalesce(sum(length(html)), 0) AS BIGINT) AS bytes FROM pages
    WHERE (url GLOB '*/en/*' OR url GLOB 'http://*example.com/*[0-9]') AND NOT (url GLOB '*page=2*' OR url GLOB '*[#]top')""",
)
def manifest_select(spark, folder):
    listing = table(spark, folder, "pages").select(F.col("url").alias("key"), F.length("html").cast("long").alias("size"))
    chosen = logs.manifest_select(listing, ["*/en/*", "http://*example.com/*[0-9]"], ["*page=2*", "*[#]top"])
    return logs.manifest_size(chosen)


@query(
    "manifest_diff",
    """WITH r AS (SELECT page_id AS key, length(html) AS size, page_id % 50 AS modified FROM pages),
    l AS (SELECT key, size + CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END AS lsize, key % 37 AS lmod FROM r WHERE key % 4 <> 0)
    SELECT key, CAST(size AS BIGINT) AS size, CASE WHEN lsize IS NULL THEN 'missing' WHEN lsize <> size THEN 'size' ELSE 'older' END AS reason
    FROM r LEFT JOIN l USING (key) WHERE lsize IS NULL OR lsize <> size OR NOT lmod > modified""",
)
def manifest_diff(spark, folder):
    remote = table(spark, folder, "pages").select(F.col("page_id").alias("key"), F.length("html").cast("long").alias("size"), (F.col("page_id") % 50).alias("modified"))
    local = remote.where("key % 4 <> 0").select("key", (F.col("size") + F.when(F.col("key") % 5 == 0, 1).otherwise(0)).alias("size"), (F.col("key") % 37).alias("modified"))
    return logs.manifest_diff(remote, local).select("key", "size", "reason")


@query(
    "frames_with_timing",
    """WITH f AS (SELECT l_suppkey, l_partkey AS frame FROM lineitem), t AS (SELECT DISTINCT l_suppkey, l_partkey AS frame FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05),
    k AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM t WHERE t.l_suppkey = f.l_suppkey AND t.frame = f.frame))
    SELECT l_suppkey, frame, count(*) AS n FROM k WHERE l_suppkey IN (SELECT l_suppkey FROM k GROUP BY 1 HAVING count(*) >= 95) GROUP BY 1, 2""",
)
def frames_listed(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "frame")
    timing = lines.where("l_returnflag = 'R' AND l_discount > 0.05").select("l_suppkey", "frame").distinct()
    kept = frames_with_timing(lines.select("l_suppkey", "frame"), timing, ["l_suppkey"], 95)
    return kept.groupBy("l_suppkey", "frame").agg(F.count("*").alias("n"))


@query(
    "frame_timing_numbers",
    f"WITH {SIGNAL_SQL} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t_ns) - 1 AS resampled_frame FROM signal",
)
def frame_timing_numbers(spark, folder):
    return renumber_frames(signal(spark, folder), ["user_id"], "t_ns", 60 * SECOND).select("event_id", "resampled_frame")


@query(
    "grid_frames",
    f"WITH {SIGNAL_SQL} SELECT user_id, (end_time * 60 + 999999999) // 1000000000 AS frames FROM recordings",
)
def grid_frames(spark, folder):
    return recordings(signal(spark, folder)).select("user_id", frame_count(F.col("start_time"), F.col("end_time"), 60).alias("frames"))


@query(
    "array_slices",
    """SELECT vec_id, n, round(first, 6) AS first, label FROM (SELECT vec_id, CAST(len(embedding[11:11 + label]) AS INT) AS n, embedding[11]::DOUBLE AS first, label FROM embeddings)""",
)
def array_slices(spark, folder):
    """Entries of the time range 10 .. 10 + label; the one-entry array applies to every time."""
    e = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.array("label").alias("label"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("times"), F.col("label").alias("span")
    )
    cut = files.slice_arrays(e, ["embedding", "label"], F.lit(10), F.lit(10) + F.col("span"))
    return cut.select("vec_id", F.size("embedding").alias("n"), rounded(F.col("embedding")[0].cast("double")).alias("first"), F.col("label")[0].alias("label"))
