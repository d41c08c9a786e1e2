"""Scenario index, annotations, filters and the study's report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverscope.functions.text import scenario_short
from driverscope.operators.index import (
    clip_label,
    filter_index,
    ground_truth_long,
    join_annotations,
    parse_annotations,
    passive_crashes,
    select_participants,
    shorten_label,
    skip_recordings,
    with_conditions,
)
from driverscope.operators.ordered import magnitude_bin
from driverscope.plans import reports
from driverscope.plans.catalogue import query, rounded, table
from driverscope.plans.standins import INDEX_SQL, raw_scenarios

# Annotation sheet in long form: smallest cell per participant and scenario; every third scenario lacks one.
ANNOTATED_SQL = f"""{INDEX_SQL},
short AS (SELECT *, CASE WHEN scenario_name LIKE '%driving%' THEN regexp_extract(scenario_name, '^[^/]*/([^-/]*)', 1) END AS scenario_short
          FROM scenarios),
sheet AS (SELECT participant_name, scenario_short, min(anomaly_cell) AS anomaly_cell, min(hazard_cell) AS hazard_cell, max(crash_cell) AS crash_cell
          FROM short WHERE scenario_index % 3 <> 2 AND scenario_short IS NOT NULL GROUP BY 1, 2),
parsed AS (SELECT *, CASE WHEN hazard_cell LIKE '%fail%' THEN -1 WHEN hazard_cell LIKE '%crash%' THEN 1 ELSE 0 END AS hz,
             CASE WHEN trim(crash_cell) = '' THEN 0 ELSE length(crash_cell) - length(replace(crash_cell, ',', '')) + 1 END AS cr,
             list_transform(list_filter(list_transform(string_split(anomaly_cell, ','),
                 lambda p: list_filter(string_split(trim(p), '-'), lambda x: x <> '')), lambda p: len(p) = 2),
               lambda p: [CAST(trim(p[1]) AS BIGINT) * 1000000000, CAST(trim(p[2]) AS BIGINT) * 1000000000]) AS anomalies
           FROM sheet),
idx AS (SELECT s.*, coalesce(len(p.anomalies), 0) AS n_anomalies,
          coalesce(list_sum(list_transform(p.anomalies, lambda a: a[2] - a[1])), 0) AS anomalous_ns,
          CASE WHEN scenario_name NOT LIKE '%driving%' THEN 0 ELSE nullif(hz, -1) END AS number_hazard_crashes,
          CASE WHEN scenario_name NOT LIKE '%driving%' THEN 0 ELSE cr END AS number_all_crashes
        FROM short s LEFT JOIN parsed p ON s.participant_name = p.participant_name AND s.scenario_short = p.scenario_short)
"""


def annotated(spark, folder):
    raw = raw_scenarios(spark, folder)
    sheet = (
        raw.withColumn("scenario_short", scenario_short("scenario_name"))
        .where("scenario_index % 3 <> 2 AND scenario_short IS NOT NULL")
        .groupBy("participant_name", "scenario_short")
        .agg(F.min("anomaly_cell").alias("a"), F.min("hazard_cell").alias("h"), F.max("crash_cell").alias("c"))
    )
    return join_annotations(with_conditions(raw), parse_annotations(sheet, "a", "h", "c"))


def anomalous_ns():
    return F.aggregate("anomalies", F.lit(0).cast("long"), lambda a, i: a + i["end_ns"] - i["start_ns"])


@query(
    "index_annotations",
    f"""WITH {ANNOTATED_SQL} SELECT scenario_index, experiment_version, intoxicated, CAST(n_anomalies AS BIGINT) AS n_anomalies,
      CAST(anomalous_ns AS BIGINT) AS anomalous_ns, CAST(number_hazard_crashes AS BIGINT) AS hazard, CAST(number_all_crashes AS BIGINT) AS total,
      CAST(number_all_crashes - coalesce(number_hazard_crashes, 0) AS BIGINT) AS passive FROM idx""",
)
def index_annotations(spark, folder):
    return annotated(spark, folder).select(
        "scenario_index",
        "experiment_version",
        "intoxicated",
        F.size("anomalies").cast("long").alias("n_anomalies"),
        anomalous_ns().alias("anomalous_ns"),
        F.col("number_hazard_crashes").cast("long").alias("hazard"),
        F.col("number_all_crashes").cast("long").alias("total"),
        passive_crashes().cast("long").alias("passive"),
    )


@query(
    "index_filters",
    f"""WITH {ANNOTATED_SQL} SELECT scenario_index FROM idx
    WHERE participant_name NOT IN ('P2', 'P10', '7221', '7235') AND experiment_version = 1 AND regexp_matches(scenario_name, '^driving/[0-9].*')
      AND n_anomalies = 0 AND cognitive_task <> 'nback_task' AND intoxicated""",
)
def index_filters(spark, folder):
    kept = select_participants(annotated(spark, folder), exclude=["P2", "P10", "7221", "7235"])
    return filter_index(
        kept, "driving/[0-9].*", version=1, drop_anomalous=True, train=True, exclude_tasks=["nback_task"], exclude_intoxicated=False
    ).select("scenario_index")


@query(
    "index_participant_tables",
    f"""WITH {INDEX_SQL} SELECT scenario_index, scenario_name FROM scenarios s
    WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.c_custkey AND c_mktsegment = 'BUILDING')
      AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.c_custkey AND c_acctbal > 0)
      AND (intoxicated OR cognitive_task <> 'no_task')""",
)
def index_participant_tables(spark, folder):
    customers = table(spark, folder, "customer")
    gone = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    used = customers.where("c_acctbal > 0").select("c_custkey")
    kept = select_participants(with_conditions(raw_scenarios(spark, folder)), gone, used, "c_custkey")
    return filter_index(kept, train=True, exclude_baseline=True).select("scenario_index", "scenario_name")


@query(
    "participants_anti_null",
    f"""WITH {INDEX_SQL}, n AS (SELECT scenario_index, CASE WHEN scenario_index % 5 <> 0 THEN c_custkey END AS c_custkey FROM scenarios)
    SELECT scenario_index FROM n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.c_custkey AND c_mktsegment = 'BUILDING')""",
)
def participants_anti_null(spark, folder):
    """Scenarios without a participant are nobody's and stay."""
    gone = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    rows = raw_scenarios(spark, folder).withColumn("c_custkey", F.when(F.col("scenario_index") % 5 != 0, F.col("c_custkey")))
    return select_participants(rows, gone, participant="c_custkey").select("scenario_index")


@query(
    "index_skip_anomalous",
    f"""WITH {INDEX_SQL} SELECT scenario_index FROM scenarios s WHERE scenario_name NOT LIKE '%practice%'
    AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.scenario_index AND l_returnflag = 'R')""",
)
def index_skip_anomalous(spark, folder):
    bad = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scenario_index"))
    return skip_recordings(raw_scenarios(spark, folder), bad, ["scenario_index"]).select("scenario_index")


@query(
    "ground_truth",
    f"""WITH {INDEX_SQL}, t AS (SELECT scenario_index, cognitive_task <> 'no_task' AS cd, cognitive_task AS ct, intoxicated AS i FROM scenarios)
    SELECT scenario_index, task, CASE task WHEN 'cd' THEN CAST(cd AS INT) WHEN 'nback' THEN CAST(ct = 'nback_task' AS INT)
      WHEN 'statement' THEN CAST(ct = 'statement_task' AS INT) WHEN 'intoxicated' THEN CAST(i AS INT) WHEN 'impaired' THEN CAST(cd OR i AS INT)
      WHEN 'impaired_intoxicated' THEN CASE WHEN cd OR i THEN CAST(i AS INT) ELSE -1 END ELSE CASE WHEN i THEN -1 ELSE CAST(cd AS INT) END END AS gt
    FROM t CROSS JOIN (VALUES ('cd'), ('nback'), ('statement'), ('intoxicated'), ('impaired'), ('impaired_intoxicated'), ('sober_cd')) k(task)""",
)
def ground_truth_query(spark, folder):
    tasks = ["cd", "nback", "statement", "intoxicated", "impaired", "impaired_intoxicated", "sober_cd"]
    return ground_truth_long(with_conditions(raw_scenarios(spark, folder)), ["scenario_index"], tasks)


LABELS = {"R1-driving/*-*": "R1-D", "R2-driving/*-*": "R2-D", "R?-driving/practice": "DP", "R1-stationary*/gaze_[a-t]*": "R1-ST-GT"}


@query(
    "scenario_labels",
    f"""WITH {INDEX_SQL}, n AS (SELECT *, round || '-' || scenario_name AS name FROM scenarios)
    SELECT scenario_index, CASE WHEN name GLOB 'R1-driving/*-*' THEN 'R1-D' WHEN name GLOB 'R2-driving/*-*' THEN 'R2-D'
      WHEN name GLOB 'R?-driving/practice' THEN 'DP' WHEN name GLOB 'R1-stationary*/gaze_[a-t]*' THEN 'R1-ST-GT' END AS label,
      CAST(substr(participant_name, 1, 1) = 'P' AND name LIKE 'R2%' AS INT) AS clip_label FROM n""",
)
def scenario_labels(spark, folder):
    named = raw_scenarios(spark, folder).withColumn("scenario_path", F.concat("round", F.lit("-"), "scenario_name"))
    return named.select(
        "scenario_index", shorten_label(F.col("scenario_path"), LABELS).alias("label"), clip_label().alias("clip_label")
    )


@query(
    "dataset_summary",
    f"""WITH {INDEX_SQL} SELECT count(DISTINCT participant_name) AS participants,
      count(DISTINCT participant_name || '|' || scenario_name) AS scenarios, count(*) AS chunks FROM scenarios""",
)
def dataset_summary(spark, folder):
    return reports.dataset_summary(raw_scenarios(spark, folder))


@query(
    "condition_report",
    f"""WITH {INDEX_SQL}, f AS (SELECT *, cognitive_task <> 'no_task' AS cd FROM scenarios)
    SELECT CASE WHEN grouping(intoxicated) = 1 THEN 'all' WHEN intoxicated THEN 'yes' ELSE 'no' END AS intoxicated_text,
      CASE WHEN grouping(cd) = 1 THEN 'all' WHEN cd THEN 'yes' ELSE 'no' END AS cd_text,
      count(*) FILTER (scenario_name LIKE 'driving/practice%') AS practice_count,
      CAST(coalesce(sum(duration_ds) FILTER (scenario_name LIKE 'driving/practice%'), 0) AS BIGINT) AS practice_amount,
      count(*) FILTER (regexp_matches(scenario_name, '^driving/[0-9]')) AS hazards_count,
      CAST(coalesce(sum(duration_ds) FILTER (regexp_matches(scenario_name, '^driving/[0-9]')), 0) AS BIGINT) AS hazards_amount,
      count(*) FILTER (scenario_name LIKE 'driving/%') AS driving_count,
      CAST(coalesce(sum(duration_ds) FILTER (scenario_name LIKE 'driving/%'), 0) AS BIGINT) AS driving_amount
    FROM f GROUP BY CUBE (intoxicated, cd)""",
)
def condition_report(spark, folder):
    index = with_conditions(raw_scenarios(spark, folder))
    return reports.condition_report(index, ["practice", "hazards", "driving"], F.col("duration_ds"))


@query(
    "completion_report",
    f"""WITH {INDEX_SQL}, p AS (SELECT participant_name, count(*) FILTER (regexp_matches(scenario_name, '^driving/[0-9]')) AS h
      FROM scenarios GROUP BY 1), g AS (SELECT *, substr(participant_name, 1, 1) = 'P' AS fs FROM p)
    SELECT CASE WHEN grouping(fs) = 1 THEN 'all' WHEN fs THEN 'yes' ELSE 'no' END AS first_study_text, count(*) AS started,
      count(*) FILTER (h >= 4) AS four_hazards, count(*) FILTER (h >= 8) AS all_hazards FROM g GROUP BY ROLLUP (fs)""",
)
def completion_report(spark, folder):
    return reports.completion_report(raw_scenarios(spark, folder))


@query(
    "duration_report",
    f"""WITH {INDEX_SQL}, r AS (SELECT participant_name, duration_ds / 600.0::DOUBLE AS minutes, family FROM scenarios
      JOIN (VALUES ('calibration', '^tobii_calibration'), ('stationary', '^stationary_tasks'), ('practice', '^driving/practice'), ('hazards', '^driving/[0-9]'))
        k(family, re) ON regexp_matches(scenario_name, re)),
    c AS (SELECT family, participant_name, count(*) AS n FROM r GROUP BY 1, 2),
    m AS (SELECT *, max(n) OVER (PARTITION BY family) AS most FROM c)
    SELECT family, round(avg(minutes), 6) AS mean_minutes, round(stddev_samp(minutes), 6) AS std_minutes
    FROM r WHERE EXISTS (SELECT 1 FROM m WHERE m.family = r.family AND m.participant_name = r.participant_name AND n = most) GROUP BY 1""",
)
def duration_report(spark, folder):
    families = ["calibration", "stationary", "practice", "hazards"]
    out = reports.duration_report(raw_scenarios(spark, folder), families, F.col("duration_ds") / 600.0)
    return out.select("family", rounded("mean_minutes").alias("mean_minutes"), rounded("std_minutes").alias("std_minutes"))


@query(
    "hazard_tally",
    f"""WITH {ANNOTATED_SQL}, d AS (SELECT l_orderkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
    j AS (SELECT *, 'intox ' || CAST(intoxicated AS VARCHAR) || ' cd ' || CAST(cognitive_task <> 'no_task' AS VARCHAR) AS k
      FROM idx LEFT JOIN d ON l_orderkey = scenario_index WHERE regexp_matches(scenario_name, '^driving/[0-9]'))
    SELECT CASE WHEN grouping(k) = 1 THEN 'total' ELSE k END AS condition, count(*) AS count, round(sum(v) / 10000, 6) AS distance,
      count(number_hazard_crashes) AS hazards FROM j GROUP BY ROLLUP (k)""",
)
def hazard_tally(spark, folder):
    index = filter_index(annotated(spark, folder), "driving/[0-9].*")
    speeds = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "scenario_index")
    return reports.hazard_tally(index, speeds, ["scenario_index"], 10, "l_quantity").withColumn("distance", rounded("distance"))


@query(
    "anomaly_share",
    f"""WITH {ANNOTATED_SQL} SELECT round(sum(anomalous_ns / 1e9), 6) AS anomalous_s, round(sum(duration_ds / 10.0::DOUBLE), 6) AS total_s,
      round(sum(anomalous_ns / 1e9) / sum(duration_ds / 10.0::DOUBLE), 9) AS share FROM idx WHERE scenario_name LIKE 'driving/%'""",
)
def anomaly_share(spark, folder):
    driving = filter_index(annotated(spark, folder), "driving/.*")
    out = reports.anomaly_share(driving, F.col("duration_ds") / 10.0)
    return out.select(rounded("anomalous_s").alias("anomalous_s"), rounded("total_s").alias("total_s"), rounded("share", 9).alias("share"))


@query(
    "calibration_shares",
    f"""WITH {INDEX_SQL}, m AS (SELECT duration_ds / 600.0::DOUBLE AS minutes FROM scenarios WHERE scenario_name LIKE 'tobii_calibration%')
    SELECT round(100 * avg(CAST(minutes <= 2 AS INT)), 6) AS within_2_min, round(100 * avg(CAST(minutes <= 3 AS INT)), 6) AS within_3_min,
      round(100 * avg(CAST(minutes <= 4 AS INT)), 6) AS within_4_min FROM m""",
)
def calibration_shares(spark, folder):
    index = filter_index(raw_scenarios(spark, folder), "tobii_calibration")
    out = reports.share_within(index, F.col("duration_ds") / 600.0, [2, 3, 4])
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "calibration_histogram",
    f"""WITH {INDEX_SQL}, m AS (SELECT duration_ds AS v FROM scenarios WHERE scenario_name LIKE 'tobii_calibration%'),
    e AS (SELECT min(v) AS lo, max(v) AS hi FROM m),
    c AS (SELECT least(15, CAST(floor((v - lo) * 16 / (hi - lo)::DOUBLE) AS INT)) AS bin, count(*) AS n FROM m, e GROUP BY 1)
    SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(16)) AS b) LEFT JOIN c ON b = bin""",
)
def calibration_histogram(spark, folder):
    index = filter_index(raw_scenarios(spark, folder), "tobii_calibration")
    return reports.histogram(index.select("duration_ds"), "duration_ds", 16)


@query(
    "modality_coverage",
    f"""WITH {INDEX_SQL}, h AS (SELECT s.*, EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = scenario_index AND l_discount > 0.08) AS has
      FROM scenarios s WHERE regexp_matches(scenario_name, '^driving/[0-9]'))
    SELECT count(*) FILTER (has) AS with_feature, count(*) AS recordings, round(avg(CAST(has AS INT)), 6) AS share,
      round(coalesce(sum(duration_ds / 10.0::DOUBLE) FILTER (has), 0) / 3600, 6) AS hours FROM h""",
)
def modality_coverage(spark, folder):
    index = filter_index(raw_scenarios(spark, folder), "driving/[0-9].*")
    tracked = table(spark, folder, "lineitem").where("l_discount > 0.08").select(F.col("l_orderkey").alias("scenario_index"))
    out = reports.coverage(index, tracked, ["scenario_index"], F.col("duration_ds") / 10.0)
    return out.select("with_feature", "recordings", rounded("share").alias("share"), rounded("hours").alias("hours"))


@query(
    "class_weights",
    f"""WITH {INDEX_SQL}, g AS (SELECT 'cd' AS task, CAST(cognitive_task <> 'no_task' AS INT) AS gt FROM scenarios UNION ALL
      SELECT 'sober_cd', CASE WHEN intoxicated THEN -1 ELSE CAST(cognitive_task <> 'no_task' AS INT) END FROM scenarios)
    SELECT task, count(*) FILTER (gt <> -1) AS valid, count(*) FILTER (gt = 1) AS positive,
      round(count(*) FILTER (gt <> -1)::DOUBLE / count(*) FILTER (gt = 1) - 1, 6) AS pos_weight FROM g GROUP BY 1""",
)
def class_weights(spark, folder):
    long = ground_truth_long(with_conditions(raw_scenarios(spark, folder)), ["scenario_index"], ["cd", "sober_cd"])
    return reports.class_weights(long).withColumn("pos_weight", rounded("pos_weight"))


@query("scenario_frequency", f"WITH {INDEX_SQL} SELECT scenario_name, count(*) AS n FROM scenarios GROUP BY 1")
def scenario_frequency(spark, folder):
    return reports.frequency(raw_scenarios(spark, folder), "scenario_name")


@query(
    "duration_matrix",
    f"""WITH {INDEX_SQL}, m AS (SELECT *, median(duration_ds) OVER (PARTITION BY scenario_name) AS med FROM scenarios)
    SELECT participant_name, scenario_name, CAST(sum(duration_ds - med) AS DOUBLE) AS deviation FROM m GROUP BY 1, 2""",
)
def duration_matrix(spark, folder):
    index = raw_scenarios(spark, folder)
    out = reports.duration_deviation(index, "participant_name", "scenario_name", "duration_ds", magnitude_bin("duration_ds"))
    return out.withColumn("deviation", F.col("deviation").cast("double"))


@query(
    "minutes_by_category",
    f"""WITH {INDEX_SQL}, n AS (SELECT *, round || '-' || scenario_name AS name FROM scenarios)
    SELECT participant_name, round(coalesce(sum(duration_ds) FILTER (name GLOB '*driving*/*-*'), 0) / 60.0::DOUBLE, 6) AS hazards,
      round(coalesce(sum(duration_ds) FILTER (name GLOB '*practice*'), 0) / 60.0::DOUBLE, 6) AS practice,
      round(coalesce(sum(duration_ds) FILTER (name GLOB 'R*stationary*'), 0) / 60.0::DOUBLE, 6) AS stationary FROM n GROUP BY 1""",
)
def minutes_by_category(spark, folder):
    named = raw_scenarios(spark, folder).withColumn("name", F.concat("round", F.lit("-"), "scenario_name"))
    globs = {"hazards": "*driving*/*-*", "practice": "*practice*", "stationary": "R*stationary*"}
    out = reports.minutes_by_category(named, "participant_name", "name", F.col("duration_ds"), globs)
    return out.select("participant_name", *[rounded(c).alias(c) for c in globs])


@query("distinct_participants", f"WITH {INDEX_SQL} SELECT DISTINCT participant_name FROM scenarios")
def distinct_participants(spark, folder):
    return raw_scenarios(spark, folder).select("participant_name").distinct()
