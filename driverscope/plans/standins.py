"""Study-shaped views of the general test tables, in Spark and in the same SQL.

events are sensor rows of a recording per user, lineitem holds object tracks per supplier,
customers are participants and orders their scenarios. Everything is derived
from whole tables with exact arithmetic, so both engines see the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.plans.catalogue import table


def epoch_us(df: DataFrame, column: str) -> str:
    """SQL for the microseconds since 1970 of a timestamp column, whatever the session's zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"
    return f"unix_micros({column})"


# One wall-clock hour of events counts as one second of recording.
SIGNAL_SQL = """
signal AS (
  SELECT user_id, event_id, event_type,
         (epoch_us(ts) - 1704067200000000) // 3600 * 1000 AS t_ns,
         CASE WHEN event_type <> 'error' THEN value END AS x,
         CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS DOUBLE) - 50 END AS y,
         CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type <> 'error' THEN 0.0 END AS flag
  FROM events),
recordings AS (
  SELECT user_id, CAST(0 AS BIGINT) AS start_time, max(t_ns) AS end_time FROM signal GROUP BY user_id)
"""


def signal(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    slow = F.expr(f"({epoch_us(e, 'ts')} - 1704067200000000) div 3600 * 1000")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        "user_id",
        "event_id",
        "event_type",
        slow.alias("t_ns"),
        F.when(kind != "error", F.col("value")).alias("x"),
        F.when(kind != "view", k - 50).alias("y"),
        F.when(kind == "click", 1.0).when(kind != "error", 0.0).alias("flag"),
    )


def recordings(signal_rows: DataFrame) -> DataFrame:
    return signal_rows.groupBy("user_id").agg(
        F.lit(0).cast("long").alias("start_time"), F.max("t_ns").alias("end_time")
    )


# Participants and their scenarios; the totals stand in for durations.
INDEX_SQL = """
people AS (
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'P' ELSE '72' END || CAST(c_custkey AS VARCHAR) AS participant_name,
         CAST(c_custkey % 6 AS BIGINT) AS fold
  FROM customer),
scenarios AS (
  SELECT o_orderkey AS scenario_index, participant_name, c_custkey, fold,
         CASE WHEN o_orderkey % 2 = 0 THEN 'R1' ELSE 'R2' END AS round,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'driving/1a-pedestrian_pop_out' WHEN '2-HIGH' THEN 'driving/3c-pedestrian_pop_out'
              WHEN '3-MEDIUM' THEN 'driving/practice' WHEN '4-NOT SPECIFIED' THEN 'stationary_tasks/gaze_tracking'
              ELSE 'tobii_calibration' END AS scenario_name,
         CASE o_orderstatus WHEN 'O' THEN 'no_task' WHEN 'F' THEN 'nback_task' ELSE 'statement_task' END AS cognitive_task,
         CAST(round(o_totalprice * 100) AS BIGINT) // 1000 AS duration_ds,
         CASE WHEN substr(participant_name, 1, 1) = 'P' THEN 1 ELSE 2 END AS experiment_version,
         substr(participant_name, 1, 1) = 'P' AND o_orderkey % 2 = 1 AS intoxicated,
         CASE o_orderkey % 4
              WHEN 0 THEN CAST(o_orderkey % 40 AS VARCHAR) || '-' || CAST(o_orderkey % 40 + 7 AS VARCHAR) || ', '
                       || CAST(o_orderkey % 40 + 60 AS VARCHAR) || '-' || CAST(o_orderkey % 40 + 64 AS VARCHAR)
              WHEN 1 THEN CAST(o_orderkey % 30 AS VARCHAR) || '-, bad' ELSE '' END AS anomaly_cell,
         CASE o_orderkey % 7 WHEN 0 THEN 'fail to spawn' WHEN 1 THEN 'crash' ELSE 'avoided' END AS hazard_cell,
         CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '12' WHEN 2 THEN '12,40' ELSE '1, 2, 3' END AS crash_cell
  FROM orders JOIN people ON o_custkey = c_custkey)
"""


def people(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "P").otherwise("72"), F.col("c_custkey").cast("string")).alias("participant_name"),
        (F.col("c_custkey") % 6).alias("fold"),
    )


def raw_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """The index as recorded: what the files of the study hold."""
    o = table(spark, folder, "orders")
    key, priority, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")

    def text(c: Column) -> Column:
        return c.cast("string")

    start = key % 40
    ranges = F.concat(text(start), F.lit("-"), text(start + 7), F.lit(", "), text(start + 60), F.lit("-"), text(start + 64))
    return o.join(people(spark, folder), F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("scenario_index"),
        "participant_name",
        "c_custkey",
        "fold",
        F.when(key % 2 == 0, "R1").otherwise("R2").alias("round"),
        F.when(priority == "1-URGENT", "driving/1a-pedestrian_pop_out")
        .when(priority == "2-HIGH", "driving/3c-pedestrian_pop_out")
        .when(priority == "3-MEDIUM", "driving/practice")
        .when(priority == "4-NOT SPECIFIED", "stationary_tasks/gaze_tracking")
        .otherwise("tobii_calibration")
        .alias("scenario_name"),
        F.when(status == "O", "no_task").when(status == "F", "nback_task").otherwise("statement_task").alias("cognitive_task"),
        F.expr("bigint(round(o_totalprice * 100)) div 1000").alias("duration_ds"),
        F.when(key % 4 == 0, ranges)
        .when(key % 4 == 1, F.concat(text(key % 30), F.lit("-, bad")))
        .otherwise("")
        .alias("anomaly_cell"),
        F.when(key % 7 == 0, "fail to spawn").when(key % 7 == 1, "crash").otherwise("avoided").alias("hazard_cell"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, "12").when(key % 5 == 2, "12,40").otherwise("1, 2, 3").alias("crash_cell"),
    )


# Object tracks: recording = supplier, object = line number, one time step per month.
TRACKS_SQL = """
tracks AS (
  SELECT l_suppkey AS recording, CAST(l_linenumber AS BIGINT) AS object_id,
         (CAST(year(l_shipdate) AS BIGINT) * 12 + month(l_shipdate) - 23941) * 1000000000 AS t_ns,
         max(l_quantity) AS pose_x, max(l_extendedprice) / 1000 AS pose_y, max(l_tax) * 100 AS pose_z,
         min(l_quantity) / 50 AS qx, max(l_discount) * 5 - 0.2 AS qy, max(l_tax) * 3 - 0.1 AS qz, 0.5 + min(l_discount) AS qw
  FROM lineitem GROUP BY 1, 2, 3),
actors AS (
  SELECT recording, object_id, min(t_ns) AS start_epoch_ns, max(t_ns) AS end_epoch_ns,
         CASE WHEN object_id = 1 THEN 'hero' WHEN object_id = 7 AND recording % 3 = 0 THEN 'pedestrian' ELSE 'traffic' END AS role,
         CASE WHEN (recording + object_id) % 2 = 0 THEN 'vehicle.mercedes.coupe_2020' ELSE 'vehicle.audi.tt' END AS actor_type
  FROM tracks GROUP BY recording, object_id)
"""


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    month = F.expr("(bigint(year(l_shipdate)) * 12 + month(l_shipdate) - 23941) * 1000000000")
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("recording"), F.col("l_linenumber").cast("long").alias("object_id"), month.alias("t_ns"))
        .agg(
            F.max("l_quantity").alias("pose_x"),
            (F.max("l_extendedprice") / 1000).alias("pose_y"),
            (F.max("l_tax") * 100).alias("pose_z"),
            (F.min("l_quantity") / 50).alias("qx"),
            (F.max("l_discount") * 5 - 0.2).alias("qy"),
            (F.max("l_tax") * 3 - 0.1).alias("qz"),
            (0.5 + F.min("l_discount")).alias("qw"),
        )
    )


def actors(track_rows: DataFrame) -> DataFrame:
    return track_rows.groupBy("recording", "object_id").agg(
        F.min("t_ns").alias("start_epoch_ns"), F.max("t_ns").alias("end_epoch_ns")
    ).select(
        "*",
        F.when(F.col("object_id") == 1, "hero")
        .when((F.col("object_id") == 7) & (F.col("recording") % 3 == 0), "pedestrian")
        .otherwise("traffic")
        .alias("role"),
        F.when((F.col("recording") + F.col("object_id")) % 2 == 0, "vehicle.mercedes.coupe_2020")
        .otherwise("vehicle.audi.tt")
        .alias("actor_type"),
    )


# Predictions: one row per order and task with a ground truth and a made score in [0, 1).
PREDICTIONS_SQL = """
predictions AS (
  SELECT o_orderkey AS sample, o_custkey AS participant, CAST(o_custkey % 5 AS BIGINT) AS fold, task,
         CASE task WHEN 'cd' THEN CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END
                   WHEN 'intox' THEN CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END
                   WHEN 'impaired' THEN CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END
                   ELSE CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderstatus <> 'O' THEN 0 ELSE -1 END END AS gt,
         ((CAST(round(o_totalprice * 100) AS BIGINT) * CASE task WHEN 'cd' THEN 1 WHEN 'intox' THEN 7 WHEN 'impaired' THEN 13 ELSE 29 END) % 1000) / 1000.0::DOUBLE AS prob
  FROM orders CROSS JOIN (VALUES ('cd'), ('intox'), ('impaired'), ('impaired_intox')) AS k(task))
"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    cd = F.col("o_orderstatus") != "O"
    intox = F.col("o_orderkey") % 3 == 0
    cents = F.round(F.col("o_totalprice") * 100).cast("long")

    def score(factor: int) -> Column:
        return (cents * factor) % 1000 / F.lit(1000.0)

    def task(name: str, gt: Column, factor: int) -> Column:
        return F.struct(F.lit(name).alias("task"), gt.cast("int").alias("gt"), score(factor).alias("prob"))

    joint = F.when(intox, 1).when(cd, 0).otherwise(-1)
    return o.select(
        F.col("o_orderkey").alias("sample"),
        F.col("o_custkey").alias("participant"),
        (F.col("o_custkey") % 5).alias("fold"),
        F.inline(
            F.array(task("cd", cd, 1), task("intox", intox, 7), task("impaired", cd | intox, 13), task("impaired_intox", joint, 29))
        ),
    )
