"""The scenario index: conditions, filters, ground truth and annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driverscope.functions.text import anomaly_intervals, crash_total, hazard_outcome, matches_from_start, scenario_short
from driverscope.operators.ordered import time_bin
from driverscope.operators.spread import join_few
from driverscope.schema import INTERVALS

# Participants the study leaves out by default.
DEFAULT_EXCLUDED = ("P701", "P711", "7218", "7219", "7225", "7228", "7229", "7237")
NO_TASK = "no_task"
# Scenario families by name pattern, anchored at the start.
FAMILIES = {
    "calibration": "tobii_calibration",
    "stationary": "stationary_tasks.*",
    "practice": "driving/practice",
    "hazards": "driving/[0-9].*",
    "driving": "driving/.*",
    "all": ".*",
}


def with_conditions(index: DataFrame) -> DataFrame:
    """Study version and intoxication follow from the name's first letter and the round."""
    first_study = F.col("participant_name").startswith("P")
    return index.withColumns(
        {
            "experiment_version": F.when(first_study, 1).otherwise(2),
            "intoxicated": first_study & (F.col("round") == "R2"),
        }
    )


def distracted(task: str = "cognitive_task") -> Column:
    return F.col(task) != NO_TASK


def select_participants(
    index: DataFrame,
    exclude: Sequence[str] | DataFrame = DEFAULT_EXCLUDED,
    use: Sequence[str] | DataFrame | None = None,
    participant: str = "participant_name",
) -> DataFrame:
    """Drop and keep participants. Short lists become predicates, tables become anti and semi joins."""
    if isinstance(exclude, DataFrame):
        index = join_few(index, exclude.distinct(), [participant], "left_anti")
    elif exclude:
        # a row without a participant is nobody's, so nothing excludes it
        index = index.where(~F.coalesce(F.col(participant).isin(*exclude), F.lit(False)))
    if isinstance(use, DataFrame):
        index = join_few(index, use.distinct(), [participant], "left_semi")
    elif use is not None:
        index = index.where(F.col(participant).isin(*use))
    return index


def filter_index(
    index: DataFrame,
    pattern: str = ".*",
    version: int | None = None,
    drop_anomalous: bool = False,
    train: bool = False,
    exclude_tasks: Sequence[str] = (),
    exclude_intoxicated: bool | None = None,
    exclude_baseline: bool = False,
) -> DataFrame:
    """Index filters; the last three apply to training data only."""
    if version is not None:
        index = index.where(F.col("experiment_version") == version)
    index = index.where(matches_from_start("scenario_name", pattern))
    if drop_anomalous:
        index = index.where(F.size("anomalies") == 0)
    if train and exclude_tasks:
        index = index.where(~F.col("cognitive_task").isin(*exclude_tasks))
    if train and exclude_intoxicated is not None:
        index = index.where(F.col("intoxicated") != exclude_intoxicated)
    if train and exclude_baseline:
        index = index.where(F.col("intoxicated") | distracted())
    return index


def skip_recordings(index: DataFrame, anomalous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without practice drives and without recordings on the anomaly list."""
    return index.where(~F.col("scenario_name").contains("practice")).join(anomalous, list(keys), "left_anti")


def parse_annotations(cells: DataFrame, anomaly: str, hazard: str, crashes: str) -> DataFrame:
    return cells.withColumns(
        {
            "anomalies": anomaly_intervals(anomaly),
            "number_hazard_crashes": hazard_outcome(hazard),
            "number_all_crashes": crash_total(crashes),
        }
    )


def join_annotations(index: DataFrame, annotations: DataFrame) -> DataFrame:
    """Crash counts and anomaly lists by participant and short scenario name.

    Outside driving nothing can crash: 0 and no anomaly. A driving scenario
    without annotation has unknown (NULL) counts, as has a hazard that failed to happen.
    """
    few = annotations.select("participant_name", "scenario_short", "anomalies", "number_hazard_crashes", "number_all_crashes")
    short = F.coalesce(scenario_short("scenario_name"), F.lit(""))
    joined = join_few(index.withColumn("scenario_short", short), few, ["participant_name", "scenario_short"], "left")
    driving = F.col("scenario_name").contains("driving")

    def count_of(name: str) -> Column:
        return F.when(~driving, F.lit(0)).otherwise(F.nullif(F.col(name), F.lit(-1)))

    return joined.withColumns(
        {
            "anomalies": F.when(driving & F.col("anomalies").isNotNull(), F.col("anomalies")).otherwise(
                F.array().cast(INTERVALS)
            ),
            "number_hazard_crashes": count_of("number_hazard_crashes"),
            "number_all_crashes": count_of("number_all_crashes"),
        }
    )


def passive_crashes() -> Column:
    """Crashes besides the staged hazard; all of them when the hazard outcome is unknown."""
    return F.col("number_all_crashes") - F.coalesce(F.col("number_hazard_crashes"), F.lit(0))


def ground_truth(tasks: Sequence[str], cognitive_task: str = "cognitive_task", intoxicated: str = "intoxicated") -> dict[str, Column]:
    """0/1 labels per model task, -1 where the row has no place in the task."""
    cd, intox = distracted(cognitive_task), F.col(intoxicated)
    labels = {
        "cd": cd.cast("int"),
        "nback": (F.col(cognitive_task) == "nback_task").cast("int"),
        "statement": (F.col(cognitive_task) == "statement_task").cast("int"),
        "intoxicated": intox.cast("int"),
        "impaired": (cd | intox).cast("int"),
        "impaired_intoxicated": F.when(cd | intox, intox.cast("int")).otherwise(-1),
        "sober_cd": F.when(intox, -1).otherwise(cd.cast("int")),
    }
    unknown = [t for t in tasks if t not in labels]
    if unknown:
        raise ValueError(f"unknown model task {unknown[0]!r}")
    return {t: labels[t] for t in tasks}


def ground_truth_long(df: DataFrame, keys: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """One row per sample and task."""
    cells = [F.struct(F.lit(t).alias("task"), gt.alias("gt")) for t, gt in ground_truth(tasks).items()]
    return df.select(*keys, F.inline(F.array(*cells)))


def clip_label(participant: str = "participant_name", key: str = "scenario_path") -> Column:
    """Clip rule: first-study participants in round R2 are positive."""
    return (F.col(participant).startswith("P") & F.col(key).startswith("R2")).cast("int")


def shorten_label(name: Column, patterns: Mapping[str, str]) -> Column:
    """First label whose glob matches the whole name, NULL if none does."""
    tests = [(name.rlike(glob_to_regex(g)), F.lit(label)) for g, label in patterns.items()]
    return reduce(lambda acc, t: acc.when(*t), tests[1:], F.when(*tests[0]))


def glob_to_regex(glob: str) -> str:
    """``*`` matches any run of characters (slashes too), ``?`` one, ``[...]`` a set."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + ch if not (ch.isalnum() or ch in "_/ -") else ch)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def require_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that occur exactly once: a partial aggregate that keeps the one row along."""
    rest = [c for c in df.columns if c not in set(keys)]
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__row"))
    return found.where("__n = 1").select(*keys, "__row.*").select(*df.columns)


def frames_with_timing(frames: DataFrame, timing: DataFrame, keys: Sequence[str], minimum: int = 1) -> DataFrame:
    """Frames the timing table lists, for recordings that have at least ``minimum`` of them."""
    kept = frames.join(timing.select(*keys, "frame"), [*keys, "frame"], "left_semi")
    enough = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= minimum).select(*keys)
    return join_few(kept, enough, keys, "left_semi", time_bin("frame", 10_000))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key. ``row_number() = 1`` is pruned inside each map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
