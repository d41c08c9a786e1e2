"""Readers of the study's file tree.

``<base>/<relative>/Participants/<participant>/scenario_index.csv`` lists a participant's
scenarios; feature files lie below ``<participant>/<round>/<section>/<scenario>/<task>/``. Every
reader is one distributed read over all files; who a row belongs to comes
from its file's path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.functions.text import anomaly_intervals, crash_total, hazard_outcome
from driverscope.operators.spread import join_few
from driverscope.schema import OBJECT, SCENARIO_INDEX, TIME, FeatureSpec, clean_doubles, nan_to_null
from driverscope.sources.tree import LEVELS, PATH, clean_name, read_tree

# Scenario columns of the annotation sheet's three blocks.
ANNOTATED_SCENARIOS = ["1a", "2", "2b", "3c", "5", "6e", "7a", "8a"]
# Participant prefixes of the two studies.
STUDY_PREFIXES = {"v1": "P7", "v2": "72", "all": ""}
# Answer schedules by scenario, one pattern number each.
SCHEDULE_PATTERNS = {
    "1a-pedestrian_pop_out": 1,
    "2-vehicle_pop_out": 2,
    "2b-vehicle_door_open_hazard": 3,
    "3c-pedestrian_pop_out": 4,
    "5-vehicle_run_stop": 5,
    "6e-vehicle_run_red_light": 6,
    "7a-vehicle_run_red_light": 7,
    "8a-pedestrian_pop_out": 8,
}
RECORDING_PATH = r"Participants/([^/]+)/([^/]+)/([^/]+)/([^/]+)/([^/]+)(?:/|$)"
RAW_FOLDER = "sim_bag"


def path_parts(path: Column | str) -> dict[str, Column]:
    """participant, round, section, scenario, task out of a path; NULL where the path is malformed."""
    p = F.col(path) if isinstance(path, str) else path
    names = ("participant_name", "round", "section", "scenario", "task")
    found = p.rlike(RECORDING_PATH)
    return {n: F.when(found, F.regexp_extract(p, RECORDING_PATH, i)) for i, n in enumerate(names, 1)}


def parse_recording_paths(df: DataFrame, path: str) -> DataFrame:
    """Rows with a well-formed path, with its parts."""
    return df.withColumns(path_parts(path)).where(F.col("participant_name").isNotNull())


def scan_scenario_index(spark: SparkSession, base: str, relative: str, file: str = "scenario_index.csv") -> DataFrame:
    """All participants' scenario indexes; the participant is the directory's name (or the value of ``name=value``)."""
    rows = (
        spark.read.schema(SCENARIO_INDEX)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(f"{base}/{relative}/Participants/*/{file}")
    )
    name = F.regexp_extract(F.col("_metadata.file_path"), r"Participants/(?:[^/=]+=)?([^/]+)/", 1)
    return clean_doubles(rows.select("*", name.alias("participant_name")))


def _read_named(spark: SparkSession, root: str, file: str, keys: Mapping[str, str], columns: Sequence[str], **options) -> DataFrame:
    """CSV files of one name below a root, with path parts; keys as long, other columns as double, NaN as NULL."""
    renamed = {clean_name(old): new for old, new in keys.items()}
    raw = read_tree(spark, root, file, [*renamed, *columns] if columns else (), **options)
    present = [c for c in (columns or raw.columns) if c in raw.columns and c not in renamed and c not in (*LEVELS, PATH)]
    return raw.where(F.col(LEVELS[0]).isNotNull()).select(
        *LEVELS,
        PATH,
        *[F.col(f"`{old}`").cast("long").alias(new) for old, new in renamed.items() if old in raw.columns],
        *[_typed(c, f"`{c}`") for c in present],
    )


def _typed(name: str, source: str) -> Column:
    if name.endswith(("rolename", "_type", "cause", "_name")):
        return F.col(source).alias(name)
    return nan_to_null(F.col(source).try_cast("double")).alias(name)


def prefer_primary(rows: DataFrame, keys: Sequence[str], path: str = "__path") -> DataFrame:
    """Rows from the raw folder only for recordings that have no derived file.

    The recordings that have one are listed once (distinct keys) and anti-joined.
    """
    raw = F.col(path).contains(f"/{RAW_FOLDER}/")
    have = rows.where(~raw).select(*keys).distinct()
    fallback = join_few(rows.where(raw), have, keys, "left_anti")
    return rows.where(~raw).unionByName(fallback)


def only(participants: Sequence[str] | None, rounds: Sequence[str] | None) -> dict[str, Sequence[str]]:
    """Path parts to walk through; those left open are not limited."""
    return {k: v for k, v in zip(LEVELS, (participants, rounds)) if v is not None}


def scan_feature(
    spark: SparkSession,
    base: str,
    spec: FeatureSpec,
    object_id_column: str | None = None,
    timed: bool = True,
    participants: Sequence[str] | None = None,
    rounds: Sequence[str] | None = None,
) -> DataFrame:
    """Every recording's table of one feature: path parts, time and object keys, the columns the spec uses.

    Participants and rounds prune the listing, as do later filters on the path's parts; headers are looked at in the
    directories that ``participants`` and ``rounds`` leave.
    """
    keys = {TIME: TIME} if timed else {}
    if object_id_column is not None:
        keys[object_id_column] = OBJECT
    rows = _read_named(spark, f"{base}/{spec.relative_path}/Participants", spec.file, keys, spec.inputs, wanted=only(participants, rounds))
    return prefer_primary(rows, list(LEVELS)).drop(PATH)


def scan_frame_timing(
    spark: SparkSession,
    base: str,
    relative: str,
    camera: str,
    columns: Sequence[str] = ("resampled_frame",),
    one_video: bool = False,
    participants: Sequence[str] | None = None,
    rounds: Sequence[str] | None = None,
) -> DataFrame:
    """Frame timing of a camera, from the camera's own directory in each recording.

    With ``one_video`` a directory that does not hold exactly one video file is an error.
    """
    root = f"{base}/{relative}/Participants"
    rows = _read_named(spark, root, "frame_timing.csv", {TIME: TIME}, columns, inside=camera, one_video=one_video, wanted=only(participants, rounds))
    return rows.drop(PATH)


def video_directories(listing: DataFrame, path: str = "path") -> DataFrame:
    """Directories that do not hold exactly one video file, with their count: an error list."""
    is_video = F.col(path).rlike(r"\.(mp4|avi|mkv|mov)$")
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return listing.groupBy(folder.alias("directory")).agg(F.count_if(is_video).alias("videos")).where("videos <> 1")


def log_time_column(columns: Sequence[str]) -> str:
    """The one column that ends in `` log time``."""
    found = [c for c in columns if c.endswith(" log time") or c.endswith("_log_time")]
    if len(found) != 1:
        raise ValueError(f"expected one log time column, found {found}")
    return found[0]


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation sheet to one row per participant and scenario.

    The sheet has one row per participant: two header rows, then three blocks of eight
    scenario columns (anomalies, hazard outcome, crashes).
    """
    block = len(ANNOTATED_SCENARIOS)
    names = ["participant_name"] + [f"{kind}{i}" for kind in "ahc" for i in range(block)]
    schema = ", ".join(f"{n} string" for n in names)
    # rows of a file are numbered from its first part on: its first two lines are the headers
    lines = spark.read.text(path).select("value", (F.col("_metadata.file_block_start") == 0).alias("__first"), F.monotonically_increasing_id().alias("__at"))
    begins = lines.where("__first").agg(F.min("__at")).scalar()
    body = lines.where(~F.col("__first") | (F.col("__at") > begins + 1)).where("trim(value) <> ''")
    cells = body.select(F.from_csv("value", schema).alias("c")).select("c.*")
    kept = cells.where(F.col("participant_name").rlike("^[P7]"))
    per_scenario = F.array(
        *[
            F.struct(
                F.lit(s).alias("scenario_short"),
                *[F.coalesce(F.col(f"{k}{i}"), F.lit("")).alias(k) for k in "ahc"],
            )
            for i, s in enumerate(ANNOTATED_SCENARIOS)
        ]
    )
    long = kept.select("participant_name", F.inline(per_scenario))
    return long.select(
        "participant_name",
        "scenario_short",
        anomaly_intervals("a").alias("anomalies"),
        hazard_outcome("h").alias("number_hazard_crashes"),
        crash_total("c").alias("number_all_crashes"),
    )


def scan_folds(spark: SparkSession, path: str) -> DataFrame:
    """Ragged fold file: the line number is the fold, the cells are its participants."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("fold", "line"))
    cells = lines.select("fold", F.explode(F.split("line", ",")).alias("cell"))
    return cells.select(F.trim("cell").alias("participant_name"), "fold").where("participant_name <> ''")


def schedule_file(scenario: str, task: str) -> str:
    """Answer schedule of a scenario and task."""
    number = SCHEDULE_PATTERNS[scenario]
    names = {"nback_task": f"nback/nback_every2.5_pttn{number}.csv", "statement_task": f"statement/state_pttn{number}.csv"}
    if task not in names:
        raise ValueError(f"no schedule for task {task!r}")
    return names[task]


def schedule_pattern(scenario: Column) -> Column:
    """Pattern number of a scenario directory, NULL without a schedule."""
    table = F.create_map(*[F.lit(v) for item in SCHEDULE_PATTERNS.items() for v in item])
    return F.try_element_at(table, scenario)


def scan_schedules(spark: SparkSession, root: str, task: str) -> DataFrame:
    """All schedules of a task with their pattern number: a table of eight short files."""
    folder = {"nback_task": "nback", "statement_task": "statement"}[task]
    rows = read_tree(spark, f"{root}/{folder}", "*.csv", clean=False).drop(*LEVELS)
    number = F.regexp_extract("__path", r"pttn(\d+)\.csv", 1).cast("int")
    numeric = ("startime", "digit", "start_response", "end_response")
    return rows.select(number.alias("pattern"), *[F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in rows.columns if c != "__path"])


def list_participants(index: DataFrame, version: str = "all", participant: str = "participant_name") -> DataFrame:
    """Distinct participants of a study version, in order."""
    people = index.select(participant).where(F.col(participant).startswith(STUDY_PREFIXES[version])).distinct()
    return people.orderBy(participant)


def read_scenario_tables(spark: SparkSession, root: str, file: str = "key_scenario_timings.csv", numbers: Sequence[str] = ()) -> DataFrame:
    """Timing tables of all participants, with the participant's name; the columns ``numbers`` as double, the others as they stand."""
    rows = read_tree(spark, root, file, clean=False).drop(*LEVELS)
    name = F.regexp_extract(PATH, r"/([^/]+)/[^/]+$", 1)
    cells = [nan_to_null(F.col(f"`{c}`").try_cast("double")).alias(c) if c in numbers else F.col(f"`{c}`") for c in rows.columns if c != PATH]
    return rows.select(name.alias("participant_name"), *cells)


def find_one(
    listing: DataFrame, participant: str, scenario: str, file: str, round: int | None = None, task: str | None = None, path: str = "path"
) -> DataFrame:
    """The single file that matches, or no row when none or several do.

    Stationary tasks exist in both rounds, so they need the round.
    """
    from driverscope.operators.index import glob_to_regex

    stationary = ("choice_reaction", "fixed_gaze", "gaze_tracking", "silent_reading")
    if scenario in stationary and round is None:
        raise ValueError("a stationary task needs its round")
    part = f"R{round}" if round is not None else "*"
    if scenario in stationary:
        place = f"stationary*/{scenario}"
    elif scenario == "tobii_calibration":
        place = scenario
    else:
        place = f"driving/{scenario}*/{task or '*'}"
    regex = glob_to_regex(f"*/{participant}/{part}/{place}/{file}").replace(".*", "[^/]*").replace("^(?s:[^/]*/", "^(?s:.*/")
    found = listing.where(F.col(path).rlike(regex))
    return found.where(found.agg(F.count(F.lit(1))).scalar() == 1)


def find_each(listing: DataFrame, wanted: DataFrame, file: str, path: str = "path") -> DataFrame:
    """Every wanted recording with the one listed file that matches it; none or several give no row.

    ``wanted`` has participant_name, the beginning of a scenario's name, and round and task, NULL for any. The listing's
    paths are taken apart once and met by participant.
    """
    named = listing.withColumns({f"__{k}": v for k, v in path_parts(path).items()}).where(F.col(path).endswith(f"/{file}"))
    asked = wanted.withColumn("__wanted", F.monotonically_increasing_id())
    met = asked.join(named, F.col("participant_name") == F.col("__participant_name"))
    fits = F.col("__scenario").startswith(F.col("scenario")) & F.coalesce(F.col("__round") == F.concat(F.lit("R"), F.col("round").cast("string")), F.col("round").isNull())
    found = met.where(fits & F.coalesce(F.col("__task") == F.col("task"), F.col("task").isNull()))
    inner = [c for c in found.columns if not c.startswith("__")]
    once = found.groupBy("__wanted").agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*inner)).alias("__row"))
    return once.where("__n = 1").select("__row.*")


def scan_array_dict(spark: SparkSession, path: str) -> DataFrame:
    """Array tables are Parquet: one row per recording with the times and named arrays."""
    return spark.read.parquet(path)


def wrong_lengths(df: DataFrame, arrays: Sequence[str], times: str = "times") -> DataFrame:
    """Rows in which an array has neither one entry nor one per time."""
    bad = [~(F.size(a).isin(1) | (F.size(a) == F.size(times))) for a in arrays]
    wrong = bad[0]
    for test in bad[1:]:
        wrong = wrong | test
    return df.where(wrong)


def slice_arrays(df: DataFrame, arrays: Sequence[str], start: Column, end: Column, times: str = "times") -> DataFrame:
    """Entries within [start, end]; arrays of length one apply to all times and stay."""
    inside = F.filter(F.transform(times, lambda t, i: F.when(t.between(start, end), i)), lambda i: i.isNotNull())
    picked = {
        a: F.when((F.size(a) == 1) & (F.size(times) != 1), F.col(a)).otherwise(F.transform(inside, lambda i: F.get(F.col(a), i)))
        for a in arrays
    }
    kept = df.select("*", *[c.alias(f"__{a}") for a, c in picked.items()], F.filter(times, lambda t: t.between(start, end)).alias("__times"))
    return kept.drop(*arrays, times).withColumnsRenamed({f"__{a}": a for a in arrays} | {"__times": times})


def cache_features(spark: SparkSession, path: str, compute, recache: bool = False) -> DataFrame:
    """Read a feature table if it has been written, else compute, write and read it.

    A written table survives lost executors and cuts the lineage of what follows.
    """
    if not recache:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def predictions_schema() -> T.StructType:
    return T.StructType.fromDDL("fold int, repeat int, sample bigint, task string, gt int, prob double")


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all experiments, folds and repeats found; an empty table when there are none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], predictions_schema())


def merge_single_tasks(predictions: DataFrame, keys: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """Predictions of single-task experiments side by side: ``gt_<task>`` and ``prob_<task>``."""
    cells = [
        e
        for t in tasks
        for e in (
            F.max(F.when(F.col("task") == t, F.col("gt"))).alias(f"gt_{t}"),
            F.max(F.when(F.col("task") == t, F.col("prob"))).alias(f"prob_{t}"),
        )
    ]
    return predictions.groupBy(*keys).agg(*cells)
