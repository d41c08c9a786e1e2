"""The study's main feature set: ten chunk features from five tables at two frame rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from driverscope.operators.aggregates import aggregate_chunks, on_chunks, z_scores
from driverscope.operators.chunks import ChunkSpec, chunk_recordings, default_fps, rows_in_chunks
from driverscope.schema import TIME, Aggregate, FeatureSpec

# Tables, rates, columns and functions of the set "main".
DERIVED_10, RAW_60, DERIVED_60 = "Resampled_previous_10_derived", "Resampled_previous_60", "Resampled_previous_60_derived"
MAIN = (
    FeatureSpec(
        "ego_tracks",
        DERIVED_10,
        10,
        columns=("carla_objects_pose_x", "carla_objects_pose_y"),
        aggregates=(
            Aggregate(("longitudinal_speed",), "pos_mean"),
            Aggregate(("longitudinal_acceleration",), "pos_mean"),
            Aggregate(("longitudinal_acceleration",), "neg_mean"),
        ),
    ),
    FeatureSpec(
        "steering_reversals",
        DERIVED_10,
        10,
        aggregates=(Aggregate(("reversals_0_5",), "sum_rate"), Aggregate(("reversals_2_5",), "sum_rate")),
    ),
    FeatureSpec(
        "experiment_tobii_frame",
        RAW_60,
        60,
        aggregates=(Aggregate(("tobii_left_eye_pupil_diameter", "tobii_right_eye_pupil_diameter"), "mean", "tobii_eye_pupil_diameter"),),
    ),
    FeatureSpec(
        "gaze_pitch_yaw",
        DERIVED_60,
        60,
        aggregates=(
            Aggregate(("gaze_left_pitch", "gaze_right_pitch"), "std", "gaze_pitch"),
            Aggregate(("gaze_left_yaw", "gaze_right_yaw"), "std", "gaze_yaw"),
        ),
    ),
    FeatureSpec(
        "gaze_fixation_saccade",
        DERIVED_60,
        60,
        aggregates=(
            Aggregate(("gaze_left_saccade", "gaze_right_saccade"), "change_rate", "gaze_saccade"),
            Aggregate(("gaze_left_fixation", "gaze_right_fixation"), "change_rate", "gaze_fixation"),
        ),
    ),
)
# The chunk the condition tests look at, 90 s that end 30 s before the recording does.
TEST_CHUNK = ChunkSpec(strategy="end", duration=90.0, end_offset=30.0, per_recording=1)


def feature_set(
    tables: Mapping[str, DataFrame],
    recordings: DataFrame,
    keys: Sequence[str],
    specs: Sequence[FeatureSpec] = MAIN,
    chunk: ChunkSpec = TEST_CHUNK,
    anomalies: str | None = None,
    time: str = TIME,
    order: Sequence[str] | None = None,
    subject: str = "participant_name",
    train: Column | None = None,
) -> DataFrame:
    """One row per chunk of every recording with the aggregates of every table at hand.

    Chunks are cut on the grid of the fastest table unless the spec names a rate. A
    table, a column or a chunk's rows that a recording lacks leave NULLs. ``order`` settles the order
    of rows at one time. A spec's ``normalize`` turns the rows of its chunks to z-scores before they
    are summed up, ``normalize_aggregate`` the chunks' aggregates after; ``train``, a condition on
    the keys, names the rows that population statistics come from (all by default).
    """
    spec = chunk if chunk.fps is not None else chunk.at(default_fps([s.fps for s in specs]))
    chunk_keys = [*keys, "chunk_number"]
    chunks = chunk_recordings(recordings, spec, keys, anomalies=anomalies).select(*chunk_keys)
    parts: dict[str, DataFrame] = {}
    for source in specs:
        if source.name not in tables:
            continue
        table = tables[source.name]
        wanted = [a for a in source.aggregates if set(a.columns) <= set(table.columns)]
        if wanted:
            rows = rows_in_chunks(table, recordings, spec, keys, time=time, anomalies=anomalies)
            inputs = list(dict.fromkeys(c for a in wanted for c in a.columns))
            rows = z_scores(rows, inputs, source.normalize, subject, train)
            found = aggregate_chunks(rows, chunk_keys, wanted, source.fps, order=order or [time])
            parts[source.name] = z_scores(found, [a.output for a in wanted], source.normalize_aggregate, subject, train)
    return on_chunks(chunks, parts.values(), chunk_keys)
