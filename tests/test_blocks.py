"""Python steps over groups and blocks: NULL and 64-bit keys, repeated times, other columns, recordings without a cut."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_motion import one_pass_fixations, one_pass_reversals, sample_by_sample, walk

from driverscope.operators import gaze, sequential, steering
from driverscope.operators.ordered import time_bin

SECOND = 1_000_000_000
BIG = 2**53 + 1
KEYS = [(1, "a"), (None, "a"), (None, None), (BIG, "a"), (BIG + 1, "a"), (BIG + 1, None)]


def by_key(rows, size=2):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[:size]), []).append(tuple(r[size:]))
    return {k: sorted(v) for k, v in out.items()}


def test_fixations_of_odd_keys(spark):
    rng, data, want = random.Random(4), [], {}
    for r, s in KEYS:
        xs, ys = walk(rng, 300, 3.0, 20.0), walk(rng, 300, 3.0, 20.0)
        rows = [(i * 16_666_667, xs[i], ys[i]) for i in range(300)]
        data += [(r, s, *row) for row in rows]
        want[r, s] = one_pass_fixations(rows, 6.0, 50e6)
    df = spark.createDataFrame(data, "r long, s string, t_ns long, x_mm double, y_mm double").repartition(5)
    got = gaze.detect_fixations(df, ["r", "s"], SECOND, max_distance=6.0, min_ms=50.0)
    assert by_key(got.collect()) == want


def test_a_gaze_that_never_moves_is_one_fixation_over_all_blocks(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("r"), (F.col("id") * 16_666_667).alias("t_ns"), F.lit(1.0).alias("x_mm"), F.sin(F.col("id") / 999).alias("y_mm"))
    got = gaze.detect_fixations(df, ["r"], 10 * SECOND, max_distance=3.0).collect()
    assert [tuple(r) for r in got] == [(None, 16_666_667, 19_999 * 16_666_667)]
    marked = gaze.mark_intervals(df.where("t_ns < 100000000"), gaze.detect_fixations(df, ["r"], 10 * SECOND, max_distance=3.0), ["r"], "fixation", SECOND)
    assert [r.fixation for r in marked.orderBy("t_ns").collect()] == [0, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("reach", [0.4, 1.5, 30.0])
def test_smooth_gaze_runs_in_blocks(spark, reach):
    """20,000 smooth samples: many bounded blocks, the result of one pass."""
    rows = [(i * 16_666_667, math.sin(i / 400) * 2, math.cos(i / 300) * 2) for i in range(20_000)]
    df = spark.createDataFrame([(7, *r) for r in rows], "r long, t_ns long, x_mm double, y_mm double")
    assert df.groupBy(time_bin("t_ns", 10 * SECOND)).count().agg(F.max("count")).first()[0] <= 601
    got = gaze.detect_fixations(df, ["r"], 10 * SECOND, max_distance=reach, min_ms=50.0)
    assert sorted((a, b) for _, a, b in got.collect()) == one_pass_fixations(rows, reach, 50e6)


def test_samples_without_time_or_place_take_no_part(spark):
    df = spark.createDataFrame([(1, None, 0.0, 0.0), (1, 0, 0.0, 0.0), (1, 5, None, 0.0), (1, 10, 0.0, 0.0), (1, 20, 0.0, 0.0)], "r int, t_ns long, x_mm double, y_mm double")
    assert [tuple(r) for r in gaze.detect_fixations(df, ["r"], 7, min_ms=0.0).collect()] == [(1, 10, 20)]


def test_reversals_of_odd_keys_and_repeated_times(spark):
    rng, data, want = random.Random(6), [], set()
    for n, (r, s) in enumerate(KEYS):
        values = walk(rng, 200, 2.0, 0.0)
        data += [(r, s, i, v, f"{n}-{i}") for i, v in enumerate(values)]
        want |= {f"{n}-{i}" for i in one_pass_reversals(values, 2.5)}
    df = spark.createDataFrame(data, "r long, s string, t_ns long, v double, name string").repartition(5)
    got = steering.with_reversals(df, ["r", "s"], "v", 2.5, 20).collect()
    assert {r.name for r in got if r.reversal} == want and len(got) == len(data) and {(r.r, r.s) for r in got} == set(KEYS)
    # two rows of one time: each has its own answer and stays one row
    tied = df.union(df.withColumn("v", F.col("v") + 100).withColumn("name", F.concat("name", F.lit("+"))))
    marked = steering.mark_reversals(tied, ["r", "s"], "v", [2.5], 20).collect()
    assert len(marked) == 2 * len(data) and len({r.name for r in marked}) == 2 * len(data)


@pytest.mark.parametrize("theta", [0.5, 3.0])
def test_smooth_steering_runs_in_blocks(spark, theta):
    values = [math.sin(i / 500) + math.sin(i / 37) / 3 for i in range(20_000)]
    df = spark.createDataFrame([(None, i, v) for i, v in enumerate(values)], "r long, t_ns long, v double")
    got = steering.steering_reversals(df, ["r"], "v", theta, 500).collect()
    assert {r.t_ns for r in got} == one_pass_reversals(values, theta)


def test_smoothing_keeps_rows_of_odd_keys_and_repeated_times(spark):
    rng = np.random.default_rng(2)
    values = {k: np.cumsum(rng.normal(size=40)) for k in KEYS}
    data = [(*k, (i // 2) * SECOND // 10, float(v), f"{i}") for k, x in values.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "r long, s string, t_ns long, angle double, name string").repartition(3)
    got = steering.smooth_low_pass(df, ["r", "s"], "angle", SECOND, segment=1).collect()
    assert len(got) == len(data) and {(r.r, r.s) for r in got} == set(KEYS)
    for key, x in values.items():
        own = {r.name: r.smoothed for r in got if (r.r, r.s) == key}
        order = sorted(range(40), key=lambda i: (i // 2, x[i]))
        np.testing.assert_allclose([own[str(i)] for i in order], sample_by_sample(x[order], 2.0, 10.0), rtol=0, atol=1e-9)


def test_kinematics_of_odd_keys(spark):
    data = [(*k, i * SECOND // 10, i * 0.3, i * 0.1 - 0.001 * i * i, 0.0, 0.0, 0.1, 0.9, f"{i}") for k in KEYS for i in range(60)]
    df = spark.createDataFrame(data, "r long, s string, t_ns long, pose_x double, pose_y double, qx double, qy double, qz double, qw double, name string").repartition(4)
    got = steering.with_kinematics(df, ["r", "s"], segment_s=2).collect()
    assert len(got) == len(data) and {(r.r, r.s) for r in got} == set(KEYS)
    assert all(r.lateral_speed is not None and r.longitudinal_jerk is not None for r in got)
    one = {r.name: r.lateral_speed for r in got if (r.r, r.s) == (1, "a")}
    assert all(r.lateral_speed == pytest.approx(one[r.name]) for r in got)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_end_where_any_key_changes(size):
    keys = [None, None, BIG, BIG, BIG + 1, None, None, 4]
    extra = [float("nan"), float("nan"), 1.0, float("nan"), float("nan"), None, None, None]
    table = pa.table({"a": pa.array(keys, pa.int64()), "b": pa.array(extra, pa.float64())})
    sizes = [len(s) and list(np.diff([*s, t.num_rows])) for t, s in sequential.whole_groups(iter(table.to_batches(max_chunksize=size)), ["a", "b"])]
    assert sum(sizes, []) == [2, 1, 1, 1, 2, 1]


def test_added_columns_and_kept_types(spark):
    df = spark.sql("SELECT id % 3 AS k, id, timestamp_micros(id) AS at, decimal(id) AS d, array(id) AS a FROM range(10)")
    out = sequential.map_groups(df, ["k"], ["id"], ["id"], lambda g: (np.array([len(g["id"]) - 1]), {"n": [len(g["id"])], "x": [float("nan")], "raw": [b"a\0"]}), ["k", "at", "d", "a"], [T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("raw", T.BinaryType())])
    got = sorted((r.k, int(r.d), r.a, r.n, r.x, bytes(r.raw)) for r in out.collect())
    assert got == [(0, 9, [9], 4, None, b"a\0"), (1, 7, [7], 3, None, b"a\0"), (2, 8, [8], 3, None, b"a\0")]


@pytest.mark.parametrize("width", [1, 3, 50])
def test_sounding_segments_equal_one_pass(spark, width):
    from driverscope.operators import audio

    rng, data, want = random.Random(width), [], {}
    for k in (1, None, BIG, BIG + 1):
        loud = [rng.random() < 0.7 for _ in range(120)]
        seen = [i for i in range(120) if rng.random() < 0.9]
        data += [(k, i * 100 + j, (0.5 if loud[i] else 0.0) if j == 50 else None) for i in seen for j in (10, 50)]
        found, start = [], None
        for i in seen:
            if loud[i] and start is None:
                start = i
            elif not loud[i] and start is not None:
                found.append((start * 100, (i + 1) * 100))
                start = None
        want[k] = found
    df = spark.createDataFrame(data, "r long, t long, level double").repartition(4)
    got = audio.sounding_segments(df, ["r"], "t", "level", 100, slot_steps=width).collect()
    assert {k: sorted((r.start, r.end) for r in got if r.r == k) for k in want} == want
