"""Gaze, steering and kinematics against one straightforward pass over each recording."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driverscope.functions.geometry import gaze_pixel, quaternion_yaw, rotate
from driverscope.operators import gaze, steering, tracks

SECOND = 1_000_000_000


def walk(rng, size, step, jump):
    x, out = 0.0, []
    for _ in range(size):
        x += rng.uniform(-step, step) + (rng.choice([-1, 1]) * jump if rng.random() < 0.03 else 0)
        out.append(x)
    return out


def one_pass_fixations(rows, distance, least):
    found, anchor, began, last = [], None, None, None
    for t, x, y in rows:
        if anchor is None:
            anchor = (x, y)
        elif began is None:
            near = math.dist(anchor, (x, y)) <= distance
            anchor = (x, y)
            began = t if near else None
        elif math.dist(anchor, (x, y)) > distance:
            if last - began >= least:
                found.append((began, last))
            anchor, began = (x, y), None
        last = t
    if began is not None and last - began >= least:
        found.append((began, last))
    return found


@pytest.mark.parametrize("jump", [0.0, 30.0])
def test_fixations_equal_one_pass(spark, jump):
    rng = random.Random(3)
    data, want = [], []
    for r in range(4):
        xs, ys = walk(rng, 500, 3.0, jump), walk(rng, 500, 3.0, jump)
        rows = [(r, i * 16_666_667, xs[i], ys[i]) for i in range(500)]
        data += [(a, b, None if rng.random() < 0.05 else c, d) for a, b, c, d in rows]
        want += [(r, *f) for f in one_pass_fixations([x[1:] for x in data if x[0] == r and x[2] is not None], 6.0, 50e6)]
    df = spark.createDataFrame(data, "r int, t_ns long, x_mm double, y_mm double").repartition(5)
    got = gaze.detect_fixations(df, ["r"], SECOND, max_distance=6.0, min_ms=50.0)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_fixation_marks_include_rows_inside(spark):
    df = spark.createDataFrame([(1, t, 0.0) for t in range(10)], "r int, t_ns long, v double")
    spans = spark.createDataFrame([(1, 2, 4), (1, 4, 6)], "r int, start long, end long")
    marked = gaze.mark_intervals(df, spans, ["r"], "m", 3).orderBy("t_ns").collect()
    assert [r.m for r in marked] == [0, 0, 1, 1, 1, 1, 1, 0, 0, 0]


def test_pixels_round_half_to_even_and_end_at_the_screen(spark):
    df = spark.createDataFrame([(0.5 / 8,), (1.5 / 8,), (2.5 / 8,), (-0.6 / 8,), (7.6 / 8,), (None,)], "f double")
    assert [r[0] for r in df.select(gaze_pixel("f", 8)).collect()] == [0, 2, 2, None, None, None]


def test_latest_keeps_a_missing_newest_value_and_respects_tolerance(spark):
    frames = spark.createDataFrame([(1, 100), (1, 200), (1, 320)], "r int, t_ns long")
    rows = spark.createDataFrame([(1, 90, 1, 5.0), (1, 95, 2, None), (1, 200, 3, 7.0)], "r int, t_ns long, id int, x double")
    got = gaze.latest_within(frames, rows, ["r"], 100, ["x"], "id").orderBy("t_ns").collect()
    assert [(r.latest_time, r.latest_x) for r in got] == [(95, None), (200, 7.0), (None, None)]


def test_nothing_is_on_screen_from_the_last_frame_on(spark):
    frames = spark.createDataFrame([(1, 0, 0), (1, 10, 1), (1, 20, 2)], "r int, t_ns long, frame int")
    rows = spark.createDataFrame([(1, t, t) for t in (-1, 0, 9, 10, 19, 20, 30)], "r int, t_ns long, id int")
    got = gaze.gaze_in_frames(rows, frames, ["r"], 7).orderBy("t_ns").collect()
    assert [(r.t_ns, r.frame) for r in got] == [(0, 0), (9, 0), (10, 1), (19, 1)]


def sample_by_sample(values, cutoff, fps):
    b, a = steering.butterworth_low_pass(cutoff, fps)
    n = steering.EDGE_ROWS
    x = np.concatenate([2 * values[0] - values[n:0:-1], values, 2 * values[-1] - values[-2 : -n - 2 : -1]])
    # steady state: as if the first value had always been there
    zi = np.linalg.solve(np.array([[1 + a[1], -1], [a[2], 1]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]))

    def once(v):
        z, out = zi * v[0], []
        for u in v:
            y = b[0] * u + z[0]
            z = np.array([b[1] * u - a[1] * y + z[1], b[2] * u - a[2] * y])
            out.append(y)
        return np.array(out)

    return once(once(x)[::-1])[::-1][n:-n]


@pytest.mark.parametrize("size", [10, 57, 1500])
def test_smoothing_equals_the_recursive_filter(spark, size):
    rng = np.random.default_rng(5)
    values = np.cumsum(rng.normal(size=size))
    df = spark.createDataFrame([(1, i * SECOND // 10, float(v)) for i, v in enumerate(values)], "r int, t_ns long, angle double")
    got = steering.smooth_low_pass(df.repartition(4), ["r"], "angle", 5 * SECOND, segment=1).orderBy("t_ns").collect()
    np.testing.assert_allclose([r.smoothed for r in got], sample_by_sample(values, 2.0, 10.0), rtol=0, atol=1e-9)


def test_short_recordings_are_not_smoothed(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(9)], "r int, t_ns long, angle double")
    assert [r.smoothed for r in steering.smooth_low_pass(df, ["r"], "angle", 5).collect()] == [None] * 9


def one_pass_reversals(values, theta):
    hits = set()
    for sign in (1, -1):
        level = None
        for i, v in enumerate(values):
            x = sign * v
            if level is None or x < level:
                level = x
            elif x - level >= theta:
                hits.add(i)
                level = x
    return hits


@pytest.mark.parametrize("step", [0.4, 3.0])
def test_reversals_equal_one_pass(spark, step):
    rng = random.Random(9)
    data, want = [], set()
    for r in range(3):
        values = walk(rng, 300, step, 0.0)
        data += [(r, i, v) for i, v in enumerate(values)]
        want |= {(r, i) for i in one_pass_reversals(values, 2.5)}
    df = spark.createDataFrame(data, "r int, t_ns long, v double").repartition(5)
    got = steering.steering_reversals(df, ["r"], "v", 2.5, 20)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_reversal_columns_and_recordings_without_turning_points(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "r int, t_ns long, v double")
    rows = steering.mark_reversals(df, ["r"], "v", [0.5, 2.5], 5).collect()
    assert {(r.reversals_0_5, r.reversals_2_5) for r in rows} == {(0, 0)}


def test_turning_points_are_maxima_and_flat_steps_only(spark):
    values = [0, 1, 2, 1, 0, 1, 1, 3]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "r int, t_ns long, v double")
    rows = steering.stationary_points(df, ["r"], "v", 3).where("is_stationary").collect()
    assert sorted(r.t_ns for r in rows) == [2, 6]


def test_kinematics_of_an_exact_cubic(spark):
    def at(t):
        return 1 + 2 * t + 0.5 * t**2 - 0.1 * t**3, -3 + t - 0.2 * t**2 + 0.05 * t**3

    data = []
    yaw = 0.7  # heading of the car; the library's yaw is a quarter turn less
    for i in range(200):
        x, y = at(i / 10)
        data.append((1, i * SECOND // 10, x, y, 0.0, 0.0, math.sin(yaw / 2), math.cos(yaw / 2)))
    df = spark.createDataFrame(data, "r int, t_ns long, pose_x double, pose_y double, qx double, qy double, qz double, qw double")
    rows = {r.t_ns: r for r in steering.ego_kinematics(df.repartition(3), ["r"], segment_s=4).collect()}
    assert len(rows) == 200
    a = yaw - math.pi / 2
    for i in (0, 50, 117, 199):
        t, r = i / 10, rows[i * SECOND // 10]
        for kind, dx, dy in (
            ("speed", 2 + t - 0.3 * t**2, 1 - 0.4 * t + 0.15 * t**2),
            ("acceleration", 1 - 0.6 * t, -0.4 + 0.3 * t),
            ("jerk", -0.6, 0.3),
        ):
            assert r[f"lateral_{kind}"] == pytest.approx(dx * math.cos(a) + dy * math.sin(a), abs=1e-5)
            assert r[f"longitudinal_{kind}"] == pytest.approx(dy * math.cos(a) - dx * math.sin(a), abs=1e-5)
        assert r.yaw == pytest.approx(math.degrees(a))


def test_quaternion_and_rotation(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2 * math.sin(0.6), 2 * math.cos(0.6))], "x double, y double, z double, w double")
    assert df.select(quaternion_yaw("x", "y", "z", "w")).first()[0] == pytest.approx(1.2 - math.pi / 2)
    right, ahead = df.select(*rotate(F.lit(1.0), F.lit(0.0), F.lit(math.pi / 2))).first()
    assert (right, ahead) == (pytest.approx(0.0, abs=1e-12), pytest.approx(-1.0))


def test_recordings_with_no_or_two_heroes_are_skipped(spark):
    actors = spark.createDataFrame(
        [(1, 1, "hero"), (1, 2, "x"), (2, 1, "hero"), (2, 2, "hero"), (3, 1, "x")], "recording int, object_id long, role string"
    )
    assert [tuple(r) for r in tracks.single_ego(actors, ["recording"]).collect()] == [(1, 1)]


def test_top_objects_prefers_known_relevance(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 6, 2.0), (1, 7, 2.0), (1, 8, 1.0)], "c int, object_id long, relevance double")
    rows = tracks.top_objects(df, ["c"], 3).orderBy("object_slot").collect()
    assert [r.object_id for r in rows] == [8, 6, 7]


def test_saccades_pass_over_missing_samples(spark):
    data = [(1, 0, 0.0), (1, 10, 0.0), (1, 20, None), (1, 30, 50.0), (1, 40, 50.0)]
    df = spark.createDataFrame([(r, t * 1_000_000, x, 0.0 if x is not None else None) for r, t, x in data], "r int, t_ns long, x_mm double, y_mm double")
    got = gaze.detect_saccades(df, ["r"], SECOND, max_velocity=100.0)
    assert [(r.start, r.end) for r in got.collect()] == [(10_000_000, 30_000_000)]
