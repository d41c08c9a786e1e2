"""Grids, chunks, aggregates: the edge cases, by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driverscope.operators.aggregates import AGGREGATES, aggregate_builder, aggregate_chunks, normaliser_keys
from driverscope.operators.chunks import ChunkSpec, chunk_recordings, default_fps, frame_grid, overlapping, rows_in_chunks
from driverscope.operators.ordered import time_bin
from driverscope.schema import Aggregate

SECOND = 1_000_000_000


def recording(spark, seconds, anomalies=()):
    schema = "r int, start_time long, end_time long, anomalies array<struct<start_ns: long, end_ns: long>>"
    return spark.createDataFrame([(1, 0, int(seconds * SECOND), list(anomalies))], schema)


def cut(spark, seconds, anomalies=(), **options):
    spec = ChunkSpec(**{"fps": 10, "per_recording": None, **options})
    rows = chunk_recordings(recording(spark, seconds, anomalies), spec, ["r"], anomalies="anomalies")
    return [(r.chunk_number, r.start_ns, r.end_ns) for r in rows.orderBy("chunk_number").collect()]


@pytest.mark.parametrize("fps", [7, 10, 60])
def test_grid_follows_integer_division(spark, fps):
    start, end = 3 * SECOND + 12345, 5 * SECOND + 999
    want = [x // fps for x in range(start * fps, end * fps, SECOND)]
    want = [w - want[0] for w in want]
    df = spark.createDataFrame([(start, end)], "start_time long, end_time long")
    # times count from the recording's start
    got = [r.t_ns for r in frame_grid(df, fps).orderBy("frame").collect()]
    assert len(got) == len(want) and max(abs(a - b) for a, b in zip(got, want)) <= 1
    assert [r.t_ns for r in frame_grid(spark.createDataFrame([(0, end)], "start_time long, end_time long"), fps).orderBy("frame").collect()] == [
        x // fps for x in range(0, end * fps, SECOND)
    ]


def test_grid_in_blocks_is_the_same(spark):
    df = recording(spark, 100)
    a = frame_grid(df, 60).select("frame", "t_ns").collect()
    b = frame_grid(df, 60, keys=["r"], block=123).select("frame", "t_ns").collect()
    assert sorted(a) == sorted(b) and len(a) == 6000


def test_grid_of_nothing_and_of_end_points(spark):
    assert frame_grid(recording(spark, 0), 10).count() == 0
    assert [r.t_ns for r in frame_grid(recording(spark, 2), 0).collect()] == [0, 2 * SECOND]


def test_chunk_length_is_duration_times_fps(spark):
    for _, start, end in cut(spark, 60, duration=10.0, stride=5.0, strategy="start"):
        assert (end - start) == 99 * SECOND // 10


def test_chunk_longer_than_recording(spark):
    assert cut(spark, 5, duration=10.0, strategy="end") == []


def test_negative_offsets_count_from_the_other_end(spark):
    found = cut(spark, 60, duration=10.0, stride=10.0, strategy="start", start_offset=-30.0)
    assert [n for n, _, _ in found] == [0, 1, 2] and found[0][1] == 30 * SECOND


def test_anomaly_touching_by_one_frame_end_drops_the_chunk_but_keeps_numbers(spark):
    plain = cut(spark, 60, duration=10.0, stride=10.0, strategy="start")
    touch = [(plain[1][2], plain[1][2] + 1)]
    assert [n for n, _, _ in cut(spark, 60, touch, duration=10.0, stride=10.0, strategy="start")] == [0, 2, 3, 4, 5]
    beyond = [(plain[1][2] + 1, plain[1][2] + 2)]
    assert len(cut(spark, 60, beyond, duration=10.0, stride=10.0, strategy="start")) == 6
    half = [(0, 5 * SECOND)]
    assert len(cut(spark, 60, half, duration=10.0, stride=10.0, strategy="start", remove_anomalies=0.6)) == 6


def test_full_chunk_ignores_anomalies(spark):
    assert cut(spark, 60, [(0, 60 * SECOND)], strategy="full", fps=10) == [(0, 0, 599 * SECOND // 10)]


def test_random_chunks_are_admissible_distinct_and_repeatable(spark):
    options = dict(strategy="random", duration=5.0, per_recording=6, fps=2)
    found = cut(spark, 40, [(10 * SECOND, 20 * SECOND)], **options)
    assert found == cut(spark, 40, [(10 * SECOND, 20 * SECOND)], **options)
    assert len({s for _, s, _ in found}) == 6
    assert all(e < 10 * SECOND or s > 20 * SECOND for _, s, e in found)


@pytest.mark.parametrize("strategy", ["start", "end"])
def test_rows_in_chunks_equals_range_join(spark, strategy):
    spec = ChunkSpec(strategy=strategy, duration=7.0, stride=2.5, per_recording=None, fps=10, start_offset=1.0, end_offset=2.0)
    few = recording(spark, 31.4, [(9 * SECOND, 10 * SECOND)])
    rows = spark.range(3000).select(F.lit(1).alias("r"), (F.col("id") * 10_666_667).alias("t_ns"))
    got = rows_in_chunks(rows, few, spec, ["r"], anomalies="anomalies", slot=SECOND).select("t_ns", "chunk_number")
    chunks = chunk_recordings(few, spec, ["r"], anomalies="anomalies")
    want = rows.join(chunks, "r").where("t_ns BETWEEN start_ns AND end_ns").select("t_ns", "chunk_number")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        aggregate_builder("mode")
    with pytest.raises(ValueError):
        normaliser_keys("planet", "p")
    with pytest.raises(ValueError):
        cut(spark, 10, strategy="middle")
    assert default_fps([10, 60]) == 60 and default_fps([]) == 0


def aggregates(spark, values, functions, second=None, fps=1.0, bin=None, **options):
    data = [(1, i, *(v if isinstance(v, tuple) else (v, None))) for i, v in enumerate(values)]
    rows = spark.createDataFrame(data, "c int, t_ns long, a double, b double")
    wanted = [Aggregate(("a", "b") if second else ("a",), f, "z") for f in functions]
    row = aggregate_chunks(rows, ["c"], wanted, fps, bin=bin, **options).collect()[0]
    return [row[w.output] for w in wanted]


def test_gap_counts_for_complexity_but_not_for_changes(spark):
    values = [1.0, None, 0.0, 1.0]
    changes, complexity = aggregates(spark, values, ["change_rate", "cid_ce"])
    assert changes == pytest.approx(2 / (3 / 60))
    seen = [1.0, 0.0, 1.0]
    sd = math.sqrt(sum((v - 2 / 3) ** 2 for v in seen) / 3)
    assert complexity == pytest.approx(1 / sd)


@pytest.mark.parametrize("bin", [None, 2])
def test_neighbours_across_bins(spark, bin):
    values = [1.0, 0.0, None, None, 1.0, 1.0, 0.0]
    got = aggregates(spark, values, ["change_rate", "cid_ce"], bin=None if bin is None else time_bin("t_ns", bin))
    assert got[0] == pytest.approx(3 / (5 / 60))


def test_signs_constants_and_emptiness(spark):
    assert aggregates(spark, [-1.0, -3.0], ["pos_mean", "neg_mean", "abs_mean"]) == [0.0, 2.0, 2.0]
    assert aggregates(spark, [2.0, 2.0], ["std", "cid_ce", "skewness", "sum_rate"]) == [0.0, 0.0, None, 120.0]
    assert aggregates(spark, [None, None], sorted(AGGREGATES)) == [None] * len(AGGREGATES)


def test_pooled_columns_weigh_by_count_and_an_empty_column_poisons(spark):
    both = [(1.0, 10.0), (3.0, None), (5.0, None)]
    assert aggregates(spark, both, ["mean"], second=True) == [pytest.approx((3 * 3 + 10) / 4)]
    gone = [(1.0, None), (3.0, None)]
    assert aggregates(spark, gone, ["mean", "pos_mean"], second=True) == [None, 2.0]
    assert aggregates(spark, gone, ["mean"], second=True, poison_empty=False) == [2.0]
    with pytest.raises(ValueError):
        Aggregate(("a", "b"), "mean").output


def test_overlapping_reports_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 250, 250)], "k int, s long, e long")
    b = spark.createDataFrame([(1, 100, 400), (1, 101, 120)], "k int, p long, q long")
    found = overlapping(a, b, ["k"], ("s", "e"), ("p", "q"), 10).select("s", "p").collect()
    assert sorted(found) == [(0, 100), (250, 100)]


def test_feature_set_keeps_chunks_without_rows(spark):
    """Two recordings with a chunk each; only one has rows. Unknown normalisations raise."""
    from driverscope.plans.feature_set import feature_set
    from driverscope.schema import Aggregate, FeatureSpec

    shown = spark.createDataFrame([("a", 0, 100 * SECOND), ("b", 0, 100 * SECOND)], "r string, start_time long, end_time long")
    rows = spark.range(1000).select(F.lit("a").alias("r"), (F.col("id") * (SECOND // 10)).alias("t"), F.col("id").cast("double").alias("v"))
    spec = ChunkSpec(strategy="start", duration=50.0, stride=50.0, fps=10, per_recording=None)
    source = FeatureSpec("s", "s", 10, aggregates=(Aggregate(("v",), "mean"),))
    found = feature_set({"s": rows}, shown, ["r"], [source], spec, time="t").collect()
    assert sorted(((x.r, x.chunk_number, x.v__mean) for x in found), key=repr) == [("a", 0, 249.5), ("a", 1, 749.5), ("b", 0, None), ("b", 1, None)]
    scaled = FeatureSpec("s", "s", 10, aggregates=source.aggregates, normalize="subject", normalize_aggregate="subject")
    by_subject = feature_set({"s": rows}, shown, ["r"], [scaled], spec, time="t", subject="r").where("r = 'a'").orderBy("chunk_number").collect()
    assert [round(x.v__mean, 9) for x in by_subject] == [round(-(0.5**0.5), 9), round(0.5**0.5, 9)]
    wrong = FeatureSpec("s", "s", 10, aggregates=source.aggregates, normalize="z")
    with pytest.raises(ValueError):
        feature_set({"s": rows}, shown, ["r"], [wrong], spec, time="t")


@pytest.mark.parametrize("fps, length, limit", [(1, 5, 0.0), (3, 7, 0.0), (7, 4, 0.3), (60, 90, 0.5), (10, 1, 0.0), (3, 6, 1.0)])
def test_free_starts_equal_trying_every_frame(spark, fps, length, limit):
    from driverscope.operators.chunks import blocked, blocked_starts, frame_ns, open_starts

    rng = random.Random(fps * length)
    data = []
    for r in range(40):
        spans = [(a, a + rng.choice([0, 1, rng.randrange(3 * SECOND)])) for a in (rng.randrange(-SECOND, 12 * SECOND) for _ in range(rng.randrange(5)))]
        data.append((r, rng.randrange(0, 4), rng.randrange(0, 10 * fps), spans + ([(5, None), (9, 3)] if r % 5 == 0 else [])))
    df = spark.createDataFrame(data, "r int, first long, last long, a array<struct<start_ns:bigint,end_ns:bigint>>")
    found = df.select("r", "first", "last", open_starts(blocked_starts(F.col("a"), length, fps, limit), F.col("first"), F.col("last")).alias("o")).collect()
    every = df.where("last >= first").select("r", "a", F.explode(F.sequence("first", "last")).alias("f"))
    free = every.where(~blocked(frame_ns(F.col("f"), fps), frame_ns(F.col("f") + length - 1, fps), F.col("a"), limit))
    want = {}
    for row in free.collect():
        want.setdefault(row.r, set()).add(row.f)
    for row in found:
        ends = [s.before for s in row.o.segments[1:]] + [row.o.total]
        got = {s.start + k for s, e in zip(row.o.segments, ends) for k in range(e - s.before)}
        assert got == want.get(row.r, set()) and row.o.total == len(got)


def test_every_set_of_starts_is_as_likely(spark):
    """Pairs out of eight admissible starts, of 9,000 recordings: each of the 28 about 321 times."""
    few = spark.range(9_000).select(F.col("id").alias("r"), F.lit(0).cast("long").alias("start_time"), F.lit(16 * SECOND).alias("end_time"), F.array(F.struct(F.lit(6 * SECOND).alias("start_ns"), F.lit(7 * SECOND).alias("end_ns"))).alias("anomalies"))
    spec = ChunkSpec(strategy="random", duration=4.0, per_recording=2, fps=1)
    cut = chunk_recordings(few, spec, ["r"], anomalies="anomalies")
    starts = cut.groupBy("r").agg(F.array_sort(F.collect_list(F.expr("start_ns div 1000000000"))).alias("s"))
    counts = {tuple(x.s): x["count"] for x in starts.groupBy("s").count().collect()}
    admissible = [0, 1, 2, 8, 9, 10, 11, 12]
    assert len(counts) == 28 and {v for k in counts for v in k} == set(admissible)
    assert all(200 < n < 450 for n in counts.values())
    all_of_them = chunk_recordings(few.limit(3), ChunkSpec(strategy="random", duration=4.0, per_recording=99, fps=1), ["r"], anomalies="anomalies")
    assert all_of_them.groupBy("r").agg(F.count_distinct("start_ns").alias("n"), F.max("chunk_number").alias("m")).select("n", "m").distinct().collect() == [(8, 7)]


def test_random_chunks_unfold_no_frames(spark):
    """A recording of 10,000 hours at 60 frames a second: two billion frames, four chunks, at once."""
    long = spark.createDataFrame([(1, 0, 36_000_000 * SECOND)], "r int, start_time long, end_time long")
    found = chunk_recordings(long, ChunkSpec(strategy="random", duration=10.0, per_recording=4, fps=60), ["r"]).collect()
    assert len({r.start_ns for r in found}) == 4 and all(r.end_ns - r.start_ns == 599 * SECOND // 60 or abs(r.end_ns - r.start_ns - 599 * SECOND / 60) < 2 for r in found)
