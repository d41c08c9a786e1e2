"""Answers, audio, frames, pooling and collation on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from driverscope.functions import frames, text
from driverscope.operators import audio, collate, pooling


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_answers(spark):
    rows = spark.createDataFrame([("Four, or  FIVE!", "4"), ("seven-two", "2"), ("six", "7")], "answer string, gt string")
    scored = audio.score_answers(rows, "nback_task").collect()
    assert [(r.normalised_answer, r.score) for r in scored] == [("4 4 5", 1.0), ("seven-two", 0.0), ("6", 0.0)]
    with pytest.raises(ValueError):
        audio.score_answers(rows, "reading_task")


def test_statement_similarity(spark):
    row = one(spark, "a string, g string", ("james bow yes", "james ball yes"), text.statement_score("a", "g", key=lambda w: w))
    assert row[0] == pytest.approx((1 + (1 - 3 / 4) + 1) / 3)
    assert one(spark, "a string, g string", ("now", "no"), text.correct_misheard("a", "statement_task"))[0] == "no"


@pytest.mark.parametrize("starts, want", [([0.8], True), ([0.2, 0.9], True), ([0.2, 0.3, 0.9], False), ([0.7], False), ([], False)])
def test_answered(spark, starts, want):
    row = ([(s, s + 0.1) for s in starts],)
    assert one(spark, "s array<struct<start: double, end: double>>", row, text.answered("s"))[0] is want


def test_cells(spark):
    def total(cell):
        return one(spark, "c string", (cell,), text.crash_total("c"))[0]

    assert [total(c) for c in ("", "  ", "5", "1,2", "1,")] == [0, 0, 1, 2, 2]
    names = ["driving/6e-vehicle", "driving/practice", "tobii_calibration"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.scenario_short("n")).collect()] == ["6e", "practice", None]


def test_a_sound_must_end_in_silence(spark):
    levels = [0, 9, 9, 0, 0, 9, 0, 9]
    df = spark.createDataFrame([("w", i, float(v)) for i, v in enumerate(levels)], "w string, t long, v double")
    rows = audio.sounding_segments(df, ["w"], "t", "v", 1, slot_steps=3, silence=1.0).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(1, 4), (5, 7)]


def test_misheard_candidates(spark):
    df = spark.createDataFrame([(0.4, [(0.9, 1.0)]), (1.0, [(0.9, 1.0)]), (0.4, [(0.1, 0.2)])], "score double, nonsilent_seg array<struct<start: double, end: double>>")
    assert audio.misheard_answers(df).count() == 1


def test_bits_and_depth(spark):
    df = spark.createDataFrame([(0,), (1,), (2 | 1 << 13 | 1 << 24,), (4 | 1 << 27,), (1 << 40,)], "m long")
    assert [tuple(r) for r in df.select(frames.highest_bit("m"), frames.most_salient("m")).collect()] == [(-1, -1), (0, 0), (24, 13), (27, 2), (40, 40)]
    row = one(spark, "a int, b int, c int", (255, 255, 255), frames.depth_metres("a", "b", "c"))
    assert row[0] == pytest.approx(1000.0)
    assert one(spark, "m double", (0.0,), frames.log_depth("m"))[0] == 0.0
    assert one(spark, "p array<double>", ([3.0, 3.0],), frames.min_max_255("p"))[0] == [0.0, 0.0]


def test_top_scores(spark):
    scores = [0.1, 0.9, 0.3, 0.9, 0.5]
    row = one(spark, "s array<double>", (scores,), pooling.top_mean(F.col("s"), 0.4), pooling.top_gap(F.col("s"), 0.4), pooling.top_gap(F.col("s"), 0.1), pooling.spread(F.col("s")))
    assert row[0] == pytest.approx(0.9) and row[1] == 2.0 and row[2] is None
    mean = sum(scores) / 5
    assert row[3] == pytest.approx(math.sqrt(sum((s - mean) ** 2 for s in scores) / 4))


def test_attention_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1000.0, [1.0, 0.0]), ("a", 1000.0, [0.0, 1.0]), ("b", -5.0, [2.0, 2.0])], "c string, score double, v array<double>")
    pooled = {r.c: (r.v, r.attention_entropy) for r in pooling.attention_pooling(pooling.attention_weights(df, ["c"]), ["c"], "v", 2).collect()}
    assert pooled["a"][0] == [0.5, 0.5] and pooled["b"][0] == [2.0, 2.0]
    assert pooled["a"][1] == pytest.approx(math.log(2), abs=1e-6)


def test_collation_fills_and_marks(spark):
    chunks = spark.createDataFrame([(1,), (2,)], "c int")
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 2, None)], "c int, frame int, x double")
    got = {r.c: r for r in collate.collate_table(rows, chunks, ["c"], ["x", "gone"], 3).collect()}
    assert got[1].table == [[5.0, 0.0], [0.0, 0.0], [0.0, 0.0]] and got[1].table_valid == [[1, 0], [0, 0], [0, 0]]
    assert (got[1].file_valid, got[2].file_valid) == (1, 0) and len(got[2].table) == 3


def test_collated_tracks_are_padded(spark):
    chunks = spark.createDataFrame([(1,), (2,)], "c int")
    rows = spark.createDataFrame([(1, 7, 0, 1.0, 3.0), (1, 7, 1, None, 4.0), (1, 8, 1, 2.0, 1.0)], "c int, object_id long, frame int, x double, relevance double")
    got = {r.c: r for r in collate.collate_tracks(rows, chunks, ["c"], ["x"], 2, 3, relevance="relevance").collect()}
    assert got[1].object_id == [8, 7, 0] and got[1].tracks_valid == [[0, 1], [1, 0], [0, 0]]
    assert got[1].tracks == [[[0.0], [2.0]], [[1.0], [0.0]], [[0.0], [0.0]]]
    assert got[2].object_id == [0, 0, 0] and got[2].file_valid == 0
    only = collate.collate_tracks(rows, chunks, ["c"], ["x"], 2, 1).collect()
    assert {r.c: r.object_id for r in only} == {1: [7], 2: [0]}


def test_arrays_of_the_wrong_size_raise(spark):
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="expected 2 values"):
        df.select(collate.collate_array("v", 2)[0]).collect()


def test_two_rows_in_one_frame_count_once(spark):
    """The smaller row by its values stands; a row without a frame stands nowhere."""
    rows = spark.createDataFrame([("c", 0, 2.0), ("c", 0, 1.0), ("c", 2, 5.0), ("c", None, 9.0)], "k string, frame int, v double")
    chunks = spark.createDataFrame([("c",), ("d",)], "k string")
    found = {r.k: r for r in collate.collate_table(rows, chunks, ["k"], ["v"], 3).collect()}
    assert (found["c"].table, found["c"].table_valid, found["c"].file_valid) == ([[1.0], [0.0], [5.0]], [[1], [0], [1]], 1)
    assert (found["d"].table, found["d"].file_valid) == ([[0.0]] * 3, 0)
    objects = rows.withColumn("object_id", F.lit(4).cast("long"))
    track = {r.k: r for r in collate.collate_tracks(objects, chunks, ["k"], ["v"], 3, 1).collect()}["c"]
    assert (track.object_id, track.tracks, track.tracks_valid) == ([4], [[[1.0], [0.0], [5.0]]], [[1, 0, 1]])


def test_every_segment_is_listed(spark):
    rows = spark.createDataFrame([("w", s, s + 5) for s in (30, 10, 20)] + [("x", 1, 2)], "w string, start long, end long")
    lists = {r.w: [tuple(p) for p in r.nonsilent_seg] for r in audio.segment_lists(rows, ["w"], 10.0).collect()}
    assert lists == {"w": [(1.0, 1.5), (2.0, 2.5), (3.0, 3.5)], "x": [(0.1, 0.2)]}
    assert {r.w: (r.segments, r.answered) for r in audio.windows_answered(rows, ["w"], 10.0).collect()} == {"w": (3, True), "x": (1, False)}


def test_arrays_take_their_declared_shape(spark):
    from driverscope.operators import collate

    rows = spark.createDataFrame([(1, [0, 10, 20, 30], [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 2 + [[7.0] * 6] * 2, [[9, 8]], [5]), (None, [10, 20], [[0.0] * 6] * 2, [[1, 2]], None)], "k int, times array<long>, v array<array<double>>, once array<array<int>>, fixed array<int>")
    chunks = spark.createDataFrame([(1, 10, 20), (2, 10, 20), (None, 0, 99)], "k int, a long, b long")
    shapes = {"v": collate.ArrayShape((3, 2), "float", -1.0), "once": collate.ArrayShape((2,), "int"), "fixed": collate.ArrayShape((1,), "long", 3, temporal=False)}
    found = {r.k: r for r in collate.collate_arrays(rows, chunks, ["k"], shapes, 2, "a", "b").collect()}
    assert found[1].v == [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [[7.0, 7.0]] * 3] and found[1].once == [[9, 8], [9, 8]] and found[1].fixed == [5]
    assert found[2].v == [[[-1.0, -1.0]] * 3] * 2 and found[2].once == [[0, 0]] * 2 and (found[2].v_valid, found[2].once_valid, found[2].fixed) == (0, 0, [3])
    assert (found[None].fixed, found[None].fixed_valid, found[None].v_valid) == ([3], 0, 1)
    with pytest.raises(Exception, match="expected 3 entries, found 2"):
        collate.collate_arrays(rows, chunks, ["k"], shapes, 3, "a", "b").collect()
    with pytest.raises(Exception, match="expected 5 values, found 6"):
        collate.collate_arrays(rows, chunks, ["k"], {"v": collate.ArrayShape((5,))}, 2, "a", "b").collect()
    cube = spark.range(1).select(collate.reshape(F.array(*[F.lit(i) for i in range(24)]), (2, 3, 4)).alias("c")).first().c
    assert cube == [[[12 * a + 4 * b + c for c in range(4)] for b in range(3)] for a in range(2)]


def test_frame_timing_counts_from_the_chunks_first_frame(spark):
    from driverscope.operators import collate

    rows = spark.createDataFrame([(1, 40, 4, 0.5), (1, 60, 6, None)], "k int, t long, resampled_frame int, x double")
    out = collate.collate_frame_timing(rows, spark.createDataFrame([(1,), (2,)], "k int"), ["k"], ["resampled_frame", "x"], 3).orderBy("k").collect()
    assert out[0].timing == [[4.0, 0.5, 0.0], [0.0, 0.0, 0.0], [6.0, 0.0, 2.0]] and out[0].timing_valid == [[1, 1, 1], [0, 0, 0], [1, 0, 1]]
    assert (out[1].file_valid, out[1].timing) == (0, [[0.0] * 3] * 3)
