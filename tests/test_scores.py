"""Folds, sampling, metrics and the paired test, by hand and by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driverscope.operators import folds, metrics, stats
from driverscope.operators.ordered import magnitude_bin
from driverscope.plans import reports


def people(spark, n=53):
    return spark.range(n * 4).select((F.col("id") % n).cast("string").alias("participant_name"), "id")


def test_folds_are_disjoint_even_and_repeatable(spark):
    df = people(spark)
    config = folds.FoldConfig(splits=5)
    first = {r.participant_name: r.fold for r in folds.group_folds(df, config).collect()}
    again = {r.participant_name: r.fold for r in folds.group_folds(df.repartition(11), config).collect()}
    sizes = [list(first.values()).count(f) for f in range(5)]
    assert first == again and len(first) == 53 and max(sizes) - min(sizes) <= 1
    assert first != {r.participant_name: r.fold for r in folds.group_folds(df, config, seed=7).collect()}


def test_roles_share_no_participant(spark):
    df, configs = people(spark), [folds.FoldConfig(splits=5)]
    parts = {r: {p[0] for p in folds.filter_folds(df, configs, 4, r).select("participant_name").distinct().collect()} for r in ("train", "val", "test")}
    assert parts["train"] | parts["val"] | parts["test"] == {str(i) for i in range(53)}
    assert not (parts["train"] & parts["val"] or parts["val"] & parts["test"] or parts["train"] & parts["test"])
    assert folds.filter_folds(df, configs, 4, "all").count() == df.count()


def test_split_numbers_are_mixed_radix():
    assert [folds.mixed_radix(i, [2, 3]) for i in range(6)] == [[0, 0], [1, 0], [0, 1], [1, 1], [0, 2], [1, 2]]


def test_participant_without_fold_takes_no_part(spark):
    given = spark.createDataFrame([(str(i), i % 5) for i in range(50)], "participant_name string, fold int")
    rows = folds.fixed_folds(people(spark), given)
    assert rows.count() == 212 and rows.where("fold IS NULL").count() == 12
    roles = {r.role: r["count"] for r in folds.with_role(rows, 4).groupBy("role").count().collect()}
    assert roles == {"test": 40, "val": 40, "train": 120}


def test_sample_sizes_are_exact(spark):
    df = spark.range(1001)
    assert folds.take_fraction(df, 0.25, ["id"]).count() == 250
    assert folds.take_fraction(spark.range(10), 0.25, ["id"]).count() == 2  # 2.5, half to even
    labelled = df.withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    counts = {r.label: r["count"] for r in folds.undersample(labelled, "label", ["id"]).groupBy("label").count().collect()}
    assert counts == {0: 101, 1: 101}
    drawn = folds.oversample(df, 1.5, ["id"])
    assert drawn.count() == 1502 and drawn.select("draw").distinct().count() == 1502
    assert drawn.join(df, "id", "left_anti").count() == 0
    assert [r.id for r in folds.permute(df, ["id"]).collect()] == [r.id for r in folds.permute(df.repartition(9), ["id"]).collect()]


def test_stratified_folds_spread_labels(spark):
    df = spark.range(100).select(F.col("id").alias("p"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    counts = folds.stratified_folds(df, "p", "label", 5).groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in counts} == {(0, 15), (1, 5)}


def test_clip_starts_stay_inside(spark):
    spec = folds.ClipSpec(length=10, buffer=3, stride=4, validation=5)
    frames = spark.range(100).select(F.lit("a").alias("participant_name"), (F.col("id") % 3).alias("key"))
    found = folds.scan_sequences(frames.where("key < 2"), ["participant_name", "key"], spec)
    train = folds.train_clips(found, ["participant_name", "key"], spec).collect()
    assert len(train) == sum(r.n_train_chunks for r in found.collect()) and all(3 <= r.start <= r.n_frames - 13 for r in train)
    val = folds.validation_clips(found, spec).collect()
    assert all(r.start == r.n_frames - 13 - r.clip * 4 and r.start >= 3 for r in val)
    assert found.where("n_frames < 16").count() == 0


def predictions(spark, rows):
    return spark.createDataFrame([("t", *r) for r in rows], "task string, gt int, prob double")


def test_auc_counts_ties_half_and_needs_two_classes(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, -1]), rng.choice([0.1, 0.2, 0.25, 0.7, 1.0])) for _ in range(300)]
    pos, neg = [p for g, p in rows if g == 1], [p for g, p in rows if g == 0]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(predictions(spark, rows), ["task"]).first().auc == pytest.approx(want)
    assert metrics.roc_auc(predictions(spark, [(1, 0.3), (1, 0.4)]), ["task"]).first().auc is None


def test_threshold_is_the_highest_best_one(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.4), (0, 0.4), (0, 0.1)]
    best = metrics.best_threshold(predictions(spark, rows), ["task"]).first()
    # 0.9 and 0.8 and 0.4 all give 2/3; the highest is taken
    assert (best.threshold, best.uar) == (0.9, pytest.approx(2 / 3))
    assert math.isinf(metrics.best_threshold(predictions(spark, [(0, 0.9), (1, 0.1)]), ["task"]).first().threshold)
    assert metrics.best_threshold(predictions(spark, [(1, 0.9)]), ["task"]).first().threshold is None
    none = spark.createDataFrame([("t", None)], "task string, threshold double")
    at = metrics.confusion_at(predictions(spark, [(1, 0.5), (0, 0.49)]), none, ["task"]).first()
    assert (at.tp, at.tn) == (1, 1)


def test_rates_are_missing_without_a_class(spark):
    row = metrics.confusion(predictions(spark, [(1, 0.9), (1, 0.1), (-1, 0.9)]), ["task"]).first()
    assert (row.tp, row.fn, row.sensitivity, row.specificity, row.uar) == (1, 1, 0.5, None, None)


def test_ranking_loss_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(f, rng.choice([0, 1]), round(rng.uniform(-2, 2), 2)) for f in (0, 1) for _ in range(80)] + [(2, 1, 0.5)]
    df = spark.createDataFrame(rows, "fold int, label int, score double")
    got = {r.fold: r.rank_loss for r in metrics.ranking_loss(df, ["fold"], margin=0.7).collect()}
    for f in (0, 1):
        pos, neg = [s for g, y, s in rows if g == f and y == 1], [s for g, y, s in rows if g == f and y == 0]
        want = sum(max(0.0, 0.7 - (a - b)) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[f] == pytest.approx(want)
    assert got[2] == 0.0


def test_best_epoch_is_the_first_maximum(spark):
    df = spark.createDataFrame([(1, 0.4, 1.0), (2, 0.6, 2.0), (3, 0.6, 3.0), (4, None, 4.0)], "epoch int, uar double, test double").withColumn("fold", F.lit(0))
    row = metrics.best_epoch(df, ["fold"], "uar", ["test"]).first()
    assert (row.epoch, row.test) == (2, 2.0)


def test_three_classes_fill_absent_rows_with_zero(spark):
    df = spark.createDataFrame([(1, 0.9, 0.1, 0.9, 0.2), (1, 0.1, 0.9, 0.1, 0.9)], "gt3 int, cd double, intox double, impaired double, impaired_intox double").withColumn("f", F.lit(0))
    cells = {(r.actual, r.predicted): r.share for r in metrics.three_class_confusion(df, ["f"], "impaired_first").collect()}
    assert cells[(1, 1)] == 0.5 and cells[(1, 0)] == 0.5 and cells[(0, 0)] == cells[(2, 2)] == 0.0 and len(cells) == 9


def test_signed_rank_matches_textbook_values(spark):
    # sizes 1 to 10 with the two smallest negative, one zero difference
    deltas = [-1.0, -2.0] + [float(i) for i in range(3, 11)] + [0.0]
    df = spark.createDataFrame([("f", 0.0, d) for d in deltas], "feature string, baseline double, impaired double")
    row = stats.signed_rank(df, ["feature"]).select("*", stats.two_sided_normal("z").alias("p")).first()
    z = (52 - 10 * 11 / 4) / math.sqrt(10 * 11 * 21 / 24)
    assert row.n == 11 and row.z == pytest.approx(z) and row.effect == pytest.approx(z / math.sqrt(11))
    assert row.p == pytest.approx(0.0125, abs=5e-5)
    quantiles = spark.createDataFrame([(1.959963985, 0.05), (-2.575829304, 0.01), (0.0, 1.0)], "z double, p double")
    assert all(r.p == pytest.approx(r.q, abs=1e-9) for r in quantiles.select("p", stats.two_sided_normal("z").alias("q")).collect())


def test_signed_rank_ties_and_all_zero(spark):
    df = spark.createDataFrame([("t", 0.0, 1.0)] * 3 + [("t", 0.0, -1.0)] + [("z", 1.0, 1.0)] * 4, "feature string, baseline double, impaired double")
    rows = {r.feature: r for r in stats.signed_rank(df, ["feature"], bin=magnitude_bin("__size")).collect()}
    variance = 4 * 5 * 9 / 24 - (4**3 - 4) / 48
    assert rows["t"].z == pytest.approx((7.5 - 5) / math.sqrt(variance))
    assert rows["z"].z is None and rows["z"].mean_diff == 0.0


def test_signed_rank_of_a_missing_mean_is_missing(spark):
    data = [("f", 0.0, 1.0), ("f", 0.0, None), ("g", 0.0, 1.0), ("g", 0.0, 2.0)]
    rows = {r.feature: r for r in stats.signed_rank(spark.createDataFrame(data, "feature string, baseline double, impaired double"), ["feature"]).collect()}
    assert (rows["f"].n, rows["f"].mean_diff, rows["f"].z, rows["f"].effect) == (2, None, None, None)
    assert rows["g"].n == 2 and rows["g"].mean_diff == 1.5


def test_comparison_is_skipped_when_sides_differ(spark):
    rows = spark.createDataFrame(
        [("cd", "a", True, 1.0), ("cd", "a", False, 2.0), ("cd", "b", True, 1.0)], "condition string, participant_name string, is_condition boolean, x double"
    )
    assert stats.paired_means(rows, ["x"]).count() == 0
    assert stats.paired_means(rows, ["x"], drop_unpaired=True).count() == 1


def test_conditions(spark):
    df = spark.createDataFrame([(1, False, False), (1, True, True), (1, True, False), (2, False, True)], "experiment_version int, intoxicated boolean, cd boolean")
    found = sorted((r.condition, r.is_condition) for r in stats.condition_rows(df).collect())
    assert found == [("cd", False), ("cd", True), ("intoxicated", False), ("intoxicated", True), ("joint", False), ("joint", True)]


def test_summary_waits_for_all_folds(spark):
    results = spark.createDataFrame([(f, 0.5 + f / 10) for f in range(4)], "fold int, uar double")
    assert reports.summary_when_complete(results, ["uar"]).count() == 0
    assert [r.fold for r in reports.missing_folds(results).collect()] == [4]
    full = results.union(spark.createDataFrame([(4, None)], "fold int, uar double"))
    assert reports.summary_when_complete(full, ["uar"]).first().uar_mean == pytest.approx(0.65)


def test_missing_metric_never_wins(spark):
    from driverscope.operators.metrics import best_epoch

    epochs = spark.createDataFrame([("a", 1, -3.0), ("a", 2, None), ("a", 3, -2.0)], "k string, epoch int, m double")
    assert best_epoch(epochs, ["k"], "m", []).first().epoch == 3


def test_rows_without_score_do_not_rank(spark):
    from driverscope.operators.metrics import roc_auc

    rows = spark.createDataFrame([("a", 1, 0.2), ("a", 0, None), ("a", 0, 0.1)], "k string, gt int, prob double")
    found = roc_auc(rows, ["k"]).first()
    assert (found.auc, found.negatives) == (1.0, 1)


def test_anti_join_keeps_null_keys(spark):
    from driverscope.operators.spread import join_few

    big = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    few = spark.createDataFrame([("a",)], "k string")
    assert {r.v for r in join_few(big, few, ["k"], "left_anti").collect()} == {1, 3}
    assert {r.v for r in join_few(big, few, ["k"], "left_semi").collect()} == {2}


RANGES = {"small": (0.0, 0.015), "middle": (2.0, 3.0), "unit": (0.0, 1.0), "wide": (-1e12, 1e12), "narrow": (1e6, 1e6 + 1e-3)}


def test_slices_follow_the_data(spark):
    """100,000 distinct values of any range fall into many slices, which never decrease."""
    from driverscope.operators.ordered import data_bins

    rows = spark.range(100_000).select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), (a + (b - a) * F.col("id") / 100_000).alias("v")) for k, (a, b) in RANGES.items()])))
    rows = rows.withColumn("k", F.when(F.col("k") != "unit", F.col("k"))).union(spark.sql("SELECT 'ties', 0.5D FROM range(1000)"))
    found = data_bins(rows, ["k"], "v").groupBy("k", "__slice").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
    for key in [None, *(k for k in RANGES if k != "unit")]:
        own = sorted((r for r in found if r.k == key), key=lambda r: r["__slice"])
        assert len(own) >= 50 and max(r.n for r in own) < 5_000 and sum(r.n for r in own) == 100_000
        assert all(x.b < y.a for x, y in zip(own, own[1:]))
    assert [r.n for r in found if r.k == "ties"] == [1000]


def test_slices_of_missing_values_and_no_rows(spark):
    from driverscope.operators.ordered import data_bins

    rows = spark.createDataFrame([("a", None), ("a", 1.0), ("a", float("nan")), ("a", 2.0), (None, 3.0)], "k string, v double")
    found = {(r.k, repr(r.v)): r["__slice"] for r in data_bins(rows, ["k"], "v").collect()}
    assert found[("a", "None")] is None and found[("a", "1.0")] <= found[("a", "2.0")] <= found[("a", "nan")] and found[(None, "3.0")] is not None
    assert data_bins(rows.limit(0), ["k"], "v").count() == 0 and data_bins(rows, [], "v").count() == 5


@pytest.mark.parametrize("low, high", [(0.0, 0.015), (2.0, 3.0), (-5e9, 5e9)])
def test_scores_of_any_range_rank_exactly(spark, low, high):
    rng = random.Random(8)
    data = [(None if i % 2 else "a", int(rng.random() < 0.4), low + (high - low) * rng.randrange(400) / 400) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, gt int, prob double").repartition(5)
    aucs = {r.k: r.auc for r in metrics.roc_auc(df, ["k"]).collect()}
    for key in ("a", None):
        pos = [p for k, g, p in data if k == key and g == 1]
        neg = [p for k, g, p in data if k == key and g == 0]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert aucs[key] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    ranked = stats.signed_rank(df.select("k", F.lit(0.0).alias("baseline"), (F.col("prob") - (low + high) / 2).alias("impaired")), ["k"]).collect()
    assert {r.k for r in ranked} == {"a", None} and all(r.z is not None for r in ranked)


def test_network_learns_as_spark_does_with_rows_dealt_to_all_cores(spark):
    """The fit is that of Spark's own estimator, but no task holds all rows, however few files they come in."""
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.sql import functions as F

    from driverscope.operators import models, networks

    # 8 blocks of 128 rows, which Spark's own estimator weighs alike
    rows = spark.range(0, 1024, 1, 1).select("id", *[F.sin(F.col("id") * (k + 1.3)).alias(c) for k, c in enumerate("ab")])
    rows = rows.withColumn("gt", (F.col("a") * F.col("b") > 0.1).cast("int"))
    fitted = models.fit_task(rows, ["a", "b"], "gt", "ShallowNet", ["id"], maxIter=8)
    prepared = rows.select(F.col("gt").cast("double").alias("label"), F.col("a").alias("f_a"), F.col("b").alias("f_b"))
    stages = [VectorAssembler(inputCols=["f_a", "f_b"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    own = Pipeline(stages=[*stages, MultilayerPerceptronClassifier(layers=[2, *models.HIDDEN_LAYERS, 2], seed=42, maxIter=8)]).fit(prepared)
    assert np.allclose(fitted.stages[-1].weights.toArray(), own.stages[-1].weights.toArray(), atol=1e-6)

    seen = []
    real = networks.distributed
    try:
        networks.distributed = lambda rows, *rest: seen.append(rows.rdd.getNumPartitions()) or real(rows, *rest)
        models.fit_task(rows, ["a", "b"], "gt", "ShallowNet", ["id"], maxIter=1)
    finally:
        networks.distributed = real
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_network_slopes_are_exact_and_blocks_ask_for_no_memory():
    """Sums over blocks of any size are those of one plain pass, and the layers' arrays are made once for all blocks."""
    import tracemalloc

    import numpy as np

    from driverscope.operators import models, networks

    rng, layers = np.random.default_rng(3), [5, *models.HIDDEN_LAYERS, 2]
    weights = rng.normal(size=sum((i + 1) * o for i, o in zip(layers, layers[1:]))) * 0.3
    x, label = rng.normal(size=(2 * networks.BLOCK + 7, 5)) * 2, rng.integers(0, 2, 2 * networks.BLOCK + 7)

    def plain(weights):
        steps, seen = networks.unpack(weights, layers), [x]
        for w, b in steps[:-1]:
            seen.append(1 / (1 + np.exp(-(seen[-1] @ w + b))))
        odds = np.exp(seen[-1] @ steps[-1][0] + steps[-1][1])
        share = odds / odds.sum(axis=1, keepdims=True)
        delta, parts = share - np.eye(2)[label], []
        for k in (3, 2, 1, 0):
            parts += [delta.sum(axis=0), (seen[k].T @ delta).ravel()]
            delta = delta @ steps[k][0].T * seen[k] * (1 - seen[k])
        return -np.log(share[np.arange(len(x)), label]).sum(), np.concatenate(parts[::-1])

    slopes = networks.Slopes(weights, layers)
    slopes.add(x[:3], label[:3])
    tracemalloc.start()
    slopes.add(x[3:], label[3:])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    loss, want = plain(weights)
    assert slopes.rows == len(x) and slopes.loss == pytest.approx(loss, rel=1e-12)
    assert np.allclose(slopes.total, want, rtol=1e-9, atol=1e-9)
    # an array of one block and the second layer would be more
    assert most < 8 * networks.BLOCK * layers[2]
    far = networks.Slopes(weights * 1e4, layers)
    far.add(x, label)
    assert np.isfinite(far.loss) and np.isfinite(far.total).all()
