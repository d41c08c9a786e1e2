"""Binned helpers equal plain windows, whatever the bin width and partitioning."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driverscope.operators.ordered import around, halo, islands, magnitude_bin, median, neighbour, row_index, running, score_bin, step_islands, time_bin
from driverscope.operators.spread import join_few


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for key, size in (("hot", 400), ("cold", 30), ("single", 1)):
        times = rng.sample(range(5000), size)
        data += [(key, t, rng.choice([None, 1.0, 2.0, -3.0])) for t in times]
    return spark.createDataFrame(data, "k string, t long, x double").repartition(7).cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


@pytest.mark.parametrize("width", [1, 37, 10_000])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(rows, width, descending, inclusive):
    order = F.col("t").desc() if descending else F.col("t")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = rows.select("*", F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("s"), F.last("x", ignorenulls=True).over(w).alias("l"))
    got = running(rows, ["k"], time_bin("t", width), ["t"], {"s": F.col("x")}, {"l": F.col("x")}, inclusive, descending)
    same(got, plain)


def test_neighbour_keeps_missing_values(rows):
    w = Window.partitionBy("k").orderBy("t")
    same(neighbour(rows, ["k"], time_bin("t", 50), ["t"], {"p": F.col("x")}), rows.select("*", F.lag("x").over(w).alias("p")))
    same(neighbour(rows, ["k"], time_bin("t", 50), ["t"], {"n": F.col("x")}, following=True), rows.select("*", F.lead("x").over(w).alias("n")))


def test_row_index_and_islands(rows):
    w = Window.partitionBy("k").orderBy("t")
    same(row_index(rows, ["k"], time_bin("t", 64), ["t"], "r"), rows.select("*", (F.row_number().over(w) - 1).cast("long").alias("r")))
    starts = F.coalesce(F.col("x") > 0, F.lit(False))
    plain = rows.select("*", F.sum(F.when(starts, 1).otherwise(0)).over(w).alias("i"))
    same(islands(rows, ["k"], time_bin("t", 64), ["t"], starts, "i"), plain)


def test_halo_gives_every_row_its_surroundings(rows):
    placed = halo(rows, F.col("t"), 100, look_back=30, look_ahead=20)
    w = Window.partitionBy("k", "segment").orderBy("t").rangeBetween(-30, 20)
    plain = Window.partitionBy("k").orderBy("t").rangeBetween(-30, 20)
    got = placed.withColumn("n", F.count("*").over(w)).where("is_own").select("k", "t", "x", "n")
    same(got, rows.select("*", F.count("*").over(plain).alias("n")))


def test_median(rows):
    got = {r.k: r["median"] for r in median(rows, ["k"], "t", magnitude_bin("t")).collect()}
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.expr("percentile(t, 0.5)").alias("m")).collect()}
    assert got == want


def test_bins_never_decrease(spark):
    values = spark.createDataFrame([(v / 7,) for v in range(-50, 50)], "v double").orderBy("v")
    for bin in (score_bin("v"), score_bin("v", low=-8.0, high=8.0), magnitude_bin("v")):
        found = [r[0] for r in values.select(bin).collect()]
        assert found == sorted(found)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_few_equals_join(spark, rows, how):
    few = spark.createDataFrame([("hot", 1), ("none", 2)], "k string, v int")
    same(join_few(rows, few, ["k"], how, time_bin("t", 500)), rows.join(few, "k", how))
    same(join_few(rows, few, ["k"], how), rows.join(few, "k", how))


def test_join_few_spreads_a_hot_key(spark):
    big = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    few = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_few(big, few, ["k"], bin=time_bin("t", 1000))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 100_000 and max(sizes) < 40_000


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_around(rows, width):
    w = Window.partitionBy("k").orderBy("t")
    plain = rows.select("*", F.lag("x").over(w).alias("p"), F.lead("x").over(w).alias("n"))
    got = around(rows, ["k"], time_bin("t", width), ["t"], ["x"], "a", "b")
    same(got.select("k", "t", "x", F.col("a.x").alias("p"), F.col("b.x").alias("n")), plain)


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_step_islands(rows, width):
    w = Window.partitionBy("k").orderBy("t")
    seen = rows.where("x IS NOT NULL")
    before = F.lag("x").over(w)
    marked = seen.withColumn("s", F.when(before.isNull() | (F.abs(F.col("x") - before) > 2), 1).otherwise(0)).withColumn("p", before)
    plain = marked.select("k", "t", "x", F.sum("s").over(w).alias("i"), "p")
    got = step_islands(seen, ["k"], time_bin("t", width), ["t"], ["x"], lambda a, b: F.abs(a["x"] - b["x"]) > 2, "i", "q")
    same(got.select("k", "t", "x", "i", F.col("q.x").alias("p")), plain)


def test_totals_come_with_running_sums(rows):
    got = running(rows, ["k"], time_bin("t", 50), ["t"], sums={"s": F.lit(1)}, totals={"n": F.lit(1)})
    assert {(r.k, r.n) for r in got.collect()} == {("hot", 400), ("cold", 30), ("single", 1)}


@pytest.mark.parametrize("descending", [False, True])
def test_missing_keys_and_bins_stay(spark, descending):
    data = [(k, t, float(i)) for i, (k, t) in enumerate((k, t) for k in (None, "a") for t in (None, 1, 60, 130))]
    rows = spark.createDataFrame(data, "k string, t long, x double").repartition(3)
    order = F.col("t").desc() if descending else F.col("t")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    got = running(rows, ["k"], time_bin("t", 50), ["t"], {"s": F.col("x")}, {"l": F.col("x")}, descending=descending)
    same(got, rows.select("*", F.sum("x").over(w).alias("s"), F.last("x", ignorenulls=True).over(w).alias("l")))
    assert around(rows, ["k"], time_bin("t", 50), ["t"], ["x"]).count() == len(data)
    assert step_islands(rows, ["k"], time_bin("t", 50), ["t"], ["x"], lambda a, b: a["x"] > b["x"] + 1).count() == len(data)
    assert rows.select(score_bin(F.lit(None).cast("double")).alias("b")).where("b IS NOT NULL").count() == 0
