"""Properties of the physical plans: what would hurt on a cluster must not appear."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"
# These write files before they return, or fit models.
EAGER = {"scan_scenario_index", "scan_feature", "scan_feature_mixed_headers", "scan_folds", "save_and_load_attributes", "save_and_load_arrays", "save_and_load_tracks", "save_and_load_predictions", "cached_features", "fold_results_complete"}
LAZY = sorted(n for n in queries() if n not in EAGER and not n.startswith("model_"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join_and_no_global_window(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text or name == "paired_p_values"
    # a window over a single partition may only see the table of bins, never rows
    lines = [line.lstrip(" :+-") for line in text.splitlines()]
    for i, line in enumerate(lines):
        if line.startswith("Window"):
            below = lines[i + 1 : i + 4]
            exchange = next((x for x in below if x.startswith("Exchange")), "")
            assert "SinglePartition" not in exchange or any("__bin" in x for x in below if x.startswith("Sort"))


def test_scans_read_only_what_they_need(spark):
    text = queries()["hazard_tally"](spark, FOLDER)._jdf.queryExecution().executedPlan().treeString()
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", text)
    text = queries()["clip_align_modalities"](spark, FOLDER)._jdf.queryExecution().executedPlan().treeString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)" in text


def test_fixed_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(queries()["chunk_top_objects"](spark, FOLDER))


def test_results_do_not_depend_on_partitioning(spark):
    def rows(name):
        return sorted(map(tuple, queries()[name](spark, FOLDER).collect()), key=repr)

    names = ["fixation_marks", "chunk_random", "sample_oversample", "ado_removal"]
    first = {n: rows(n) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {n: rows(n) for n in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_smoothing_of_a_hot_recording_is_spread(spark):
    """One recording of 60,000 rows ends up in many groups of bounded size."""
    from driverscope.operators.ordered import halo, row_index, time_bin

    rows = spark.range(60_000).select(F.lit(1).alias("r"), F.col("id").alias("t_ns"))
    numbered = row_index(rows, ["r"], time_bin("t_ns", 500), ["t_ns"], "row")
    sizes = halo(numbered, F.col("row"), 6000, 250, 250).groupBy("segment").count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) <= 6500


def test_model_rows_are_dealt_by_scenario_before_they_are_counted(spark, monkeypatch):
    """No map of scenarios and parts stands in front of the shuffle, and the tasks follow the number of line items."""
    from driverscope.plans import clip_queries

    monkeypatch.setattr(clip_queries, "TASK_LINES", 500, raising=False)
    tasks = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500 + 1
    lines = plan(clip_queries.model_rows(spark, FOLDER)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "l_partkey" in line)
    dealt = max(i for i in range(scan) if "Exchange" in lines[i])
    assert re.search(rf"hashpartitioning\(l_orderkey#\d+L?, {tasks}\)", lines[dealt])
    assert not any("Aggregate" in line for line in lines[dealt:scan])
