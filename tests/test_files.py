"""Readers and writers on a small tree laid out like the study's."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driverscope.operators.index import glob_to_regex, join_annotations, with_conditions
from driverscope.schema import TIME, Aggregate, FeatureSpec
from driverscope.session import shared_folder
from driverscope.sources import logs, recordings, sinks

HEADER = "scenario_index,scenario_name,scenario_path,round,cognitive_task,start_time,end_time,duration_s,duration_frames"


def write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "R10" / "Participants"
    write(root / "P703" / "scenario_index.csv", f"{HEADER}\n0,driving/6e-x,R2/driving/6e-x/no_task,R2,no_task,0,5000000000,5.0,50\n1,tobii_calibration,R1/t,R1,no_task,0,1000,NaN,1\n")
    write(root / "7204" / "scenario_index.csv", f"{HEADER}\n0,driving/2-y,R2/driving/2-y/nback_task,R2,nback_task,0,7000000000,7.0,70\n")
    return tmp_path


def test_index_takes_the_participant_from_the_path(spark, tree):
    rows = with_conditions(recordings.scan_scenario_index(spark, str(tree), "R10")).collect()
    found = {(r.participant_name, r.scenario_name): (r.experiment_version, r.intoxicated, r.duration_s) for r in rows}
    assert found == {
        ("P703", "driving/6e-x"): (1, True, 5.0),
        ("P703", "tobii_calibration"): (1, False, None),
        ("7204", "driving/2-y"): (2, False, 7.0),
    }
    index = recordings.scan_scenario_index(spark, str(tree), "R10")
    assert [r.participant_name for r in recordings.list_participants(index, "v1").collect()] == ["P703"]


def test_feature_prefers_derived_files_and_cleans_names(spark, tree):
    root = tree / "R10" / "Participants"
    place = "R2/driving/6e-x/no_task"
    write(root / "P703" / place / "gaze.csv", f"{TIME},gaze x,other\n0,1.5,1\n100,NaN,2\n")
    write(root / "P703" / place / "sim_bag" / "gaze.csv", f"{TIME},gaze x,other\n0,9.0,1\n")
    write(root / "7204" / "R2/driving/2-y/nback_task" / "sim_bag" / "gaze.csv", f"{TIME},gaze x,other\n0,7.0,1\n")
    write(root / "broken" / "gaze.csv", f"{TIME},gaze x,other\n0,8.0,1\n")
    spec = FeatureSpec("gaze", "R10", 10, aggregates=(Aggregate(("gaze_x",), "mean"), Aggregate(("absent",), "mean")))
    rows = recordings.scan_feature(spark, str(tree), spec)
    assert "other" not in rows.columns and "absent" not in rows.columns
    found = sorted(((r.participant_name, r.task, r[TIME], r.gaze_x) for r in rows.collect()), key=repr)
    assert found == [("7204", "nback_task", 0, 7.0), ("P703", "no_task", 0, 1.5), ("P703", "no_task", 100, None)]


def test_columns_are_found_by_each_files_own_header(spark, tree):
    root, place = tree / "R10" / "Participants", "R1/driving/2-y/no_task"
    write(root / "P1" / place / "pose.csv", f"{TIME},x\n0,1\n")
    write(root / "P2" / place / "pose.csv", f"y,{TIME},x\n2,0,1\n\n,10,NaN\n")
    write(root / "P3" / place / "pose.csv", f"\n{TIME},other,x,\"y\"\n0,9,1,2\n")
    write(root / "P4" / place / "pose.csv", f"{TIME},x,y\n")
    spec = FeatureSpec("pose", "R10", 10, columns=("x", "y", "z"))
    rows = recordings.scan_feature(spark, str(tree), spec)
    assert "z" not in rows.columns and "other" not in rows.columns
    found = sorted(((r.participant_name, r[TIME], r.x, r.y) for r in rows.collect()), key=repr)
    assert found == [("P1", 0, 1.0, None), ("P2", 0, 1.0, 2.0), ("P2", 10, None, None), ("P3", 0, 1.0, 2.0)]
    every = recordings.scan_feature(spark, str(tree), FeatureSpec("pose", "R10", 10))
    assert {"x", "y", "other", TIME} <= set(every.columns)


def test_annotations(spark, tmp_path):
    blocks = ["12-15, 40-44", "", "7-", "", "", "", "", ""], ["crash", "fail", "", "", "", "", "", ""], ["12,40", "3", "", "", "", "", "", ""]
    cells = ",".join(f'"{c}"' if "," in c else c for block in blocks for c in block)
    empty = "," * 23
    write(tmp_path / "notes.csv", f"Participant,{empty}\nP,{empty}\nP703,{cells}\n7204,{empty}\nX1,{cells}\n")
    sheet = recordings.scan_annotations(spark, str(tmp_path / "notes.csv"))
    rows = {(r.participant_name, r.scenario_short): r for r in sheet.collect()}
    assert len(rows) == 16
    first = rows[("P703", "1a")]
    assert [(a.start_ns, a.end_ns) for a in first.anomalies] == [(12 * 10**9, 15 * 10**9), (40 * 10**9, 44 * 10**9)]
    assert (first.number_hazard_crashes, first.number_all_crashes) == (1, 2)
    assert (rows[("P703", "2")].number_hazard_crashes, rows[("P703", "2b")].anomalies) == (-1, [])
    index = spark.createDataFrame(
        [("P703", "driving/2-y"), ("P703", "driving/9-z"), ("P703", "tobii_calibration"), ("P703", "driving/1a-x")], "participant_name string, scenario_name string"
    )
    joined = {r.scenario_name: (r.number_hazard_crashes, r.number_all_crashes, len(r.anomalies)) for r in join_annotations(index, sheet).collect()}
    assert joined == {"driving/2-y": (None, 1, 0), "driving/9-z": (None, None, 0), "tobii_calibration": (0, 0, 0), "driving/1a-x": (1, 2, 2)}


def test_ragged_folds(spark, tmp_path):
    write(tmp_path / "folds.csv", "P1,P2, P3\nP4\n\nP5,\n")
    rows = recordings.scan_folds(spark, str(tmp_path / "folds.csv")).collect()
    assert sorted((r.participant_name, r.fold) for r in rows) == [("P1", 0), ("P2", 0), ("P3", 0), ("P4", 1), ("P5", 3)]


def test_find_one_file(spark):
    paths = [f"/d/P1/R{r}/driving/3c-pop/{t}/cam/a.csv" for r in (1, 2) for t in ("no_task", "nback_task")] + ["/d/P1/R1/stationary_tasks/fixed_gaze/cam/a.csv"]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    assert recordings.find_one(listing, "P1", "3c", "cam/a.csv").count() == 0
    assert recordings.find_one(listing, "P1", "3c", "cam/*.csv", round=2, task="no_task").first().path == paths[2]
    assert recordings.find_one(listing, "P1", "fixed_gaze", "cam/a.csv", round=1).count() == 1
    with pytest.raises(ValueError):
        recordings.find_one(listing, "P1", "fixed_gaze", "cam/a.csv")


def test_frame_timing_and_video_directories(spark, tmp_path):
    root = tmp_path / "R10" / "Participants" / "P1" / "R1" / "driving" / "2-y" / "no_task"
    write(root / "cam_front" / "frame_timing.csv", f"{TIME},resampled_frame\n0,0\n100,1\n")
    write(root / "cam_face" / "frame_timing.csv", f"{TIME},resampled_frame\n0,5\n")
    rows = recordings.scan_frame_timing(spark, str(tmp_path), "R10", "cam_front").collect()
    assert sorted((r[TIME], r.resampled_frame) for r in rows) == [(0, 0.0), (100, 1.0)]
    listing = spark.createDataFrame([("/a/x.mp4",), ("/b/x.mp4",), ("/b/y.avi",), ("/c/t.csv",)], "path string")
    assert sorted((r.directory, r.videos) for r in recordings.video_directories(listing).collect()) == [("/b", 2), ("/c", 0)]
    with pytest.raises(ValueError):
        recordings.log_time_column(["a log time", "b log time"])
    assert recordings.log_time_column(["t", "cam log time"]) == "cam log time"


def test_schedules(spark, tmp_path):
    write(tmp_path / "nback" / "nback_every2.5_pttn4.csv", "startime,digit\n10.0,7\n")
    rows = recordings.scan_schedules(spark, str(tmp_path), "nback_task").collect()
    assert [(r.pattern, r.startime, r.digit) for r in rows] == [(4, 10.0, 7.0)]
    assert recordings.schedule_file("3c-pedestrian_pop_out", "nback_task").endswith("pttn4.csv")
    df = spark.createDataFrame([("3c-pedestrian_pop_out",), ("practice",)], "s string")
    assert [r[0] for r in df.select(recordings.schedule_pattern(F.col("s"))).collect()] == [4, None]


def test_writers_check_their_contract(spark, tmp_path):
    grid = spark.createDataFrame([("a", 3)], "r string, frames int")
    rows = spark.createDataFrame([("a", t * 10, 1.0) for t in (2, 0, 1)], f"r string, {TIME} long, v double")
    sinks.save_tabular(rows, grid, str(tmp_path / "ok"), ["r"])
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 3
    with pytest.raises(sinks.ContractError):
        sinks.save_tabular(rows.where("v > 1"), grid, str(tmp_path / "x"), ["r"])
    with pytest.raises(sinks.ContractError):
        sinks.save_tabular(rows.withColumn(TIME, F.col(TIME).cast("int")), grid, str(tmp_path / "y"), ["r"])
    doubled = rows.where("v < 0").unionByName(rows.withColumn(TIME, F.greatest(F.col(TIME), F.lit(10).cast("long"))))
    assert doubled.count() == 3
    with pytest.raises(sinks.ContractError, match="twice"):
        sinks.save_tabular(doubled, grid, str(tmp_path / "w"), ["r"])
    with pytest.raises(sinks.ContractError):
        sinks.save_object_attributes(rows, str(tmp_path / "z"), ["r"])
    assert not (tmp_path / "x").exists()
    sinks.save_frame_timing(rows, grid, str(tmp_path / "t"), ["r"], 100)
    assert sorted((r[TIME], r.resampled_frame) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(0, 0), (10, 1), (20, 2)]
    sinks.save_object_tracks({4: rows, 2: rows}, str(tmp_path / "o"), ["r"])
    assert sorted((r[TIME], r.object_id) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(t, o) for t in (0, 10, 20) for o in (2, 4)]


def test_array_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0, 10, 20], [1.0, 2.0, 3.0], [9.0])], "r int, times array<long>, v array<double>, once array<double>")
    sinks.save_array_dict(rows, ["v", "once"], str(tmp_path / "a"))
    back = recordings.scan_array_dict(spark, str(tmp_path / "a"))
    cut = recordings.slice_arrays(back, ["v", "once"], F.lit(10), F.lit(20)).first()
    assert (cut.times, cut.v, cut.once) == ([10, 20], [2.0, 3.0], [9.0])
    with pytest.raises(sinks.ContractError):
        sinks.save_array_dict(rows.withColumn("v", F.array(F.lit(1.0), F.lit(2.0))), ["v"], str(tmp_path / "b"))


def test_features_are_computed_once_unless_asked(spark, tmp_path):
    calls = []

    def compute(n):
        calls.append(n)
        return spark.range(n)

    path = str(tmp_path / "c")
    assert recordings.cache_features(spark, path, lambda: compute(3)).count() == 3
    assert recordings.cache_features(spark, path, lambda: compute(4)).count() == 3
    assert recordings.cache_features(spark, path, lambda: compute(5), recache=True).count() == 5
    assert calls == [3, 5]


def test_fold_results_and_logs(spark, tmp_path):
    for fold in (0, 2):
        write(tmp_path / f"fold_{fold}" / "test_results.json", json.dumps({"fold": fold, "best_epoch": 3, "uar": 0.5 + fold / 10, "auc": float("nan"), "f1": 0.1}, indent=2))
    rows = {r.fold: (r.uar, r.auc) for r in logs.load_fold_results(spark, str(tmp_path / "fold_*" / "*.json")).collect()}
    assert rows == {0: (0.5, None), 2: (0.7, None)}
    write(tmp_path / "train.log", "start\n  FOLD UAR=0.61 sens=0.5  spec=0.72 AUC=0.70 F1=0.4 thr\nUAR=nan sens=0.5\n")
    found = logs.scan_log_metrics(spark, str(tmp_path / "train.log")).collect()
    assert [tuple(r) for r in found] == [(0.61, 0.5, 0.72, 0.70, 0.4)]
    assert recordings.load_predictions(spark, str(tmp_path / "nothing")).count() == 0


def test_manifest_prefix_and_globs(spark):
    listing = spark.createDataFrame([("data/v1/a.csv", 1), ("data/v1/b.mp4", 2), ("v1/c.csv", 4), ("data/v2/d.csv", 8)], "key string, size long")
    chosen = logs.manifest_select(listing, ["v1/*"], ["*.mp4"], prefix="data")
    assert logs.manifest_size(chosen).first().bytes == 5
    assert logs.manifest_select(listing, ["v1/*"]).count() == 1
    assert logs.manifest_size(listing.where("false")).first().bytes == 0


def test_globs_match_whole_names():
    import fnmatch
    import re

    for glob in ("*a?c", "x[!ab]z", "a.b*", "[[]q", "[a-c]*", "p+q", "[x"):
        for name in ("abc", "xcz", "xaz", "a.bcd", "aXb", "[q", "bb", "p+q", "ppq", "[x"):
            assert bool(re.search(glob_to_regex(glob), name)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
