"""The study tree as a data source: pruned listing, own headers, byte ranges, videos; staged writers."""

import pytest
from pyspark.sql import functions as F

from driverscope.schema import TIME, FeatureSpec
from driverscope.sources import recordings, sinks, tree

PLACE = "driving/1a/no_task"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture()
def study(tmp_path):
    root = tmp_path / "R10" / "Participants"
    for p in ("P1", "P2", "P3"):
        for r in ("R1", "R2"):
            write(root / p / r / PLACE / "gaze.csv", f'{TIME},"gaze, x",gaze x,who\n' + "".join(f'{i},"{i},5",{i}.5,{p}{r}\n' for i in range(4)))
    write(root / "P1" / "R1" / "stationary_tasks" / "fixed_gaze" / "gaze.csv", f"{TIME},who\n9,flat\n")
    write(root / "P1" / "gaze.csv", f"{TIME},who\n9,shallow\n")
    return root


class Counting:
    """A file system that remembers which directories were listed."""

    def __init__(self, system):
        self.system, self.listed = system, []

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.system.get_file_info(selector)


def test_listing_stays_with_the_wanted_directories(study):
    system, root = tree.open_root(str(study))
    seen = Counting(system)
    found = [i.path for i in tree.recording_files(seen, root, {"participant_name": {"P2"}, "round": {"R1"}})]
    assert found == [f"{root}/P2/R1/{PLACE}/gaze.csv"]
    assert seen.listed == [root, f"{root}/P2", f"{root}/P2/R1"]


def test_filters_are_pushed_into_the_listing(spark, study):
    rows = tree.read_tree(spark, str(study), "gaze.csv")
    assert rows.columns == [*tree.LEVELS, "__path", TIME, "gaze,_x", "gaze_x", "who"]
    one = rows.where("participant_name = 'P2' AND round IN ('R1', 'R9') AND gaze_x IS NOT NULL")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "P2" not in plan and "isnotnull(gaze_x" in plan  # only what the source does not settle is left to a filter
    assert sorted((r.who, r["gaze,_x"], r.gaze_x) for r in one.collect()) == [("P2R1", f"{i},5", f"{i}.5") for i in range(4)]
    assert {r.who for r in rows.where("task = 'gaze.csv'").collect()} == {"flat"}
    assert rows.where("participant_name IS NULL").select("who").collect() == [("shallow",)]
    assert rows.where("participant_name = 'P2' AND participant_name = 'P3'").count() == 0


def test_features_read_only_the_participants_asked_for(spark, study):
    # a header that only another participant has is not looked at
    write(study / "P9" / "R1" / PLACE / "gaze.csv", f"{TIME},other\n0,1\n")
    every = recordings.scan_feature(spark, str(study.parent.parent), FeatureSpec("gaze", "R10", 10))
    few = recordings.scan_feature(spark, str(study.parent.parent), FeatureSpec("gaze", "R10", 10), participants=["P1", "P3"], rounds=["R2"])
    assert "other" in every.columns and "other" not in few.columns
    assert sorted({(r.participant_name, r["round"]) for r in few.collect()}) == [("P1", "R2"), ("P3", "R2")]
    assert few.where("participant_name = 'P1'").count() == 4


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 1 << 20])
def test_byte_ranges_hold_every_line_once(spark, tmp_path, part_bytes):
    path = tmp_path / "a" / "b" / "c" / "d" / "e" / "x.csv"
    lines = [f"{i},{'v' * (i % 13)},é{i}" for i in range(200)]
    write(path, ("﻿\nn,a,b\r\n" + "\r\n".join(lines[:100]) + "\r\n\r\n" + "\n".join(lines[100:])).encode())
    options = {"path": str(tmp_path), "file": "x.csv", "columns": '["n", "a", "b", "z"]', "partBytes": str(part_bytes)}
    reader = tree.StudyTree(options).reader(tree.StudyTree(options).schema())
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [(int(r["n"]), r["a"] or "", r["b"], r["z"]) for r in rows] == [(i, "v" * (i % 13), f"é{i}", None) for i in range(200)]


def test_ragged_rows_empty_files_and_packed_files(spark, tmp_path):
    import gzip

    base = tmp_path / "a" / "b" / "c" / "d"
    write(base / "e1" / "x.csv", "n,m,n\n1\n2,3,4,5\n,,\n")
    write(base / "e2" / "x.csv", "")
    write(base / "e3" / "x.csv", "\n\n")
    write(base / "e4" / "x.csv.gz", gzip.compress(b"m,n\n7,8\n"))
    write(base / "e5" / "x.csv", b"n,m\n\xff,1\n")
    rows = tree.read_tree(spark, str(tmp_path), "x.csv*", ["n", "m"]).collect()
    assert sorted(((r.task, r.n, r.m) for r in rows), key=repr) == sorted([("e1", "1", None), ("e1", "2", "3"), ("e1", None, None), ("e4", "8", "7"), ("e5", "�", "1")], key=repr)
    assert tree.read_tree(spark, str(tmp_path), "none.csv", ["n"], present_only=False).count() == 0
    assert "q" not in tree.read_tree(spark, str(tmp_path), "x.csv", ["n", "q"]).columns
    assert tree.read_tree(spark, str(tmp_path), "x.csv", ["q"], present_only=False).where("q IS NULL").count() == 4


@pytest.mark.parametrize("videos", [[], ["video.mp4", "video.avi"], ["movie.mp4"]])
def test_a_camera_has_exactly_one_video(spark, tmp_path, videos):
    base = tmp_path / "R10" / "Participants" / "P1" / "R1" / PLACE / "front"
    write(base / "frame_timing.csv", f"{TIME},resampled_frame\n0,0\n")
    for name in videos:
        write(base / name, "")
    with pytest.raises(Exception, match="video files instead of one"):
        recordings.scan_frame_timing(spark, str(tmp_path), "R10", "front", one_video=True).collect()
    write(tmp_path / "R10" / "Participants" / "P2" / "R1" / PLACE / "front" / "frame_timing.csv", f"{TIME},resampled_frame\n0,0\n")
    write(tmp_path / "R10" / "Participants" / "P2" / "R1" / PLACE / "front" / "video.mkv", "")
    assert recordings.scan_frame_timing(spark, str(tmp_path), "R10", "front", one_video=True, participants=["P2"]).count() == 1


def test_tables_computed_once_and_left_out_when_wrong(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.range(40, numPartitions=4).select((F.col("id") % 4).alias("r"), (F.col("id") * 10).alias(TIME))
    rows = source.mapInArrow(count, source.schema)
    grid = spark.createDataFrame([(r, 10) for r in range(4)], "r long, frames int")
    sinks.save_tabular(rows, grid, str(tmp_path / "a"), ["r"])
    # the range sort samples its input once, the write computes it once
    assert seen.value == 80
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.count() == 40 and [p.name for p in tmp_path.iterdir()] == ["a"]
    with pytest.raises(FileExistsError):
        sinks.save_tabular(rows, grid, str(tmp_path / "a"), ["r"])
    with pytest.raises(sinks.ContractError, match="wrong number"):
        sinks.save_tabular(rows, grid.where("r < 3"), str(tmp_path / "a"), ["r"], mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 40 and [p.name for p in tmp_path.iterdir()] == ["a"]
    more = rows.withColumn("r", F.col("r") + 10)
    sinks.save_tabular(more, grid.withColumn("r", F.col("r") + 10), str(tmp_path / "a"), ["r"], mode="append")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 80


def test_unknown_recordings_are_recordings_too(spark, tmp_path):
    rows = spark.createDataFrame([(None, 0), (None, 10), (1, 0)], f"r long, {TIME} long")
    sinks.save_tabular(rows, spark.createDataFrame([(None, 2), (1, 1)], "r long, frames int"), str(tmp_path / "a"), ["r"])
    with pytest.raises(sinks.ContractError):
        sinks.save_tabular(rows, spark.createDataFrame([(None, 3), (1, 1)], "r long, frames int"), str(tmp_path / "b"), ["r"])


def test_exported_trees_read_back(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias(TIME), (F.col("id") / 3).alias("v"), F.when(F.col("id") % 5 > 0, 'a "quoted", cell').alias("s"))
    place = F.format_string("P%s/R1/driving/1a/no_task/x.csv", F.col("k"))
    listing = {r.file: r.rows for r in sinks.export_tree(rows.repartition(5), str(tmp_path), place, [TIME, "v", "s"], [TIME]).collect()}
    assert listing == {f"P{k}/R1/driving/1a/no_task/x.csv": 143 if k < 6 else 142 for k in range(7)}
    back = tree.read_tree(spark, str(tmp_path), "x.csv").select(F.substring("participant_name", 2, 9).cast("long").alias("k"), F.col(TIME).cast("long").alias(TIME), F.col("v").cast("double").alias("v"), "s")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    first = (tmp_path / "P0" / "R1" / PLACE / "x.csv").read_text().splitlines()[1:]
    times = [int(line.split(",")[0]) for line in first]
    assert times == sorted(times) and not list(tmp_path.rglob(".*"))


def test_batches_stay_small_however_long_a_file(tmp_path):
    """Every row of a batch names its file, so a batch as long as a text block would be many times its size."""
    from pyspark.sql import types as T

    from driverscope.sources import tree

    (tmp_path / "long.csv").write_text("a,b\n" + "".join(f"{i},{i % 7}\n" for i in range(400_000)))
    reader = tree.TreeReader({"path": str(tmp_path), "file": "*.csv"}, T.StructType([T.StructField(c, T.StringType()) for c in "ab"]))
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [int(v) for b in batches for v in b.column("a").to_pylist()] == list(range(400_000))
    assert max(b.num_rows for b in batches) <= 10_000
