"""Writers of sorted, partitioned Parquet that check what they wrote before it takes its place.

Rows are range-partitioned by recording and time: files come out sorted, so time ranges
prune on min/max, and a recording with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.operators.sequential import changes
from driverscope.operators.timing import renumber_frames
from driverscope.schema import OBJECT, TIME
from driverscope.sources.tree import open_root


class ContractError(ValueError):
    """A table does not have the promised key or length."""


def require_long(df: DataFrame, column: str) -> None:
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.LongType):
        raise ContractError(f"{column} must be a 64-bit integer key")


def length_violations(df: DataFrame, grid: DataFrame, keys: Sequence[str], expected: str = "frames") -> DataFrame:
    """Recordings whose row count differs from their grid's length, missing and surplus ones included."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return _against_grid(counts, grid, keys, expected).where(F.col(expected) != F.col("rows")).select(*keys, expected, "rows")


def _against_grid(counts: DataFrame, grid: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Row counts and grid lengths side by side, 0 where one is missing; a NULL key is a key like any other."""
    of = F.struct(*keys).alias("__of")
    both = grid.select(of, F.col(expected).cast("long").alias(expected)).join(counts.select(of, *[c for c in counts.columns if c not in keys]), "__of", "full")
    filled = both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in (expected, "rows")})
    return filled.select("__of.*", *[c for c in filled.columns if c != "__of"])


def repeated_times(df: DataFrame, keys: Sequence[str], time: str = TIME) -> DataFrame:
    """Times that a recording holds more than once, with their number of rows."""
    return df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def _write(df: DataFrame, path: str, order: Sequence[str], partition: Sequence[str], mode: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """Write sorted files aside, check what was written, then move them into place.

    The input is computed once, however costly; checks read only the columns they need of the written files. A
    table that fails, or a job that is lost, leaves nothing at ``path``.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "errorifexists" and system.exists(target):
        raise FileExistsError(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    try:
        ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.write.partitionBy(*partition).parquet(aside.toString())
        if check is not None:
            check(spark.read.schema(df.schema).parquet(aside.toString()))
        if mode == "append" and system.exists(target):
            _move_files(spark, system, aside, target)
        else:
            system.delete(target, True)
            if not system.rename(aside, target):
                raise OSError(f"cannot move {aside.toString()} to {path}")
    finally:
        system.delete(aside, True)


def _move_files(spark, system, source, target) -> None:
    """Move the data files of a written table into one that exists, keeping their partition directories."""
    found = system.listFiles(source, True)
    while found.hasNext():
        file = found.next().getPath()
        inner = file.toString().split(f"/{source.getName()}/", 1)[1]
        if inner.startswith("_"):
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(target, inner)
        system.mkdirs(place.getParent())
        if not system.rename(file, place):
            raise OSError(f"cannot move {file.toString()} to {place.toString()}")


def save_tabular(df: DataFrame, grid: DataFrame, path: str, keys: Sequence[str], partition: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Time table with one row per grid frame of each recording, no time twice."""
    require_long(df, TIME)

    def check(written: DataFrame) -> None:
        # one pass over the written keys and times: partial counts per time, then per recording
        times = written.groupBy(*keys, TIME).agg(F.count(F.lit(1)).alias("__n"))
        counts = times.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.max("__n").alias("__most"), F.max_by(TIME, "__n").alias(TIME))
        bad = _against_grid(counts, grid, keys, "frames").where("__most > 1 OR rows <> frames").orderBy(F.col("__most").desc_nulls_last()).take(1)
        if bad and (bad[0]["__most"] or 0) > 1:
            raise ContractError(f"a time stands twice: {bad[0].asDict()}")
        if bad:
            raise ContractError(f"wrong number of rows: {bad[0].asDict()}")

    _write(df, path, [*keys, TIME], partition, mode, check)


def save_object_attributes(df: DataFrame, path: str, keys: Sequence[str], partition: Sequence[str] = (), mode: str = "errorifexists") -> None:
    require_long(df, OBJECT)
    _write(df, path, [*keys, OBJECT], partition, mode)


def save_object_tracks(tracks: DataFrame | Mapping[int, DataFrame], path: str, keys: Sequence[str], partition: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One table of all objects, or a table per object id, sorted by time and object."""
    if not isinstance(tracks, DataFrame):
        parts = [df.withColumn(OBJECT, F.lit(i).cast("long")) for i, df in tracks.items()]
        tracks = parts[0]
        for part in parts[1:]:
            tracks = tracks.unionByName(part)
    require_long(tracks, TIME)
    require_long(tracks, OBJECT)
    _write(tracks, path, [*keys, TIME, OBJECT], partition, mode)


def save_frame_timing(df: DataFrame, grid: DataFrame, path: str, keys: Sequence[str], slot: int, partition: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Timing rows renumbered 0 .. n-1 in time order, as many as the grid has frames."""
    save_tabular(renumber_frames(df, keys, TIME, slot), grid, path, keys, partition, mode)


def save_array_dict(df: DataFrame, arrays: Sequence[str], path: str, times: str = "times", mode: str = "errorifexists") -> None:
    """Array table, one row per recording; every array has one entry or one per time."""
    from driverscope.sources.recordings import wrong_lengths

    def check(written: DataFrame) -> None:
        if wrong_lengths(written, arrays, times).take(1):
            raise ContractError("every array must have one entry or one per time")

    _write(df, path, [c for c in df.columns if c not in (*arrays, times)] or [times], (), mode, check)


def export_tree(df: DataFrame, root: str, file: Column, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Write the study's own layout: one CSV table per file below ``root``; returns the files with their rows.

    ``file`` is each row's path below the root. Rows of a file go through one task as a stream, sorted by
    ``order``, into a file aside that is moved into place when whole, so a repeated task only writes the same again. The
    listing is computed, and the files written, when the result is used.
    """
    columns = list(columns)
    rows = df.select(file.alias("__file"), *dict.fromkeys([*order, *columns])).where(F.col("__file").isNotNull())
    placed = rows.repartition("__file").sortWithinPartitions("__file", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)
        current, out, count, aside = None, None, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            system.move(aside, f"{base}/{current}")
            return pa.RecordBatch.from_pydict({"file": [current], "rows": pa.array([count], pa.int64())})

        for batch in batches:
            names = batch.column("__file")
            edges = [0, *(np.flatnonzero(changes(names)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for first, last in zip(edges, edges[1:]):
                name = names[first].as_py()
                table = pa.Table.from_batches([batch.slice(first, last - first)]).select(columns)
                if name != current:
                    if current is not None:
                        yield close()
                    current, count = name, 0
                    folder, _, leaf = f"{base}/{name}".rpartition("/")
                    system.create_dir(folder, recursive=True)
                    aside = f"{folder}/.{leaf}-{uuid.uuid4().hex}"
                    out = arrow_csv.CSVWriter(system.open_output_stream(aside), table.schema)
                out.write_table(table)
                count += last - first
        if current is not None:
            yield close()

    return placed.mapInArrow(run, "file string, rows long")


def save_predictions(df: DataFrame, path: str, partition: Sequence[str] = ("experiment", "fold", "repeat"), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def metric_log(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """One row per epoch, one column per metric."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def save_metric_log(long: DataFrame, metrics: Sequence[str], path: str, mode: str = "overwrite") -> None:
    """One CSV, one line per epoch: a log has as many rows as the training had epochs."""
    metric_log(long, metrics).repartitionByRange(1, "epoch").sortWithinPartitions("epoch").write.mode(mode).option("header", True).csv(path)


def sort_for_reading(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def order_violations(written: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row about files read back: rows, those before which their file holds a larger one, and files that begin inside an earlier one."""
    place = F.struct(*order)
    rows = written.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"), place.alias("__place"))
    before = F.lag("__place").over(Window.partitionBy("__file").orderBy("__at"))
    files = rows.withColumn("__wrong", F.coalesce(before > F.col("__place"), F.lit(False))).groupBy("__file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("__wrong").alias("out_of_order"), F.min("__place").alias("__bin"), F.max("__place").alias("__end")
    )
    ended = F.max("__end").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    counted = files.withColumn("__inside", F.coalesce(F.col("__bin") < ended, F.lit(False)))
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "out_of_order")], F.count_if("__inside").alias("overlaps"))
