"""Fixed-shape arrays per chunk with validity next to every value.

A regular chunk has a fixed number of frames and at most ``max_objects`` objects, so
every array built here is bounded by its declared shape.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.operators.timing import frame_in_chunk
from driverscope.operators.tracks import top_objects


def fill(column: str) -> tuple[Column, Column]:
    """(value with NULL as 0, 1 where there was a value)."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)), F.col(column).isNotNull().cast("int")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select the columns, NULL for those the table lacks."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in have})


def by_frame(entries: Column) -> Column:
    """Sorted (frame, cell) entries to a map; of several rows in one frame the smallest by its values counts."""
    return F.map_from_entries(F.filter(entries, lambda e, i: (i == 0) | (e["frame"] != F.get(entries, i - 1)["frame"])))


def on_grid(cells: Column, frames: int, empty: Column) -> Column:
    """Array over frames 0 .. n-1 from a map frame -> value."""
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda k: F.coalesce(F.try_element_at(cells, k), empty))


def collate_table(
    rows: DataFrame, chunks: DataFrame, keys: Sequence[str], columns: Sequence[str], frames: int, frame: str = "frame"
) -> DataFrame:
    """Per chunk ``table`` and ``table_valid`` (frames x columns) and ``file_valid``.

    ``frame`` is the row's position on the chunk's grid; positions without a row, and
    chunks without rows, are filled and marked invalid.
    """
    ready = require_columns(rows, columns)
    filled = [fill(c) for c in columns]
    cell = F.struct(F.array(*[v for v, _ in filled]).alias("v"), F.array(*[k for _, k in filled]).alias("k"))
    entry = F.struct(F.col(frame).cast("int").alias("frame"), cell.alias("cell"))
    gathered = ready.where(F.col(frame).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__e")).withColumn("__m", by_frame(F.col("__e")))
    empty = F.struct(F.array(*[F.lit(0.0)] * len(columns)).alias("v"), F.array(*[F.lit(0)] * len(columns)).alias("k"))
    joined = chunks.select(*keys).join(gathered, list(keys), "left")
    grid = on_grid(F.col("__m"), frames, empty)
    return joined.withColumn("__g", F.coalesce(grid, F.array_repeat(empty, frames))).select(
        *keys,
        F.transform("__g", lambda c: c["v"]).alias("table"),
        F.transform("__g", lambda c: c["k"]).alias("table_valid"),
        F.col("__m").isNotNull().cast("int").alias("file_valid"),
    )


def collate_aggregates(rows: DataFrame, chunks: DataFrame, keys: Sequence[str], columns: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """One vector per chunk in the declared order, without the ignored columns."""
    kept = [c for c in columns if c not in set(ignore)]
    joined = chunks.select(*keys).join(require_columns(rows, kept).select(*keys, *kept), list(keys), "left")
    filled = [fill(c) for c in kept]
    return joined.select(*keys, F.array(*[v for v, _ in filled]).alias("aggregate"), F.array(*[k for _, k in filled]).alias("aggregate_valid"))


def collate_tracks(
    rows: DataFrame, chunks: DataFrame, keys: Sequence[str], columns: Sequence[str], frames: int, max_objects: int, frame: str = "frame", relevance: str | None = None
) -> DataFrame:
    """Per chunk ``object_id`` (objects), ``tracks`` (objects x frames x columns), ``tracks_valid`` (objects x frames).

    Objects come by relevance, else by first appearance and id; an object frame is valid when all its columns are.
    """
    ready = require_columns(rows, columns)
    objects = ready.groupBy(*keys, "object_id").agg(
        *([F.min(relevance).alias("relevance")] if relevance else []), F.min(frame).alias("__seen")
    )
    order = [F.col("relevance").asc_nulls_last(), "object_id"] if relevance else ["__seen", "object_id"]
    chosen = top_objects(objects, keys, max_objects, order).select(*keys, "object_id", "object_slot")

    values = F.array(*[fill(c)[0] for c in columns])
    complete = F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x).cast("int")
    entry = F.struct(F.col(frame).cast("int").alias("frame"), F.struct(values.alias("v"), complete.alias("k")).alias("cell"))
    empty = F.struct(F.array(*[F.lit(0.0)] * len(columns)).alias("v"), F.lit(0).alias("k"))
    per_object = (
        ready.where(F.col(frame).isNotNull())
        .join(chosen, [*keys, "object_id"])
        .groupBy(*keys, "object_id", "object_slot")
        .agg(F.array_sort(F.collect_list(entry)).alias("__e"))
        .withColumn("__g", on_grid(by_frame(F.col("__e")), frames, empty))
    )
    listed = per_object.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("object_slot", "object_id", "__g"))).alias("__o"))
    joined = chunks.select(*keys).join(listed, list(keys), "left")
    missing = F.lit(max_objects) - F.coalesce(F.size("__o"), F.lit(0))

    def padded(items: Column, pad: Column) -> Column:
        return F.concat(F.coalesce(items, F.slice(F.array(pad), 1, 0)), F.array_repeat(pad, missing))

    blank = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), frames)
    return joined.select(
        *keys,
        padded(F.transform("__o", lambda o: o["object_id"]), F.lit(0).cast("long")).alias("object_id"),
        padded(F.transform("__o", lambda o: F.transform(o["__g"], lambda c: c["v"])), blank).alias("tracks"),
        padded(F.transform("__o", lambda o: F.transform(o["__g"], lambda c: c["k"])), F.array_repeat(F.lit(0), frames)).alias("tracks_valid"),
        F.col("__o").isNotNull().cast("int").alias("file_valid"),
    )


def collate_attributes(rows: DataFrame, chunks: DataFrame, keys: Sequence[str], columns: Sequence[str], max_objects: int) -> DataFrame:
    """First ``max_objects`` objects by id: ids, string attributes and validity, padded."""
    numbered = top_objects(rows.select(*keys, "object_id", *columns), keys, max_objects, ["object_id"])
    entry = F.struct("object_slot", "object_id", F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("a"))
    listed = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__o"))
    joined = chunks.select(*keys).join(listed, list(keys), "left")
    have = F.coalesce(F.size("__o"), F.lit(0))
    missing = F.lit(max_objects) - have
    blank = F.array(*[F.lit("")] * len(columns))
    return joined.select(
        *keys,
        F.concat(F.coalesce(F.transform("__o", lambda o: o["object_id"]), F.array().cast("array<bigint>")), F.array_repeat(F.lit(0).cast("long"), missing)).alias("object_id"),
        F.concat(F.coalesce(F.transform("__o", lambda o: o["a"]), F.array().cast("array<array<string>>")), F.array_repeat(blank, missing)).alias("attributes"),
        F.concat(F.array_repeat(F.lit(1), have), F.array_repeat(F.lit(0), missing)).alias("attributes_valid"),
    )


def collate_array(column: str, size: int, default: float = 0.0) -> tuple[Column, Column]:
    """(array of the declared size or all defaults, 1 where there was one). A wrong size raises."""
    value = F.col(column).cast("array<double>")
    wrong = F.raise_error(F.concat(F.lit(f"{column}: expected {size} values, found "), F.size(value).cast("string"))).cast("array<double>")
    checked = F.when(value.isNull(), F.array_repeat(F.lit(default), size)).when(F.size(value) == size, value).otherwise(wrong)
    return checked, value.isNotNull().cast("int")


def collate_frame_timing(rows: DataFrame, chunks: DataFrame, keys: Sequence[str], columns: Sequence[str], frames: int, frame: str = "resampled_frame") -> DataFrame:
    """Per chunk ``timing`` and ``timing_valid`` (frames x columns) and ``file_valid``; the last column is the frame's place in the chunk."""
    placed = frame_in_chunk(rows, keys, frame)
    out = collate_table(placed, chunks, keys, [*columns, "frame_in_chunk"], frames, "frame_in_chunk")
    return out.withColumnsRenamed({"table": "timing", "table_valid": "timing_valid"})


@dataclass(frozen=True)
class ArrayShape:
    """Declared form of an array: shape of an entry, or of the whole where it does not vary in time; type, default."""

    shape: tuple[int, ...] = ()
    type: str = "double"
    default: float = 0
    temporal: bool = True

    @property
    def size(self) -> int:
        return math.prod(self.shape)


def reshape(flat: Column, shape: Sequence[int]) -> Column:
    """A flat array in nested arrays of the shape; no axis gives its only value."""
    if not shape:
        return F.get(flat, F.lit(0))
    if len(shape) == 1:
        return flat
    return _rows_of(reshape(flat, [shape[0] * shape[1], *shape[2:]]) if len(shape) > 2 else flat, shape[0], shape[1])


def _rows_of(values: Column, count: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(values, i * width + 1, width))


def filled_with(value: Column, shape: Sequence[int]) -> Column:
    for width in reversed(shape):
        value = F.array_repeat(value, width)
    return value


def _flat(column: Column, kind: T.DataType) -> Column:
    """All values of nested arrays in one; a single value becomes an array."""
    if not isinstance(kind, T.ArrayType):
        return F.array(column)
    while isinstance(kind.elementType, T.ArrayType):
        column, kind = F.flatten(column), kind.elementType
    return column


def collate_arrays(
    rows: DataFrame, chunks: DataFrame, keys: Sequence[str], shapes: Mapping[str, ArrayShape], frames: int, start: str, end: str, times: str = "times"
) -> DataFrame:
    """Per chunk every array in its declared shape, and ``<name>_valid``: 1 where the chunk has one.

    ``rows`` hold arrays with one entry per time, or one for all; entries may be nested or flat. An array that varies in time is cut to
    the times from the chunk's ``start`` to its ``end`` and has ``frames`` entries then, or its one entry
    stands for each. A fixed array is taken whole. A chunk without a row gets defaults; another number of values raises.
    Chunks and rows meet by their keys, NULL included.
    """
    of = F.struct(*keys).alias("__of")
    held = rows.select(of, times, *shapes, F.lit(1).alias("__have"))
    joined = chunks.select(of, F.col(start).alias("__from"), F.col(end).alias("__to")).join(held, "__of", "left")
    wanted = F.filter(F.transform(times, lambda t, i: F.when(t.between(F.col("__from"), F.col("__to")), i)), lambda i: i.isNotNull())
    columns: list[Column] = []
    for name, form in shapes.items():
        entries = _shaped(name, rows.schema[name].dataType, form, frames, wanted)
        blank = filled_with(F.lit(form.default).cast(form.type), (frames, *form.shape) if form.temporal else form.shape)
        have = F.col("__have").isNotNull() & F.col(name).isNotNull()
        columns += [F.when(have, entries).otherwise(blank).alias(name), have.cast("int").alias(f"{name}_valid")]
    return joined.select("__of.*", *columns)


def _shaped(name: str, whole: T.ArrayType, form: ArrayShape, frames: int, wanted: Column) -> Column:
    """The array ``name`` in its declared form; ``wanted`` are the positions of the chunk's times."""

    def one(value: Column, kind: T.DataType) -> Column:
        flat = _flat(value, kind).cast(f"array<{form.type}>")
        text = F.concat(F.lit(f"{name}: expected {form.size} values, found "), F.size(flat).cast("string"))
        return reshape(F.when(F.size(flat) == form.size, flat).otherwise(F.raise_error(text)), form.shape)

    if not form.temporal:
        return one(F.col(name), whole)
    held = F.when(F.size(name) == 1, F.array_repeat(F.get(name, F.lit(0)), frames)).otherwise(F.transform(wanted, lambda i: F.get(F.col(name), i)))
    text = F.concat(F.lit(f"{name}: expected {frames} entries, found "), F.size(held).cast("string"))
    return F.when(F.size(held) == frames, F.transform(held, lambda e: one(e, whole.elementType))).otherwise(F.raise_error(text))
