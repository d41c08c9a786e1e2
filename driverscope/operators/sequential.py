"""Order-dependent Python steps over sorted partitions, in Arrow batches.

Spark partitions by the group, sorts inside the partition and streams Arrow batches; a Python function
sees one group after the other. Against one call per group from Spark this costs nothing per group.
Keys never leave Arrow, so NULL is a key like any other and 64-bit keys keep every digit.

A group must be of bounded size. A machine that has to run along a whole recording goes
through ``scan_blocks``: it is cut into blocks, which run side by side.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Arrays = dict[str, np.ndarray]
#: Positions of the group's rows that carry the result, and the columns added to them.
Result = tuple[np.ndarray, dict[str, Sequence]]


def sorted_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole groups per partition, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; NULL equals NULL, NaN equals NaN."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    out = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
    missing = pc.is_null(column).to_numpy(zero_copy_only=False)
    out = out | (missing[1:] != missing[:-1])
    if pa.types.is_floating(column.type):
        nan = pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)
        out &= ~(nan[1:] & nan[:-1])
    return out


def edges(batch: pa.RecordBatch, keys: Sequence[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Positions at which a group begins, seen from the row ``before`` the batch; without one the first counts."""
    rows = pa.Table.from_batches([before, batch] if before is not None else [batch]).select(list(keys)).combine_chunks()
    changed = np.zeros(rows.num_rows - 1, bool)
    for column in rows.columns:
        changed |= changes(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))
    return np.flatnonzero(changed if before is not None else np.concatenate([[True], changed]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each group): consecutive whole groups."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        found = edges(batch, keys, waiting[-1].slice(waiting[-1].num_rows - 1) if waiting else None)
        held = sum(b.num_rows for b in waiting)
        starts = np.union1d([0], found + held)
        if len(starts) > 1:
            yield pa.Table.from_batches([*waiting, batch.slice(0, starts[-1] - held)]), starts[:-1]
            waiting = [batch.slice(starts[-1] - held)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting), np.zeros(1, int)


def numbers(table: pa.Table, names: Sequence[str]) -> Arrays:
    """Columns as arrays; a NULL is NaN in a column of numbers and None in others."""
    return {n: table.column(n).to_numpy() for n in names}


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    function: Callable[[Arrays], Result],
    keep: Sequence[str],
    added: Sequence[T.StructField],
) -> DataFrame:
    """Apply ``function`` to the arrays of each group.

    It names rows of the group and gives columns for them; the result has the columns ``keep`` of
    those rows, whatever their type, and the added ones (NaN becomes NULL).
    """
    keep, values = list(keep), list(values)
    needed = list(dict.fromkeys([*keys, *order, *values, *keep]))
    schema = T.StructType([df.schema[k] for k in keep] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            arrays, at, found = numbers(table, values), [], []
            for first, last in zip(starts, [*starts[1:], table.num_rows]):
                rows, columns = function({n: a[first:last] for n, a in arrays.items()})
                if len(rows):
                    at.append(np.asarray(rows) + first)
                    found.append(columns)
            if at:
                kept = table.select(keep).take(pa.array(np.concatenate(at))).combine_chunks()
                for field in added:
                    parts = [c[field.name] for c in found]
                    column = [*itertools.chain(*parts)] if isinstance(field.dataType, T.BinaryType) else np.concatenate(parts)
                    kept = kept.append_column(field.name, pa.array(column, to_arrow_type(field.dataType), from_pandas=True))
                yield from kept.to_batches()

    return sorted_groups(df.select(*needed), keys, order).mapInArrow(run, schema)


class Machine(Protocol):
    """A state machine along rows that can be cut into blocks.

    States are bytes. ``summary`` says in few bytes what a block does to any state, ``advance`` applies it,
    and ``run`` gives the block's results once its entry state is known.
    """

    def begin(self) -> bytes: ...

    def summary(self, block: Arrays) -> bytes: ...

    def advance(self, state: bytes, summary: bytes) -> bytes: ...

    def run(self, state: bytes, block: Arrays, last: bool) -> Result: ...


def scan_blocks(
    df: DataFrame, keys: Sequence[str], bin: Column, order: Sequence[str], values: Sequence[str], machine: Machine, keep: Sequence[str], added: Sequence[T.StructField]
) -> DataFrame:
    """Run a state machine along each key, block by block, as if in one pass.

    A block is a key and bin (see ``ordered``). First every block is summed up on its own; the summaries, one
    row per block, are run through in order and give each block its entry state; then all blocks run
    from there. However long a recording, a task holds one block at a time. ``order`` must be total up
    to rows that are alike. The input is read twice.
    """
    keys, values, keep = list(keys), list(values), list(keep)
    needed = list(dict.fromkeys([*keys, *order, *values, *keep]))
    blocks = df.select(*needed, bin.alias("__bin"))

    def summed(block: Arrays) -> Result:
        return np.zeros(1, int), {"__summary": [machine.summary(block)]}

    summaries = map_groups(blocks, [*keys, "__bin"], order, values, summed, [*keys, "__bin"], [T.StructField("__summary", T.BinaryType())])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, states = machine.begin(), None, []

        def known(ends: bool) -> pa.RecordBatch:
            # every row before a group's beginning is its key's last
            is_last = np.zeros(waiting.num_rows, bool)
            is_last[starts[starts > 0] - 1] = True
            is_last[-1] = ends
            columns = [waiting.column(k) for k in [*keys, "__bin"]]
            return pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.binary()), pa.array(is_last)], names=[*keys, "__bin", "__state", "__last"])

        starts = np.empty(0, int)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = edges(batch, keys, waiting.slice(waiting.num_rows - 1) if waiting is not None else None)
            if waiting is not None:
                yield known(len(found) > 0 and found[0] == 0)
            waiting, states, starts, opens = batch, [], found, set(found.tolist())
            for i, summary in enumerate(batch.column("__summary")):
                if i in opens:
                    state = machine.begin()
                states.append(state)
                state = machine.advance(state, summary.as_py())
        if waiting is not None:
            yield known(True)

    entry = T.StructType([df.schema[k] for k in keys] + [T.StructField("__bin", T.LongType()), T.StructField("__state", T.BinaryType()), T.StructField("__last", T.BooleanType())])
    entries = sorted_groups(summaries, keys, ["__bin"]).mapInArrow(enter, entry)

    # the entry state stands before the block's rows; its other columns are filled so that whole numbers stay whole
    filler = {n: F.lit(0).cast(df.schema[n].dataType) for n in values}
    head = entries.select(*keys, "__bin", F.lit(0).alias("__side"), "__state", "__last", *[filler.get(n, F.lit(None).cast(df.schema[n].dataType)).alias(n) for n in needed if n not in keys])
    body = blocks.withColumn("__side", F.lit(1)).withColumn("__state", F.lit(None).cast("binary")).withColumn("__last", F.lit(False))

    def run(block: Arrays) -> Result:
        rows, columns = machine.run(block["__state"][0], {n: block[n][1:] for n in values}, bool(block["__last"][0]))
        return np.asarray(rows, dtype=int) + 1, columns

    return map_groups(body.unionByName(head), [*keys, "__bin"], ["__side", *order], [*values, "__state", "__last"], run, keep, added)
