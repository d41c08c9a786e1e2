"""Hard negatives of anchors by slots: the positives' upper limits cut the scores into disjoint slots, each keeps
its best rows, and every window is answered from the slots below its limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, stored

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Sums of whole numbers below this are exact in doubles.
EXACT = float(1 << 53)
#: Anchors and rows multiplied at a time: a score block of 8 MB.
STEP = 1024

TOP_DDL = "anchor long, slot int, vec_id long, score long"


class Slots:
    """The ``k`` best (score, id) per anchor and slot; slot j holds lower[j] <= score <= upper[j]."""

    def __init__(self, upper: np.ndarray, low: np.ndarray, k: int) -> None:
        anchors, slots = upper.shape
        self.upper, self.k = upper, k
        below = np.concatenate([upper[:, 1:], np.full((anchors, 1), LONG_MIN)], axis=1)
        self.lower = np.maximum(below + (below < LONG_MAX), low[:, None])
        self.scores = np.full((slots, anchors, k), LONG_MIN)
        self.ids = np.zeros((slots, anchors, k), np.int64)
        self.held = np.zeros((slots, anchors), np.int64)

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take the rows of a score block whose anchors begin at ``first``."""
        here = slice(first, first + len(scores))
        for j in range(len(self.scores)):
            # once k are held, only rows as good as the last of them can enter
            bar = np.maximum(self.lower[here, j], self.scores[j, here, -1])
            at, row = np.nonzero((scores <= self.upper[here, j, None]) & (scores >= bar[:, None]) & allowed)
            if len(at):
                self._merge(j, at + first, scores[at, row].astype(np.int64), ids[row])

    def _merge(self, j: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(anchor)
        old = np.arange(self.k)[None, :] < self.held[j, touched][:, None]
        anchor = np.concatenate([np.repeat(touched, old.sum(axis=1)), anchor])
        score = np.concatenate([self.scores[j, touched][old], score])
        ids = np.concatenate([self.ids[j, touched][old], ids])
        order = np.lexsort((ids, -1 - score, anchor))  # -1 - x turns the order round without overflow
        anchor, score, ids = anchor[order], score[order], ids[order]
        opens = np.searchsorted(anchor, touched)
        place = np.arange(len(anchor)) - np.repeat(opens, np.diff([*opens, len(anchor)]))
        best = place < self.k
        self.scores[j, anchor[best], place[best]] = score[best]
        self.ids[j, anchor[best], place[best]] = ids[best]
        self.held[j, touched] = np.minimum(np.diff([*opens, len(anchor)]), self.k)

    def columns(self, names: np.ndarray) -> list[np.ndarray]:
        slot, anchor, place = np.nonzero(np.arange(self.k)[None, None, :] < self.held[:, :, None])
        return [names[anchor], slot.astype(np.int32), self.ids[slot, anchor, place], self.scores[slot, anchor, place]]


def whole_numbers(vectors: pa.Array, scale: int) -> np.ndarray:
    """Matrix of floor(scale * x), x as double; beyond the range of a long the nearest long counts."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(len(vectors), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows: in doubles where these are exact, else in 64-bit integers, which wrap."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return a @ b.T
    a, b = (np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64) + np.where(x >= 2.0**63, LONG_MAX, 0) + np.where(x <= -(2.0**63), LONG_MIN, 0) for x in (a, b))
    with np.errstate(over="ignore"):
        return a @ b.T


def usable(vectors: DataFrame, shift_every: int, labels: int) -> DataFrame:
    """row, vec_id, label, dim, embedding of the rows that take part, repeats once, with their new labels."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    moved = F.when(F.pmod("vec_id", F.lit(shift_every)) == 0, (label + 1) % labels).otherwise(label)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).distinct()
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("embedding").alias("dim"), "embedding"), "negative-rows")


def best_per_slot(rows: DataFrame, anchors: DataFrame, sizes: DataFrame, k: int, slots: int, same_label: bool, scale: int) -> DataFrame:
    """(anchor, slot, vec_id, score, place): the ``k`` best rows per anchor and slot, place from 1.

    ``anchors`` have row, vec_id, label, dim, embedding, upper (falling limits) and low. Anchors of one length go in blocks and rows in
    shards of bounded size; a cell is one block with one shard. The anchors come first in a cell and
    stay, rows stream past them, so a task holds a block and its slots. Each cell sends at most k rows per
    anchor and slot on, which meet in a ranking per anchor and slot.
    """
    cells = sizes.agg(F.coalesce(F.sum(F.col("blocks") * F.col("shards")), F.lit(0)).alias("n")).first().n
    sized = lambda df: df.join(sizes, "dim")
    here = sized(anchors).withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    there = sized(rows).withColumn("shard", F.pmod(F.xxhash64("row"), "shards")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = (F.col("before") + F.col("block") * F.col("shards") + F.col("shard")).cast("long").alias("cell")
    given = [F.col(c) for c in ("row", "vec_id", "label", "embedding")]
    both = here.select(cell, F.lit(0).alias("side"), *given, "upper", "low").unionByName(
        there.select(cell, F.lit(1).alias("side"), *given, F.lit(None).cast("array<long>").alias("upper"), F.lit(None).cast("long").alias("low"))
    )
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        def numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
            return part.column(name).to_numpy(zero_copy_only=False).astype(np.int64)

        def opened(parts: list[pa.RecordBatch]):
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            upper = np.full((table.num_rows, slots), LONG_MIN)
            for i, own in enumerate(table.column("upper").to_pylist()):
                upper[i, : len(own)] = own
            return (numbers(table, "row"), numbers(table, "vec_id"), numbers(table, "label"), whole_numbers(table.column("embedding"), scale)), Slots(upper, numbers(table, "low"), k)

        current, waiting, block, best = None, [], None, None
        for batch in batches:
            key = numbers(batch, "cell") * 2 + numbers(batch, "side")
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part, (now, side) = batch.slice(a, b - a), divmod(int(key[a]), 2)
                if now != current:
                    if best is not None:
                        yield best.columns(block[0])
                    current, waiting, block, best = now, [], None, None
                if side == 0:
                    waiting.append(part)
                    continue
                if best is None:
                    if not waiting:
                        continue  # a block without anchors
                    block, best = opened(waiting)
                _, own_ids, own_labels, own = block
                ids, labels, vectors = numbers(part, "vec_id"), numbers(part, "label"), whole_numbers(part.column("embedding"), scale)
                for r in range(0, len(ids), STEP):
                    row = slice(r, r + STEP)
                    for f in range(0, len(own_ids), STEP):
                        at = slice(f, f + STEP)
                        allowed = (own_labels[at, None] == labels[None, row]) == same_label
                        allowed &= own_ids[at, None] != ids[None, row]
                        best.offer(f, products(own[at], vectors[row]), ids[row], allowed)
        if best is not None:
            yield best.columns(block[0])

    # a task per cell, until there are more cells than a driver should list as tasks
    parts = min(max(1, cells), 1 << 16)
    placed = both.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "side", "vec_id", "row")
    found = placed.mapInArrow(arrow_rows(run, schema), TOP_DDL)
    order = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def falling(left: Column, right: Column) -> Column:
    """Comparator: higher scores first, ties by smaller id."""
    return (
        F.when(left["score"] > right["score"], -1).when(left["score"] < right["score"], 1).when(left["vec_id"] < right["vec_id"], -1).when(left["vec_id"] > right["vec_id"], 1).otherwise(0)
    )


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    shift_every: int = 7,
    labels: int = 10,
    scale: int = 256,
    anchor_block: int = 8192,
    cell_work: int = 500_000_000,
) -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, the best rows of other labels in its window.

    A score is the inner product of floor(scale * x). The window of a positive runs from ``low`` to ``high`` percent of its
    score, ends included. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``. Rows with a null id, label, vector or
    component, or a component that is not finite, take no part; where vec_id is divisible by ``shift_every``
    the label moves on by one of ``labels``. Vectors of different lengths never meet. Rows that repeat id,
    label and vector count once; an id with several contents is a row per content, and never its own
    positive or negative. Products beyond 64 bits wrap. Ties go to the smaller vec_id. A negative
    positive's window is empty. Only vec_id, label and embedding are read; an empty table gives no rows.

    Every row meets every anchor twice, in cells of bounded size (see ``best_per_slot``): once for the positives, once for
    the slots. The positives' upper limits fall with their rank, so slot j lies between the limits of
    positives j and j + 1. A window's rows are those of its own slot and the following ones: the answer to
    each window is the first ``negatives`` of a suffix of the anchor's at most positives x negatives rows.
    """
    if not 0 <= low <= high:
        raise ValueError("the window must lie between 0 <= low <= high percent")
    rows = usable(vectors, shift_every, labels)
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("anchors")).where("anchors > 0")
    # a cell has about cell_work multiplications, and at least as many rows as would repay sending its anchors
    per_block = F.least(F.col("anchors"), F.lit(anchor_block))
    shard_rows = F.greatest(F.lit(cell_work) / (per_block * F.greatest("dim", F.lit(1))), 8 * per_block, F.lit(STEP))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("anchors") / anchor_block)).withColumn("shards", F.ceil(F.col("rows") / shard_rows))
    until = F.sum(F.col("blocks") * F.col("shards")).over(W.orderBy("dim").rowsBetween(W.unboundedPreceding, -1))
    sizes = stored(sizes.select("dim", "blocks", "shards", F.coalesce(until, F.lit(0)).alias("before")), "negative-sizes")

    open_window = anchors.withColumn("upper", F.array(F.lit(LONG_MAX))).withColumn("low", F.lit(LONG_MIN))
    near = best_per_slot(rows, open_window, sizes, positives, 1, True, scale)
    near = stored(near.select("anchor", F.col("place").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")

    exact = F.col("positive_score").cast("decimal(20,0)")
    limits = near.select("anchor", "slot", F.floor(exact * high / 100).cast("long").alias("upper"), F.ceil(exact * low / 100).cast("long").alias("low"))
    limits = limits.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "upper"))).getField("upper").alias("upper"), F.min("low").alias("low"))
    windowed = anchors.join(limits.withColumnRenamed("anchor", "row"), "row")
    kept = best_per_slot(rows, windowed, sizes, negatives, positives, False, scale)

    merged = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "score", "vec_id")), falling).alias("kept"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    asked = near.join(merged, "anchor").join(names, "anchor")
    own_low = F.ceil(exact * low / 100).cast("long")
    suffix = F.filter("kept", lambda e: (e["slot"] >= F.col("slot") - 1) & (e["score"] >= own_low))
    return asked.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "e")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score")
    )
