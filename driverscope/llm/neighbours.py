"""Nearest neighbours by few stable projections: kd-trees over them, exact checks, a chi-square stopping test.

Every vector is projected on a few fixed Gaussian directions. The squared ratio of a pair's projected
and true distance then follows a chi-square law with as many degrees of freedom. A query walks the
projected neighbours outwards, checks true distances, and stops when a vector nearer than its k-th
best would have been met already with the wanted probability.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

INDEX_DDL = "dim int, shard long, ids binary, counts binary, vectors binary, projected binary, order binary"
FOUND_DDL = "query_id long, vec_id long, score double"


def directions(dim: int, axes: int, seed: int = 7) -> np.ndarray:
    return np.random.RandomState(seed + dim).standard_normal((dim, axes))


def chi_square_below(x: float, degrees: int) -> float:
    """P(chi-square <= x) for an even number of degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= half / k
        total += term
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


def stopping_ratio(sure: float, degrees: int) -> float:
    """The squared ratio beyond which the test stops: its chi-square probability is ``sure``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < sure else (low, middle)
    return high


class KdTree:
    """Balanced kd-tree in arrays: nodes are halves of an order of the points, cut along their widest axis.

    Halving is by rank, so equal points do no harm. ``order`` alone rebuilds the tree's boxes.
    """

    leaf = 48

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None) -> None:
        self.order = self._sort(points) if order is None else order
        self.points = points[self.order]
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self._node(0, len(points))
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.spans])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.spans])

    def _sort(self, points: np.ndarray) -> np.ndarray:
        order, todo = np.arange(len(points)), [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a > self.leaf:
                own = points[order[a:b]]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
                todo += [(a, a + middle), (a + middle, b)]
        return order

    def _node(self, a: int, b: int) -> int:
        me = len(self.spans)
        self.spans.append((a, b))
        self.children.append(None)
        if b - a > self.leaf:
            middle = a + (b - a) // 2
            self.children[me] = (self._node(a, middle), self._node(middle, b))
        return me

    def outwards(self, query: np.ndarray):
        """(squared projected distance at least, first, last) of leaves, nearest box first."""

        def near(node: int) -> float:
            gap = np.maximum(np.maximum(self.low[node] - query, query - self.high[node]), 0)
            return float(gap @ gap)

        heap = [(near(0), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            below = self.children[node]
            if below is None:
                yield bound, *self.spans[node]
            else:
                for child in below:
                    heapq.heappush(heap, (near(child), child))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of vectors that are not null, empty or zero and hold finite numbers only."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, axes: int = 6, shard_rows: int = 16_384) -> DataFrame:
    """The index, written to the shared folder: one row per shard with its vectors and kd-tree.

    Shards are dealt by a hash of the id, as many as the rows need, so none grows with the table or
    with copies of one vector. Equal vectors of a shard are one point with a list of ids; rows that
    repeat id and vector count once, dropped before they are dealt.
    """
    points = usable(vectors)
    counts = points.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(shard_rows))).alias("shards"))
    dealt = points.distinct().join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("long"))

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        dim = part["dim"][0].as_py()
        rows = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = part["vec_id"].to_numpy()
        # zeros of either sign are equal
        rows = rows + 0.0
        _, first, owner, count = np.unique(rows.view(np.dtype((np.void, 8 * dim))).ravel(), return_index=True, return_inverse=True, return_counts=True)
        grouped = ids[np.argsort(owner.ravel(), kind="stable")]
        distinct = rows[first]
        projected = distinct @ directions(dim, axes)
        tree = KdTree(projected)
        fields = [grouped.astype("<i8"), count.astype("<i8"), distinct.astype("<f8"), projected.astype("<f8"), tree.order.astype("<i8")]
        return pa.table([[dim], [part["shard"][0].as_py()], *([f.tobytes()] for f in fields)], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), *((n, pa.binary()) for n in ("ids", "counts", "vectors", "projected", "order"))])
    return stored(dealt.select("dim", "shard", "vec_id", "v").groupBy("dim", "shard").applyInArrow(build, INDEX_DDL), "vector-index")


class Shard:
    def __init__(self, row: dict, axes: int) -> None:
        dim = row["dim"]
        self.ids, self.counts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["counts"], "<i8")
        order = np.frombuffer(row["order"], "<i8")
        self.tree = KdTree(np.frombuffer(row["projected"], "<f8").reshape(-1, axes), order)
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)[order]
        self.starts = (np.cumsum(self.counts) - self.counts)[order]
        self.counts = self.counts[order]

    def search(self, query_id: int, query: np.ndarray, projected: np.ndarray, k: int, ratio: float) -> list[tuple[float, int]]:
        """The k nearest found, (distance, id) ascending; the query's own id has no part."""
        best: list[tuple[float, int]] = []
        for bound, a, b in self.tree.outwards(projected):
            if len(best) == k and bound > ratio * best[-1][0] ** 2:
                break
            far = np.sqrt(((self.vectors[a:b] - query) ** 2).sum(axis=1))
            reach = best[-1][0] if len(best) == k else np.inf
            for j in np.flatnonzero(far <= reach):
                # ids of equal vectors ascend, each once: k + 1 of them hold the k smallest besides the query's own
                own = self.ids[self.starts[a + j] : self.starts[a + j] + min(self.counts[a + j], k + 1)]
                best += [(float(far[j]), int(i)) for i in own if i != query_id]
            # two contents of an id may be equally far
            best = sorted(set(best))[:k]
        return best


def search(index: DataFrame, queries: DataFrame, k: int = 10, axes: int = 6, sure: float = 0.97, block_rows: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest of every query, ties to the smaller id.

    Queries travel in blocks of bounded size to every shard of their dimension, where they are looked
    up in the shard's tree; only k rows of each come back. ``queries`` has vec_id, v, dim.
    """
    ratio = stopping_ratio(sure, axes)
    blocks = max(1, math.ceil(queries.count() / block_rows))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)))
    shards = index.select(F.col("dim").alias("to_dim"), F.col("shard").alias("to_shard"))
    asked = dealt.join(shards, F.col("dim") == F.col("to_dim")).select("to_dim", "to_shard", F.col("block").alias("to_block"), "vec_id", "v")
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            shard, across = Shard(row, axes), directions(row["dim"], axes)
            for query_id, v in zip(right["vec_id"].to_pylist(), right["v"]):
                query = v.values.to_numpy(zero_copy_only=False)
                out += [(query_id, i, d) for d, i in shard.search(query_id, query, query @ across, k, ratio)]
        return pa.table([list(c) for c in zip(*out)] or [[], [], []], schema=schema)

    found = offered.groupBy("dim", "shard", "block").cogroup(asked.groupBy("to_dim", "to_shard", "to_block")).applyInArrow(run, FOUND_DDL)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, **options) -> DataFrame:
    """The k nearest vectors of each whose id is divisible by ``every``, by Euclidean distance.

    Vectors null, zero or holding null or non-finite numbers take no part; vectors of different lengths
    are never compared; rows without id take no part. Rows that repeat an id are one vector per
    distinct content, and never neighbours of a query of that id. With fewer than k candidates all are
    returned. Only vec_id and embedding are read. An empty table gives no rows.
    """
    vectors = vectors.select("vec_id", "embedding")
    index = build_index(vectors)
    queries = usable(vectors).filter(F.pmod("vec_id", F.lit(every)) == 0)
    return search(index, queries, k, **options)
