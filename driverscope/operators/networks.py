"""A multi-layer perceptron fitted to all rows: gradients in tasks, one step of L-BFGS after another.

The model is Spark's (sigmoid layers, softmax, mean cross entropy, its first weights for a seed) and is returned as one. Spark's
own fit runs its matrix products in plain Java and on as many tasks as the rows' files happen to give; here the
rows are dealt evenly to all cores, and a task runs the products of its rows in numpy. What leaves a task is one
number per weight, summed by a grouping; the driver holds a few vectors of the network's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driverscope.session import settle

#: Rows of one matrix product: a batch of Spark's usual 10,000 rows is whole blocks.
BLOCK = 500
#: Files of the training rows per core: tasks are packed from them, about equal in size.
FILES_PER_CORE = 4
#: Steps that L-BFGS remembers, and its line search's rounds and Wolfe constants, as in Spark ML.
MEMORY, SEARCHES, FALL, BEND = 10, 10, 1e-4, 0.9

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def unpack(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, offsets) of each layer out of Spark's flat weights."""
    out, at = [], 0
    for inputs, outputs in zip(layers, layers[1:]):
        end = at + inputs * outputs
        out.append((weights[at:end].reshape(inputs, outputs), weights[end : end + outputs]))
        at = end + outputs
    return out


class Slopes:
    """Cross entropy and its slope in every weight, summed over the rows added.

    The arrays that the layers fill are made once: a block of rows asks for no memory.
    """

    def __init__(self, weights: np.ndarray, layers: Sequence[int]):
        self.steps, hidden = unpack(weights, layers), layers[1:-1]
        self.negated = [(-w, -b) for w, b in self.steps[:-1]]
        self.seen, self.delta, self.bend = ([np.empty((BLOCK, k)) for k in hidden] for _ in range(3))
        self.block = np.empty(len(weights))
        self.parts = unpack(self.block, layers)
        self.total, self.loss, self.rows = np.zeros(len(weights)), 0.0, 0

    def add(self, x: np.ndarray, label: np.ndarray) -> None:
        for first in range(0, len(x), BLOCK):
            self._add_block(x[first : first + BLOCK], label[first : first + BLOCK])

    def _add_block(self, x: np.ndarray, label: np.ndarray) -> None:
        n, seen = len(x), [x]
        for (w, b), room in zip(self.negated, self.seen):
            z = np.matmul(seen[-1], w, out=room[:n])
            z += b
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            seen.append(np.reciprocal(z, out=z))
        w, b = self.steps[-1]
        # a row of z is a class: numpy runs along the rows, not along the few classes
        z = w.T @ seen[-1].T
        z += b[:, None]
        z -= z.max(axis=0)
        z -= np.log(np.exp(z).sum(axis=0))
        at = (label, np.arange(n))
        self.loss -= float(z[at].sum())
        np.exp(z, out=z)
        z[at] -= 1.0
        delta = z.T
        for k in range(len(self.steps) - 1, -1, -1):
            w, b = self.parts[k]
            np.matmul(seen[k].T, delta, out=w)
            np.sum(delta, axis=0, out=b)
            if k:
                bend = np.subtract(1.0, seen[k], out=self.bend[k - 1][:n])
                bend *= seen[k]
                delta = np.matmul(delta, self.steps[k][0].T, out=self.delta[k - 1][:n])
                delta *= bend
        self.total += self.block
        self.rows += n


def distributed(rows: DataFrame, inputs: Sequence[str], label: str, mean: np.ndarray, scale: np.ndarray, layers: Sequence[int]) -> Objective:
    """Mean cross entropy over all rows and its slopes: every call is one job over the rows."""
    inputs, size = list(inputs), sum((i + 1) * o for i, o in zip(layers, layers[1:]))

    def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slopes = Slopes(weights, layers)
            for batch in batches:
                x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]) - mean) * scale
                slopes.add(x, batch.column(label).to_numpy(zero_copy_only=False).astype(int))
            value = np.append(slopes.total, [slopes.loss, slopes.rows])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size + 2), pa.int32()), "value": value})

        sums = rows.select(*inputs, label).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        total = np.empty(size + 2)
        total[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
        return total[size] / total[size + 1], total[:size] / total[size + 1]

    return objective


class SearchFailed(ArithmeticError):
    """No step along the direction meets the strong Wolfe conditions."""


def _between(left: tuple[float, float, float], right: tuple[float, float, float]) -> float:
    """Lowest place of the cubic through two (place, value, slope), kept off both ends."""
    (t1, f1, d1), (t2, f2, d2) = sorted((left, right))
    bend = d1 + d2 - 3 * (f1 - f2) / (t1 - t2)
    root = math.sqrt(max(bend * bend - d1 * d2, 0.0))
    down = d2 - d1 + 2 * root
    place = t2 - (t2 - t1) * (d2 + root - bend) / down if down else t1
    return min(max(place, t1 + 0.1 * (t2 - t1)), t1 + 0.9 * (t2 - t1))


def wolfe_step(along: Callable[[float], tuple[float, float]], value: float, slope: float, first: float) -> float:
    """A step with the strong Wolfe conditions: bracket it by growing steps, then cut the bracket."""

    def zoom(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
        for _ in range(SEARCHES):
            t = _between(low, high)
            f, d = along(t)
            if f > value + FALL * t * slope or f >= low[1]:
                high = (t, f, d)
                continue
            if abs(d) <= BEND * abs(slope):
                return t
            if d * (high[0] - low[0]) >= 0:
                high = low
            low = (t, f, d)
        raise SearchFailed

    if slope > 0:
        raise SearchFailed
    low, t = (0.0, value, slope), first
    for k in range(SEARCHES):
        f, d = along(t)
        if not math.isfinite(f):
            t /= 2
            continue
        here = (t, f, d)
        if f > value + FALL * t * slope or (f >= low[1] and k):
            return zoom(low, here)
        if abs(d) <= BEND * abs(slope):
            return t
        if d >= 0:
            return zoom(here, low)
        low, t = here, 1.5 * t
    raise SearchFailed


def minimise(objective: Objective, start: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """L-BFGS, with Spark ML's line search and tests of convergence."""
    x = start
    value, slopes = objective(x)
    begun, values = value, [value]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    retried = False
    for done in range(rounds):
        if np.linalg.norm(slopes) <= max(tolerance * abs(value), 1e-8):
            break
        if len(values) > 1 and abs(value - max(values[-20:])) <= tolerance * begun:
            break
        way, shares = -slopes, []
        for s, y in reversed(steps):
            share = s @ way / (s @ y)
            shares.append(share)
            way = way - share * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), share in zip(steps, reversed(shares)):
            way = way + (share - y @ way / (s @ y)) * s
        seen: dict[float, tuple[float, np.ndarray]] = {}

        def along(t: float) -> tuple[float, float]:
            seen.clear()
            seen[t] = objective(x + t * way)
            return seen[t][0], float(seen[t][1] @ way)

        try:
            t = wolfe_step(along, value, float(slopes @ way), 1.0 if done else 1.0 / np.linalg.norm(way))
        except SearchFailed:
            if retried or not steps:
                break
            retried, steps = True, []
            continue
        retried = False
        after, bent = seen[t]
        if (bent - slopes) @ way > 0:
            steps = [*steps, (t * way, bent - slopes)][-MEMORY:]
        x, value, slopes = x + t * way, after, bent
        values.append(value)
    return x


def spark_network(spark: SparkSession, layers: Sequence[int], seed: int, weights: np.ndarray | None = None):
    """Spark's model with these weights, or with those it begins with; no rows are learned from."""
    estimator = MultilayerPerceptronClassifier(layers=list(layers), seed=seed, featuresCol="features", labelCol="label", maxIter=0)
    if weights is not None:
        estimator = estimator.setInitialWeights(Vectors.dense(weights))
    nothing = Vectors.dense([0.0] * layers[0])
    return estimator.fit(spark.createDataFrame([(nothing, float(k)) for k in range(layers[-1])], ["features", "label"]))


def fit_network(rows: DataFrame, inputs: Sequence[str], identity: Sequence[str], hidden: Sequence[int], seed: int, maxIter: int = 100, tol: float = 1e-6) -> PipelineModel:
    """Standardised inputs and a two-class network on the column ``label``; ``identity`` deals the rows to files."""
    spark, layers = rows.sparkSession, [len(inputs), *hidden, 2]
    files = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    placed = settle(rows.select(*inputs, "label", *identity).repartition(files, *identity))
    stages = [VectorAssembler(inputCols=list(inputs), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    scaling = Pipeline(stages=stages).fit(placed)
    mean, spread = scaling.stages[1].mean.toArray(), scaling.stages[1].std.toArray()
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    begin = spark_network(spark, layers, seed).weights.toArray()
    weights = minimise(distributed(placed, inputs, "label", mean, scale, layers), begin, maxIter, tol)
    return PipelineModel(stages=[*scaling.stages, spark_network(spark, layers, seed, weights)])
