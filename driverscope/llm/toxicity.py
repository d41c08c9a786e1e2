"""Severity of toxic text by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, body, stored, uniform

LETTERS = re.compile(r"[^\W\d_]+")
SCORE_DDL = "doc_id long, p1 double, p2 double, p3 double, expected_severity double"
GRADES = 4


def chunk_features(chunk: str) -> list[str]:
    """Lower-cased words of a blank-free chunk, and their beginnings of four and five letters."""
    out = []
    for word in LETTERS.findall(chunk.lower()):
        out.append(word)
        out += [f"{word[:k]}~" for k in (4, 5) if len(word) > k]
    return out


class ChunkCounts(dict):
    """Chunk -> positions of its features in a vocabulary, as bytes; cleared when full."""

    limit = 300_000

    def __init__(self, vocabulary: list[str]) -> None:
        super().__init__()
        self.place = {word: k for k, word in enumerate(vocabulary)}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = [self.place[f] for f in chunk_features(chunk) if f in self.place]
        value = self[chunk] = np.array(found, "<i4").tobytes() if found else b""
        return value

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(feature positions, log(1 + count)) of a whole text."""
        found = np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<i4")
        if not len(found):
            return found, np.empty(0)
        places, n = np.unique(found, return_counts=True)
        return places, np.log1p(n)


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int, salt: str) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled rows, drawn by a hash; all of them if there are fewer.

    Several labels of one document count as the largest. Rows without id or label have no part.
    """
    labels = labels.select("doc_id", F.col(column).alias("_label")).dropna().groupBy(F.col("doc_id").alias("_id")).agg(F.max("_label").alias("label"))
    share = min(1.0, bound / max(labels.count(), 1))
    # about ``bound`` rows of 16 bytes: small enough for every task
    drawn = F.broadcast(labels.filter(uniform("_id", salt=salt) < share))
    return docs.select("doc_id", body().alias("text")).join(drawn, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def select_features(sample: DataFrame, most: int, least_documents: int, least_gain: float = 6.0) -> DataFrame:
    """The ``most`` features whose presence tells the two labels apart best (log likelihood ratio).

    A gain under ``least_gain`` is what chance gives one of very many features.
    """
    schema = pa.schema([("feature", pa.string()), ("label", pa.int32())])

    def run(batches):
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                own = {f for chunk in set(text.as_py().split()) for f in chunk_features(chunk)}
                yield [list(own), [label.as_py()] * len(own)]

    rows = sample.select("text", F.col("label").cast("int")).mapInArrow(arrow_rows(run, schema), "feature string, label int")
    counts = rows.groupBy("feature").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    totals = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("a"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("b")).first()
    rate = float(totals.a) / max(totals.a + totals.b, 1)
    n = F.col("a") + F.col("b")
    gain = F.when(F.col("a") > 0, F.col("a") * F.log(F.col("a") / (n * max(rate, 1e-9)))).otherwise(0.0) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * max(1 - rate, 1e-9)))).otherwise(0.0)
    return counts.filter((n >= least_documents) & (gain >= least_gain)).orderBy(F.desc(gain), "feature").limit(most).select("feature", (F.col("a") / n > rate).alias("worse"))


class OrdinalModel:
    """P(severity >= k) = logistic(w.x - cut_k): one weight vector, ordered cuts."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, cuts: np.ndarray) -> None:
        self.vocabulary, self.weights, self.cuts = vocabulary, weights, cuts

    def at_least(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts - np.asarray(value)[..., None], -500, 500)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, steps: int = 400, decay: float = 2e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the most likely cumulative-link model, by full gradients with momentum.

    Cuts are a first value and the exponentials of their distances, so they stay in order. Clean and
    toxic rows weigh the same in total, as toxic ones are rare.
    """
    n = len(grades)
    weight = np.where(grades > 0, 0.5 / max((grades > 0).sum(), 1), 0.5 / max((grades == 0).sum(), 1))
    share = [np.clip(weight[grades >= k].sum(), 1e-4, 1 - 1e-4) for k in range(1, GRADES)]
    start = np.array([np.log((1 - s) / s) for s in share])
    parameters = np.concatenate([np.zeros(features), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        w, gaps = parameters[:features], np.exp(parameters[features + 1 :])
        cuts = parameters[features] + np.concatenate([[0], np.cumsum(gaps)])
        value = np.bincount(rows, values * w[columns], n)
        # P(grade) is the difference of two neighbouring curves
        upper = 1 / (1 + np.exp(np.clip(cuts[None] - value[:, None], -500, 500)))
        padded = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        chance = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), upper * (1 - upper), np.zeros((n, 1))], axis=1)
        low, high = slope[at, grades] / chance, slope[at, grades + 1] / chance
        low, high = low * weight, high * weight
        by_value = high - low
        by_cut = np.array([(np.where(grades == k, low, 0) - np.where(grades + 1 == k, high, 0)).sum() for k in range(1, GRADES)])
        gradient = np.concatenate([np.bincount(columns, values * by_value[rows], features) + decay * w, [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        parameters -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(parameters[features + 1 :])
    return parameters[:features], parameters[features] + np.concatenate([[0], np.cumsum(gaps)])


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, most_features: int = 2_000, least_documents: int = 4) -> OrdinalModel | None:
    """Fit on about ``bound`` labelled documents; None where the labels do not hold both values.

    Labels say toxic or not. A toxic document's grade, 1 to 3, is its third among the toxic ones by
    the signs of toxicity it holds: the logarithmic counts of features that stand out in the sample. Only the vocabulary (``most_features``
    rows) and the sample's counts of it come to the driver; both are bounded by the parameters.
    """
    sample = stored(labelled(docs, labels, "toxic", bound, "toxicity"), "toxicity-sample")
    chosen = select_features(sample, most_features, least_documents).collect()
    vocabulary, worse = [r.feature for r in chosen], np.array([r.worse for r in chosen])
    schema = pa.schema([("label", pa.int32()), ("places", pa.binary()), ("values", pa.binary())])

    def run(batches):
        cache = ChunkCounts(vocabulary)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                places, values = cache.counts(text.as_py())
                yield [[label.as_py()], [places.astype("<i4").tobytes()], [values.astype("<f8").tobytes()]]

    counted = sample.orderBy("doc_id").select("text", F.col("label").cast("int")).mapInArrow(arrow_rows(run, schema), "label int, places binary, values binary").collect()
    toxic = np.array([r.label for r in counted], int)
    if not vocabulary or toxic.min() == toxic.max():
        return None
    places = [np.frombuffer(r["places"], "<i4") for r in counted]
    values = [np.frombuffer(r["values"], "<f8") for r in counted]
    rows = np.repeat(np.arange(len(counted)), [len(p) for p in places])
    columns, values = np.concatenate(places), np.concatenate(values)
    signs = np.bincount(rows, np.where(worse[columns], values, 0), len(counted))
    thirds = np.quantile(signs[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + np.searchsorted(thirds, signs), 0)
    weights, cuts = fit_ordinal(rows, columns, values, grades, len(vocabulary))
    return OrdinalModel(vocabulary, weights, cuts)


def score(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """Per row: doc_id, p1 to p3 (chances of at least that grade), expected_severity (their sum)."""
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.float64()) for k in ("p1", "p2", "p3", "expected_severity"))])

    def run(batches):
        cache = ChunkCounts(model.vocabulary) if model else None
        for batch in batches:
            value = np.zeros(batch.num_rows)
            if cache is not None:
                for k, text in enumerate(batch.column(1)):
                    places, values = cache.counts(text.as_py())
                    value[k] = values @ model.weights[places]
            chances = model.at_least(value) if model else np.zeros((batch.num_rows, GRADES - 1))
            yield [batch.column(0), *chances.T, chances.sum(axis=1)]

    return docs.select("doc_id", body().alias("text")).mapInArrow(arrow_rows(run, schema), SCORE_DDL)


def severity(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """One row per document: doc_id, p1, p2, p3, expected_severity, severity (0 to 3), toxic.

    Every whole text is scored; null and empty texts score as having no features. Toxic means a
    chance of at least ``limit`` of any toxic grade. Repeated rows score alike; only doc_id and text
    are read. Without labels of both kinds nothing is toxic. An empty table gives no rows.
    """
    scored = score(docs, train(docs, labels, **options))
    grade = sum((F.col(f"p{k}") >= 0.5).cast("int") for k in range(1, GRADES))
    return scored.withColumn("severity", grade).withColumn("toxic", F.col("p1") >= limit)


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The documents less the toxic ones, in the scan itself: all columns stay, no row is moved."""
    model = train(docs, labels, **options)
    if model is None:
        return docs
    text = docs.columns.index("text")

    def run(batches):
        cache = ChunkCounts(model.vocabulary)
        for batch in batches:
            keep = []
            for value in batch.column(text):
                places, values = cache.counts(value.as_py() or "")
                keep.append(bool(model.at_least(values @ model.weights[places])[0] < limit))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
