"""Text quality from positive and unlabelled documents, by the non-negative risk estimator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, arrow_rows, body, text_chunks, uniform

#: Classes of bytes whose shares of a text are measured.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "closing": b".,;:",
    "loud": b"!?",
    "mark": b"#$%&*@^~<>{}[]\\|/=+_",
    "quote": b"'\"()-",
    "wide": bytes(range(128, 256)),
    "line": b"\n",
}
MEASURES = [*CLASSES, "distinct", "repeats", "word_length", "words"]


class TextMeasures:
    """Shares of byte classes, of distinct and of repeated words, and sizes, for many whole texts at once."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.tables = []
        for members in CLASSES.values():
            table = np.zeros(256, np.uint8)
            table[list(members)] = 1
            self.tables.append(table)

    def of(self, column: pa.Array) -> np.ndarray:
        return np.concatenate([self._chunk(*chunk) for chunk in text_chunks(column)] or [np.empty((0, len(MEASURES)))])

    def _chunk(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        out = np.zeros((len(ends), len(MEASURES)))
        for k, table in enumerate(self.tables):
            sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            out[:, k] = (sums[ends] - sums[starts]) / np.maximum(size, 1)
        hashes, words = self.hasher.words(data, ends)
        before = np.concatenate([[0], words[:-1]])
        same = np.concatenate([[0, 0], np.cumsum(hashes[1:] == hashes[:-1])]) if len(hashes) else np.zeros(1, int)
        count = words - before
        k = len(CLASSES)
        out[:, k] = [len(np.unique(hashes[a:b])) / (b - a) if b > a else 1.0 for a, b in zip(before.tolist(), words.tolist())]
        out[:, k + 1] = np.where(count > 1, same[words] - same[np.minimum(before + 1, words)], 0) / np.maximum(count - 1, 1)
        out[:, k + 2] = size / np.maximum(count, 1)
        out[:, k + 3] = np.log1p(count)
        return out


class AdditiveModel:
    """Sum of one weight per measure and interval, squashed to 0..1."""

    def __init__(self, edges: list[np.ndarray], weights: list[np.ndarray], base: float) -> None:
        self.edges, self.weights, self.base = edges, weights, base

    def places(self, measures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, measures[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def value(self, places: np.ndarray) -> np.ndarray:
        return self.base + sum(w[places[:, k]] for k, w in enumerate(self.weights))

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.value(self.places(measures)), -30, 30)))


def logistic(value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def fit(model: AdditiveModel, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> None:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss.

    While the bracket is negative, the step goes the other way along it, as the estimator asks. With
    no prior the positives are simply told from the unlabelled, for the estimate of the prior.
    """
    p, u = model.places(positive), model.places(unlabelled)
    sizes = [len(w) for w in model.weights]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    x = np.zeros(offset[-1] + 1)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    p, u = p + offset[:-1], u + offset[:-1]

    def spread(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(weight, rows.shape[1]), len(x))
        out[-1] = weight.sum()
        return out

    for step in range(1, steps + 1):
        at_p, at_u = logistic(x[p].sum(axis=1) + x[-1]), logistic(x[u].sum(axis=1) + x[-1])
        if prior is None:
            gradient = spread(p, (at_p - 1) / len(p)) + spread(u, at_u / len(u))
        else:
            risk = -np.log(np.maximum(1 - at_u, 1e-12)).mean() + prior * np.log(np.maximum(1 - at_p, 1e-12)).mean()
            rest = spread(u, at_u / len(u)) - spread(p, prior * at_p / len(p))
            gradient = spread(p, prior * (at_p - 1) / len(p)) + rest if risk >= 0 else -rest
        gradient[:-1] += decay * x[:-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        x -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model.weights = [x[a:b] for a, b in zip(offset, offset[1:])]
    model.base = float(x[-1])


def estimated_prior(model: AdditiveModel, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of the shares of unlabelled and positive documents above a score.

    Where only positives score as high, the ratio is the share of positives among the unlabelled.
    Scores that under nine in ten positives reach are left out, as their ratios are noisy. Too small
    a prior only lowers the scores somewhat; too large a one would lift bad documents.
    """
    p, u = np.sort(model.value(model.places(positive))), np.sort(model.value(model.places(unlabelled)))
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    return float(np.clip((above_u / above_p)[above_p >= 0.9].min(), 0.01, 0.99))


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """True for the fold that no label is learnt from; a null id counts as the text 'null'."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("null"))), F.lit(folds)) == 0


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, measures) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("measures", pa.list_(pa.float64()))])

    def run(batches):
        texts = TextMeasures()
        for batch in batches:
            yield [batch.column(0), list(texts.of(batch.column(1)))]

    return docs.select("doc_id", body().alias("text")).mapInArrow(arrow_rows(run, schema), "doc_id long, measures array<double>")


def train(docs: DataFrame, labels: DataFrame, positives: int = 10_000, unlabelled: int = 20_000, bins: int = 24) -> AdditiveModel | None:
    """Fit on about ``positives`` trusted rows (quality 1) and ``unlabelled`` documents, none held out.

    Labels of 0 are not used. None where there are no positives. Only the samples' measures, a
    dozen numbers a row, come to the driver.
    """
    docs = docs.select("doc_id", "text")
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").filter(~held_out()).select(F.col("doc_id").alias("_id")).distinct()
    share = min(1.0, positives / max(trusted.count(), 1))
    trusted = F.broadcast(trusted.filter(uniform("_id", salt="trusted") < share))  # about ``positives`` ids
    open_docs = docs.filter(~held_out())
    chosen = uniform("doc_id", salt="unlabelled") < min(1.0, unlabelled / max(docs.count(), 1))
    tell = lambda df: np.array([r.measures for r in measured(df).orderBy("doc_id").collect()]).reshape(-1, len(MEASURES))
    p = tell(open_docs.join(trusted, F.col("doc_id") == F.col("_id"), "left_semi"))
    u = tell(open_docs.filter(chosen))
    if not len(p) or not len(u):
        return None
    both = np.concatenate([p, u])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(len(MEASURES))]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], 0.0)
    fit(model, p, u, None)
    prior = estimated_prior(model, p, u)
    fit(model, p, u, prior)
    return model


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``limit`` on).

    Every whole text is scored from its own letters and words alone. Null texts count as empty, and
    empty ones get a score like any other. Repeated rows score alike. Without positive labels every
    score is 0.5. Only doc_id and text are read. An empty table gives no rows.
    """
    model = train(docs, labels, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        texts = TextMeasures()
        for batch in batches:
            measures = texts.of(batch.column(1))
            yield [batch.column(0), model.score(measures) if model else np.full(len(measures), 0.5)]

    scored = docs.select("doc_id", body().alias("text")).mapInArrow(arrow_rows(run, schema), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
