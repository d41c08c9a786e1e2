"""Clip scores from frame scores and frame vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driverscope.operators.spread import hash_bin, join_few


def top_count(scores: Column, ratio: float) -> Column:
    """Number of top frames: the ratio of the clip, at least one."""
    return F.greatest(F.lit(1), F.floor(F.size(scores) * F.lit(ratio)).cast("int"))


def top_mean(scores: Column, ratio: float = 0.1) -> Column:
    """Mean of the highest frame scores of a clip. A clip is one array of fixed length, so this needs no shuffle."""
    k = top_count(scores, ratio)
    best = F.slice(F.sort_array(scores, asc=False), F.lit(1), k)
    return F.aggregate(best, F.lit(0.0), lambda a, v: a + v.cast("double")) / k


def top_gap(scores: Column, ratio: float = 0.1) -> Column:
    """Mean gap between the positions of the top frames; NULL for a single one. Equal scores prefer the earlier frame.

    Gaps between sorted positions add up to last minus first.
    """
    k = top_count(scores, ratio)
    ranked = F.sort_array(F.transform(scores, lambda v, i: F.struct((-v).alias("s"), i.alias("i"))))
    positions = F.transform(F.slice(ranked, F.lit(1), k), lambda s: s["i"])
    return F.try_divide((F.array_max(positions) - F.array_min(positions)).cast("double"), (k - 1).cast("double"))


def spread(scores: Column) -> Column:
    """Sample deviation of a clip's frame scores; NULL below two frames."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v.cast("double")) / n
    squares = F.aggregate(F.transform(scores, lambda v: (v.cast("double") - mean) * (v.cast("double") - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def mean_pooling(frames: DataFrame, clip_keys: Sequence[str], vector: str, dimensions: int) -> DataFrame:
    """Average vector per clip; one partial sum per dimension, no exploded rows."""
    sums = [F.avg(F.get(F.col(vector), F.lit(d)).cast("double")) for d in range(dimensions)]
    return frames.groupBy(*clip_keys).agg(F.array(*sums).alias(vector))


def attention_weights(frames: DataFrame, clip_keys: Sequence[str], score: str = "score") -> DataFrame:
    """Softmax of the frame scores within each clip, as ``attention``.

    Highest score and sum are partial aggregates joined back, so a long clip is never one group.
    """
    highest = frames.groupBy(*clip_keys).agg(F.max(score).alias("__max"))
    weight = F.exp(F.col(score) - F.col("__max"))
    total = join_few(frames.select(*clip_keys, score), highest, clip_keys, bin=hash_bin([score])).groupBy(*clip_keys).agg(
        F.max("__max").alias("__max"), F.sum(weight).alias("__sum")
    )
    return join_few(frames, total, clip_keys, bin=hash_bin([score])).withColumn("attention", weight / F.col("__sum")).drop("__max", "__sum")


def attention_pooling(weighted: DataFrame, clip_keys: Sequence[str], vector: str, dimensions: int) -> DataFrame:
    """Attention-weighted sum of frame vectors and the entropy of the attention, per clip."""
    sums = [F.sum(F.col("attention") * F.get(F.col(vector), F.lit(d)).cast("double")) for d in range(dimensions)]
    entropy = -F.sum(F.col("attention") * F.log(F.col("attention") + F.lit(1e-8)))
    return weighted.groupBy(*clip_keys).agg(F.array(*sums).alias(vector), entropy.alias("attention_entropy"))
