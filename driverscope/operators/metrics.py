"""Scores of binary tasks: confusion counts, AUC, thresholds, joint values, losses.

Groups such as (task, fold) are few and large, so nothing here orders a group
inside one task: equal scores collapse to one row first and running counts go
through slices cut at the scores' own quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driverscope.operators.ordered import data_bins, running, score_bin
from driverscope.operators.spread import join_few


def rates(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """NULL wherever a denominator is 0."""
    sensitivity, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return {
        "sensitivity": sensitivity,
        "specificity": specificity,
        "uar": (sensitivity + specificity) / 2,
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }


def confusion(
    predictions: DataFrame, keys: Sequence[str], threshold: float | Column = 0.5, gt: str = "gt", prob: str = "prob", strict: bool = False
) -> DataFrame:
    """Counts and rates per group; rows with gt -1 have no place in the task."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    positive = F.col(prob) > limit if strict else F.col(prob) >= limit
    truth = F.col(gt)
    counts = (
        predictions.where(truth != -1)
        .groupBy(*keys)
        .agg(
            F.count_if(positive & (truth == 1)).alias("tp"),
            F.count_if(~positive & (truth == 0)).alias("tn"),
            F.count_if(positive & (truth == 0)).alias("fp"),
            F.count_if(~positive & (truth == 1)).alias("fn"),
        )
    )
    return counts.withColumns(rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")))


def score_counts(predictions: DataFrame, keys: Sequence[str], gt: str = "gt", prob: str = "prob") -> DataFrame:
    """Positives and negatives per distinct score; rows without a score have no place, as in ``confusion``."""
    truth = F.col(gt)
    return predictions.where((truth != -1) & F.col(prob).isNotNull()).groupBy(*keys, prob).agg(
        F.count_if(truth == 1).alias("pos"), F.count_if(truth == 0).alias("neg")
    )


def sliced_counts(predictions: DataFrame, keys: Sequence[str], gt: str, prob: str, bin: Column | None) -> DataFrame:
    """``score_counts`` with the slice of every score as ``__slice``."""
    counts = score_counts(predictions, keys, gt, prob)
    if bin is not None:
        return counts.withColumn("__slice", bin)
    return data_bins(counts, keys, prob, predictions.where((F.col(gt) != -1) & F.col(prob).isNotNull()))


def roc_auc(predictions: DataFrame, keys: Sequence[str], gt: str = "gt", prob: str = "prob", bin: Column | None = None) -> DataFrame:
    """Chance that a positive outscores a negative, ties half; NULL when a class is missing."""
    counts = sliced_counts(predictions, keys, gt, prob, bin)
    below = running(counts, keys, F.col("__slice"), [prob], sums={"below": F.col("neg")}, inclusive=False)
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return below.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def best_threshold(predictions: DataFrame, keys: Sequence[str], gt: str = "gt", prob: str = "prob", bin: Column | None = None) -> DataFrame:
    """Score from which counting as positive maximises (TPR + 1 - FPR) / 2; the highest one among equals.

    When no score beats calling everything negative (0.5) the threshold is infinite;
    with one class missing it is NULL.
    """
    counts = sliced_counts(predictions, keys, gt, prob, bin)
    upto = running(
        counts,
        keys,
        F.col("__slice"),
        [prob],
        sums={"tp": F.col("pos"), "fp": F.col("neg")},
        descending=True,
        totals={"__p": F.col("pos"), "__n": F.col("neg")},
    )
    # TPR - FPR times both class sizes is a whole number: equal gains really compare equal
    tp, fp, p, n = (F.col(c).cast("decimal(19,0)") for c in ("tp", "fp", "__p", "__n"))
    gain = F.when((F.col("__p") > 0) & (F.col("__n") > 0), tp * n - fp * p)
    best = upto.withColumn("__gain", gain).groupBy(*keys).agg(
        F.max_by(F.struct("__gain", "tp", "fp", "__p", "__n", F.col(prob)), F.when(gain.isNotNull(), F.struct("__gain", F.col(prob)))).alias("__b")
    )
    better = F.col("__b.__gain") > 0
    uar = (F.col("__b.tp") / F.col("__b.__p") + 1 - F.col("__b.fp") / F.col("__b.__n")) / 2
    known = F.col("__b").isNotNull()
    return best.select(
        *keys,
        F.when(better, F.col(f"__b.{prob}")).when(known, F.lit(float("inf"))).alias("threshold"),
        F.when(better, uar).when(known, F.lit(0.5)).alias("uar"),
    )


def confusion_at(predictions: DataFrame, thresholds: DataFrame, keys: Sequence[str], fallback: float = 0.5) -> DataFrame:
    """Scores at each group's own threshold, 0.5 where there is none."""
    joined = join_few(predictions, thresholds.select(*keys, "threshold"), keys, "left", score_bin("prob"))
    return confusion(joined, keys, F.coalesce(F.col("threshold"), F.lit(fallback)))


def joint_metric(per_task: DataFrame, weights: Mapping[str, float], metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean over the tasks that have the metric."""
    total = sum(weights.values())
    first, *rest = weights.items()
    w = reduce(lambda acc, t: acc.when(F.col("task") == t[0], t[1] / total), rest, F.when(F.col("task") == first[0], first[1] / total))
    return per_task.groupBy(*keys).agg(
        *[
            F.try_divide(F.sum(F.col(m) * w), F.sum(F.when(F.col(m).isNotNull(), w))).alias(f"joint_{m}")
            for m in metrics
        ]
    )


def three_class_confusion(wide: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Row-normalised counts of actual x predicted driver state (0 sober, 1 distracted, 2 intoxicated).

    ``wide`` has one row per sample: ``gt3`` and the four task scores. ``impaired_first``
    asks for impairment, then its kind; ``intox_first`` asks for intoxication, then
    distraction. All nine cells appear, 0 where an actual class is absent.
    """
    if rule == "impaired_first":
        guess = F.when(F.col("impaired") < 0.5, 0).when(F.col("impaired_intox") >= 0.5, 2).otherwise(1)
    elif rule == "intox_first":
        guess = F.when(F.col("intox") >= 0.5, 2).when(F.col("cd") >= 0.5, 1).otherwise(0)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    counts = wide.groupBy(*keys, F.col("gt3").alias("actual")).agg(
        *[F.count_if(guess == p).alias(f"p{p}") for p in range(3)]
    )
    rows = counts.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("actual") == a, F.col(f"p{p}"))), F.lit(0)).alias(f"n{a}{p}") for a in range(3) for p in range(3)]
    )
    cells = []
    for a in range(3):
        total = F.col(f"n{a}0") + F.col(f"n{a}1") + F.col(f"n{a}2")
        for p in range(3):
            share = F.coalesce(F.try_divide(F.col(f"n{a}{p}"), total), F.lit(0.0))
            cells.append(F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), share.alias("share")))
    return rows.select(*keys, F.inline(F.array(*cells)))


def cross_entropy(predictions: DataFrame, weights: Mapping[str, float], pos_weight: Mapping[str, float], keys: Sequence[str] = (), gt: str = "gt", logit: str = "logit") -> DataFrame:
    """Masked binary cross-entropy: mean per task, tasks weighted by weight times valid rows."""

    def per_task(values: Mapping[str, float]) -> Column:
        first, *rest = values.items()
        return reduce(lambda acc, t: acc.when(F.col("task") == t[0], float(t[1])), rest, F.when(F.col("task") == first[0], float(first[1])))

    z, y = F.col(logit), F.col(gt)
    # log(1 + exp(-z)) without overflow
    softplus = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    loss = (1 - y) * z + (1 + (per_task(pos_weight) - 1) * y) * softplus
    valid = predictions.where(y >= 0).withColumns({"__loss": loss, "__w": per_task(weights)})
    return valid.groupBy(*keys).agg(F.try_divide(F.sum(F.col("__w") * F.col("__loss")), F.sum("__w")).alias("loss"))


def ranking_loss(clips: DataFrame, keys: Sequence[str], margin: float = 1.0, score: str = "score", label: str = "label", bin: str | None = None) -> DataFrame:
    """Mean hinge ``max(0, margin - (positive - negative))`` over all pairs, without making a pair.

    Positive p pays for the negatives above ``p - margin``. Counts and sums of
    negatives up to every level come from one running pass, so n clips cost n log n
    instead of n squared. NULL-free groups with one class have loss 0.
    """
    shifted = F.when(F.col(label) == 1, F.col(score) - F.lit(margin)).otherwise(F.col(score))
    negative = (F.col(label) == 0).cast("long")
    levels = (
        clips.select(*keys, shifted.alias("__level"), score, label)
        .groupBy(*keys, "__level")
        .agg(
            F.count_if(F.col(label) == 1).alias("__pos"),
            F.sum(negative).alias("__neg"),
        )
    )
    valued = clips.select(*keys, shifted.alias("__level"))
    upto = running(
        data_bins(levels, keys, "__level", valued), keys, F.col("__slice"), ["__level"],
        sums={"__neg_upto": F.col("__neg"), "__sum_upto": F.col("__neg") * F.col("__level")},
        totals={"__negs": F.col("__neg"), "__neg_sum": F.col("__neg") * F.col("__level"), "__poss": F.col("__pos")},
    )
    above, above_sum = F.col("__negs") - F.col("__neg_upto"), F.col("__neg_sum") - F.col("__sum_upto")
    paid = F.col("__pos") * (above_sum - F.col("__level") * above)
    return upto.groupBy(*keys).agg(
        F.coalesce(
            F.try_divide(F.sum(paid), F.first("__negs").cast("double") * F.first("__poss").cast("double")), F.lit(0.0)
        ).alias("rank_loss")
    )


def ranking_loss_with_spread(clips: DataFrame, keys: Sequence[str], margin: float = 1.0, weight: float = 0.1, score: str = "score", label: str = "label", spread: str = "spread") -> DataFrame:
    """Ranking loss, less the mean frame deviation of positives, plus that of negatives."""
    spreads = clips.groupBy(*keys).agg(
        (
            F.coalesce(F.avg(F.when(F.col(label) == 0, F.col(spread))), F.lit(0.0))
            - F.coalesce(F.avg(F.when(F.col(label) == 1, F.col(spread))), F.lit(0.0))
        ).alias("std_loss")
    )
    rank = ranking_loss(clips, keys, margin, score, label)
    return rank.join(spreads, list(keys)).withColumn("loss", F.col("rank_loss") + F.lit(weight) * F.col("std_loss"))


def best_epoch(epochs: DataFrame, keys: Sequence[str], metric: str, carry: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """First epoch with the highest metric (missing never wins), with the values to carry along."""
    rank = F.struct(F.col(metric).isNotNull(), F.col(metric), -F.col(epoch))
    best = F.max_by(F.struct(epoch, metric, *carry), rank)
    return epochs.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in (epoch, metric, *carry)])
