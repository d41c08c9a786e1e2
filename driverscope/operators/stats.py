"""Condition subsets and the paired signed-rank test on participant means."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driverscope.operators.ordered import data_bins, running
from driverscope.session import settle

CONDITIONS = ("intoxicated", "cd", "joint")


def condition_flag(condition: str) -> tuple[Column, Column]:
    """(rows that take part, rows of the condition) of a comparison.

    intoxicated: first study without distraction. cd: sober drivers. joint: first
    study, drivers with both impairments against drivers with none.
    """
    intox, cd, first = F.col("intoxicated"), F.col("cd"), F.col("experiment_version") == 1
    parts = {
        "intoxicated": (first & ~cd, intox),
        "cd": (~intox, cd),
        "joint": (first & (intox == cd), intox),
    }
    if condition not in parts:
        raise ValueError(f"unknown condition {condition!r}")
    return parts[condition]


def condition_rows(chunks: DataFrame, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """Chunks with the comparisons they take part in: ``condition``, ``is_condition``."""
    cells = []
    for name in conditions:
        takes_part, inside = condition_flag(name)
        cells.append(F.when(takes_part, F.struct(F.lit(name).alias("condition"), inside.alias("is_condition"))))
    return chunks.select("*", F.inline(F.array_compact(F.array(*cells))))


def paired_means(rows: DataFrame, features: Sequence[str], participant: str = "participant_name", drop_unpaired: bool = False) -> DataFrame:
    """Per condition, feature and participant: mean under baseline and under the condition.

    Participants are paired by name. A comparison whose two sides have different numbers of
    participants is skipped, unless ``drop_unpaired`` leaves out those seen on one side only. The means have
    one row per participant and are settled, since the tests read them several times.
    """
    means = rows.groupBy("condition", participant).agg(
        *[F.avg(F.when(~F.col("is_condition"), F.col(f))).alias(f"{f}__base") for f in features],
        *[F.avg(F.when(F.col("is_condition"), F.col(f))).alias(f"{f}__cond") for f in features],
        F.count_if(~F.col("is_condition")).alias("__base_rows"),
        F.count_if(F.col("is_condition")).alias("__cond_rows"),
    )
    means = settle(means)
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}__base").alias("baseline"), F.col(f"{f}__cond").alias("impaired")) for f in features]
    paired = means.where("__base_rows > 0 AND __cond_rows > 0")
    if not drop_unpaired:
        sides = means.groupBy("condition").agg(
            F.count_if(F.col("__base_rows") > 0).alias("__b"), F.count_if(F.col("__cond_rows") > 0).alias("__c")
        )
        balanced = sides.where("__b = __c").select("condition")
        paired = paired.join(F.broadcast(balanced), "condition", "left_semi")  # one row per comparison, three in all
    return paired.select("condition", participant, F.inline(F.array(*cells)))


def two_sided_normal(z: str | Column) -> Column:
    """Chance of a standard normal value at least as far from 0 as z; NULL and NaN are missing.

    Near 0 from the power series of the error function, further out from the continued fraction of its complement, so that small chances
    keep their digits too.
    """
    value = F.col(z) if isinstance(z, str) else z
    x = F.abs(value) / math.sqrt(2)
    terms = F.sequence(F.lit(1), F.lit(40))
    step = lambda acc, n: F.struct((acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("total"))
    series = F.aggregate(terms, F.struct(x.alias("term"), x.alias("total")), step, lambda acc: acc["total"])
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda acc, n: x + n / 2 / acc)
    far = F.exp(-x * x) / math.sqrt(math.pi) / fraction
    return F.when(~F.isnan(value), F.when(x < 1.5, near).otherwise(far))


def signed_rank(pairs: DataFrame, keys: Sequence[str], baseline: str = "baseline", impaired: str = "impaired", bin: Column | None = None, digits: int = 9) -> DataFrame:
    """Normal approximation of the signed-rank test: mean difference, z, effect |z| / sqrt(n).

    Differences are rounded to ``digits`` first, so sizes that are equal but for the
    order of summation tie whatever the partitioning.

    A pair with a missing side makes the mean difference, z and effect NULL; it counts in n.
    Zero differences are dropped from the ranks but count in n. Ties share the middle rank
    and reduce the variance. Equal sizes collapse to one row before ranking.
    """
    delta = F.round(F.col(impaired) - F.col(baseline), digits)
    differences = pairs.select(*keys, delta.alias("__d"))
    known = F.count("__d") == F.count(F.lit(1))
    every = differences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(known, F.avg("__d")).alias("mean_diff"))
    sizes = (
        differences.where("__d <> 0")
        .groupBy(*keys, F.abs("__d").alias("__size"))
        .agg(F.count(F.lit(1)).alias("__t"), F.count_if(F.col("__d") > 0).alias("__up"))
    )
    sliced = data_bins(sizes, keys, "__size") if bin is None else sizes.withColumn("__slice", bin)
    below = running(sliced, keys, F.col("__slice"), ["__size"], sums={"__below": F.col("__t")}, inclusive=False)
    t = F.col("__t").cast("double")
    sums = below.groupBy(*keys).agg(
        F.sum(F.col("__up") * (F.col("__below") + (t + 1) / 2)).alias("__plus"),
        F.sum(t).alias("__m"),
        F.sum(t * t * t - t).alias("__ties"),
    )
    m = F.col("__m")
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("__ties") / 48
    z = F.when(F.col("mean_diff").isNotNull(), F.try_divide(F.col("__plus") - m * (m + 1) / 4, F.sqrt(variance)))
    of = F.struct(*keys).alias("__of")
    joined = every.withColumn("__of", of).join(sums.select(of, "__plus", "__m", "__ties"), "__of", "left")
    return joined.withColumn("z", z).select(
        *keys, "n", "mean_diff", "z", (F.abs("z") / F.sqrt(F.col("n").cast("double"))).alias("effect")
    )


def result_table(tests: DataFrame, conditions: Sequence[str] = CONDITIONS, level_z: float = 1.959963984540054) -> DataFrame:
    """One row per feature; difference, effect and significance of every condition side by side."""
    return tests.groupBy("feature").pivot("condition", list(conditions)).agg(
        F.first("mean_diff").alias("mean_diff"),
        F.first("effect").alias("effect"),
        F.first(F.abs("z") > F.lit(level_z)).alias("significant"),
    )
