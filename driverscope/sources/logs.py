"""Training logs, fold results, and object-store listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driverscope.operators.index import glob_to_regex
from driverscope.schema import FOLD_RESULT, clean_doubles

# Fixed value: a log line's five metrics, in order.
LOG_METRICS = ("uar", "sens", "spec", "auc", "f1")
LOG_PATTERN = r"UAR=(\d+\.\d+)\s+sens=(\d+\.\d+)\s+spec=(\d+\.\d+)\s+AUC=(\d+\.\d+)\s+F1=(\d+\.\d+)"


def log_metrics(lines: DataFrame, column: str = "value", pattern: str = LOG_PATTERN, names: Sequence[str] = LOG_METRICS) -> DataFrame:
    """The metrics of every line that has them."""
    hits = lines.where(F.col(column).rlike(pattern))
    found = [F.regexp_extract(column, pattern, i).cast("double").alias(n) for i, n in enumerate(names, 1)]
    return hits.select(*[c for c in lines.columns if c != column], *found)


def scan_log_metrics(spark: SparkSession, path: str) -> DataFrame:
    return log_metrics(spark.read.text(path))


def load_fold_results(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON document per fold; NaN becomes NULL."""
    return clean_doubles(spark.read.schema(FOLD_RESULT).option("multiLine", True).option("allowNonNumericNumbers", True).json(pattern))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def manifest_select(listing: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), prefix: str = "", key: str = "key") -> DataFrame:
    """Objects that match an include glob and no exclude glob, with or without the prefix."""

    def matches(globs: Sequence[str]) -> Column:
        every = [g for glob in globs for g in ({glob, f"{prefix.rstrip('/')}/{glob}"} if prefix else {glob})]
        return _any([F.col(key).rlike(glob_to_regex(g)) for g in sorted(every)])

    return listing.where(matches(include) & ~matches(exclude))


def manifest_size(selected: DataFrame, size: str = "size") -> DataFrame:
    return selected.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def manifest_diff(remote: DataFrame, local: DataFrame, key: str = "key", size: str = "size", modified: str = "modified") -> DataFrame:
    """Remote objects to fetch: missing here, different in size, or not newer here."""
    here = local.select(key, F.col(size).alias("__size"), F.col(modified).alias("__modified"))
    joined = remote.join(here, key, "left")
    current = (F.col("__size") == F.col(size)) & (F.col("__modified") > F.col(modified))
    reason = (
        F.when(F.col("__size").isNull(), "missing").when(F.col("__size") != F.col(size), "size").otherwise("older")
    )
    return joined.where(~F.coalesce(current, F.lit(False))).withColumn("reason", reason).drop("__size", "__modified")
