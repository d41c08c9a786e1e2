"""Tables of the study: conditions, completion, durations, hazards, coverage, folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driverscope.functions.text import matches_from_start
from driverscope.operators.index import FAMILIES, distracted, glob_to_regex
from driverscope.operators.ordered import median
from driverscope.operators.spread import join_few


def yes_no_all(column: str) -> Column:
    """Text of a grouping column: all, yes or no."""
    return F.when(F.grouping(column) == 1, "all").when(F.col(column), "yes").otherwise("no")


def dataset_summary(chunks: DataFrame) -> DataFrame:
    """Distinct participants and recordings, and chunks, without a shuffle of all rows twice."""
    per_recording = chunks.groupBy("participant_name", "scenario_name").agg(F.count(F.lit(1)).alias("chunks"))
    per_participant = per_recording.groupBy("participant_name").agg(
        F.count(F.lit(1)).alias("scenarios"), F.sum("chunks").alias("chunks")
    )
    return per_participant.agg(
        F.count(F.lit(1)).alias("participants"), F.sum("scenarios").alias("scenarios"), F.sum("chunks").alias("chunks")
    )


def condition_report(index: DataFrame, families: Sequence[str], hours_of: Column) -> DataFrame:
    """Count and hours per intoxication x distraction x family, with totals.

    Families overlap, so they are conditional sums. The rows are first reduced to the
    four conditions; only those are cubed.
    """
    tests = {f: matches_from_start("scenario_name", FAMILIES[f]) for f in families}
    base = index.groupBy("intoxicated", distracted().alias("cd")).agg(
        *[F.count_if(t).alias(f"{f}_count") for f, t in tests.items()],
        *[F.coalesce(F.sum(F.when(t, hours_of)), F.lit(0)).alias(f"{f}_amount") for f, t in tests.items()],
    )
    names = [f"{f}_{k}" for f in families for k in ("count", "amount")]
    return base.cube("intoxicated", "cd").agg(
        yes_no_all("intoxicated").alias("intoxicated_text"),
        yes_no_all("cd").alias("cd_text"),
        *[F.sum(n).alias(n) for n in names],
    ).drop("intoxicated", "cd")


def completion_report(index: DataFrame) -> DataFrame:
    """Participants who started, drove at least four hazards, drove all eight; per group and in total."""
    hazard = matches_from_start("scenario_name", FAMILIES["hazards"])
    people = index.groupBy("participant_name").agg(F.count_if(hazard).alias("hazards"))
    group = F.col("participant_name").startswith("P")
    base = people.groupBy(group.alias("first_study")).agg(
        F.count(F.lit(1)).alias("started"),
        F.count_if(F.col("hazards") >= 4).alias("four_hazards"),
        F.count_if(F.col("hazards") >= 8).alias("all_hazards"),
    )
    return base.rollup("first_study").agg(
        yes_no_all("first_study").alias("first_study_text"),
        *[F.sum(n).alias(n) for n in ("started", "four_hazards", "all_hazards")],
    ).drop("first_study")


def duration_report(index: DataFrame, families: Sequence[str], minutes: Column) -> DataFrame:
    """Mean and sample deviation of minutes among those who completed most scenarios of a family."""
    cells = F.array(*[F.when(matches_from_start("scenario_name", FAMILIES[f]), F.lit(f)) for f in families])
    rows = index.select("participant_name", minutes.alias("minutes"), F.explode(F.array_compact(cells)).alias("family"))
    counts = rows.groupBy("family", "participant_name").agg(F.count(F.lit(1)).alias("n"))
    most = F.broadcast(counts.groupBy("family").agg(F.max("n").alias("most")))  # one row per family, at most six
    complete = counts.join(most, "family").where("n = most").select("family", "participant_name")
    return join_few(rows, complete, ["family", "participant_name"], "left_semi").groupBy("family").agg(
        F.avg("minutes").alias("mean_minutes"), F.stddev_samp("minutes").alias("std_minutes")
    )


def hazard_tally(index: DataFrame, speeds: DataFrame, keys: Sequence[str], fps: int, speed: str) -> DataFrame:
    """Recordings, kilometres and known hazard outcomes per condition, with the total row."""
    driven = speeds.groupBy(*keys).agg(F.sum(speed).alias("__speed"))
    base = (
        index.join(driven, list(keys), "left")
        .groupBy("intoxicated", distracted().alias("cd"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            (F.sum("__speed") / (fps * 1000)).alias("distance"),
            F.count("number_hazard_crashes").alias("hazards"),
        )
    )
    condition = F.when(F.grouping("__condition") == 1, "total").otherwise(F.col("__condition"))
    name = F.concat(F.lit("intox "), F.col("intoxicated"), F.lit(" cd "), F.col("cd"))
    return base.withColumn("__condition", name).rollup("__condition").agg(
        condition.alias("condition"), F.sum("count").alias("count"), F.sum("distance").alias("distance"), F.sum("hazards").alias("hazards")
    ).drop("__condition")


def interval_seconds(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda a, i: a + i["end_ns"] - i["start_ns"]) / F.lit(1e9)


def anomaly_share(index: DataFrame, seconds: Column) -> DataFrame:
    """Anomalous time, driving time and their ratio."""
    sums = index.agg(F.sum(interval_seconds(F.col("anomalies"))).alias("anomalous_s"), F.sum(seconds).alias("total_s"))
    return sums.withColumn("share", F.try_divide("anomalous_s", "total_s"))


def share_within(index: DataFrame, minutes: Column, limits: Sequence[float]) -> DataFrame:
    return index.agg(*[(100 * F.avg((minutes <= m).cast("double"))).alias(f"within_{m:g}_min") for m in limits])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin includes its upper edge."""
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    low, high = F.col("__ends.low"), F.col("__ends.high")
    slot = F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col(value) - low) * bins, high - low)).cast("int"))
    counted = df.where(F.col(value).isNotNull()).withColumn("__ends", ends).groupBy(F.coalesce(slot, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(index: DataFrame, present: DataFrame, keys: Sequence[str], seconds: Column) -> DataFrame:
    """Share of recordings that have a feature, and their hours."""
    flagged = index.join(present.select(*keys).distinct().withColumn("__has", F.lit(1)), list(keys), "left")
    has = F.col("__has").isNotNull()
    return flagged.agg(
        F.count_if(has).alias("with_feature"),
        F.count(F.lit(1)).alias("recordings"),
        F.avg(has.cast("double")).alias("share"),
        (F.coalesce(F.sum(F.when(has, seconds)), F.lit(0)) / 3600).alias("hours"),
    )


def fold_summary(results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds; missing values are left out."""
    stats = [e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return results.groupBy(*keys).agg(*stats)


def repeat_summary(results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (), repeat: str = "repeat") -> DataFrame:
    """Summary over the folds of each repeat, then the mean of both numbers over the repeats."""
    folds = fold_summary(results, metrics, [*keys, repeat])
    names = [f"{m}_{s}" for m in metrics for s in ("mean", "std")]
    return folds.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def summary_when_complete(results: DataFrame, metrics: Sequence[str], folds: int = 5) -> DataFrame:
    """One summary row, or none while a fold is missing."""
    found = results.agg(F.countDistinct("fold")).scalar()
    return fold_summary(results, metrics).where(found == folds)


def missing_folds(results: DataFrame, folds: int = 5) -> DataFrame:
    every = results.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    return every.join(results.select("fold").distinct(), "fold", "left_anti")


def class_weights(df: DataFrame, keys: Sequence[str] = ("task",), gt: str = "gt") -> DataFrame:
    """Valid and positive counts and the weight of a positive: negatives per positive."""
    valid, positive = F.count_if(F.col(gt) != -1), F.count_if(F.col(gt) == 1)
    return df.groupBy(*keys).agg(valid.alias("valid"), positive.alias("positive")).withColumn(
        "pos_weight", F.try_divide(F.col("valid"), F.col("positive")) - 1
    )


def frequency(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def duration_deviation(durations: DataFrame, participant: str, scenario: str, value: str, bin: Column) -> DataFrame:
    """Deviation from the scenario's median per participant and scenario: the matrix, one row per cell."""
    middle = median(durations, [scenario], value, bin)
    off = join_few(durations, middle, [scenario], bin=bin)
    return off.groupBy(participant, scenario).agg(F.sum(F.col(value) - F.col("median")).alias("deviation"))


def minutes_by_category(index: DataFrame, participant: str, name: str, seconds: Column, categories: Mapping[str, str]) -> DataFrame:
    """Minutes per participant and glob category."""
    return index.groupBy(participant).agg(
        *[
            (F.coalesce(F.sum(F.when(F.col(name).rlike(glob_to_regex(g)), seconds)), F.lit(0)) / 60).alias(c)
            for c, g in categories.items()
        ]
    )
