"""One classifier per task on chunk features, fitted and scored by Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driverscope.functions.geometry import logistic
from driverscope.operators.folds import undersample
from driverscope.operators.networks import fit_network

HIDDEN_LAYERS = (256, 128, 64)
MODELS = ("LogisticRegression", "RandomForest", "GradientBoosting", "SVM", "ShallowNet")


def _estimator(model: str, seed: int, **options):
    common = {"featuresCol": "features", "labelCol": "label"}
    if model == "LogisticRegression":
        return LogisticRegression(weightCol="weight", **common, **options)
    if model == "RandomForest":
        return RandomForestClassifier(weightCol="weight", seed=seed, **common, **options)
    if model == "GradientBoosting":
        return GBTClassifier(weightCol="weight", seed=seed, **common, **options)
    if model == "SVM":
        return LinearSVC(weightCol="weight", **common, **options)
    raise ValueError(f"unknown model {model!r}")


def prepare(df: DataFrame, columns: Sequence[str], indicate_missing: bool) -> tuple[DataFrame, list[str]]:
    """Missing values become 0; tree models also get a column that says so, since Spark's trees know no gaps."""
    filled = df.withColumns({f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    names = [f"f_{c}" for c in columns]
    if indicate_missing:
        filled = filled.withColumns({f"m_{c}": F.col(c).isNull().cast("double") for c in columns})
        names += [f"m_{c}" for c in columns]
    return filled, names


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows weigh n / (2 * rows of their class), so both classes weigh the same."""
    counts = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))).scalar()
    own = F.when(F.col(label) == 1, F.col("__c.p")).otherwise(F.col("__c.n") - F.col("__c.p"))
    return df.withColumn("__c", counts).withColumn("weight", F.col("__c.n") / (2.0 * own)).drop("__c")


def fit_task(
    train: DataFrame, columns: Sequence[str], gt: str, model: str, identity: Sequence[str], seed: int = 42, undersampled: bool = False, **options
) -> PipelineModel:
    """Fit one task; rows outside the task (-1) are left out.

    The network has no row weights. It learns from all rows, or with ``undersampled`` from as many of
    the larger class as the smaller one has.
    """
    rows, names = prepare(train.where(F.col(gt) != -1), columns, model in ("RandomForest", "GradientBoosting"))
    rows = rows.withColumn("label", F.col(gt).cast("double"))
    if undersampled:
        rows = undersample(rows, "label", identity, seed)
    if model == "ShallowNet":
        return fit_network(rows, names, identity, HIDDEN_LAYERS, seed, **options)
    stages = [VectorAssembler(inputCols=names, outputCol="features"), _estimator(model, seed, **options)]
    return Pipeline(stages=stages).fit(balanced_weights(rows))


def fit_tasks(train: DataFrame, columns: Sequence[str], tasks: Mapping[str, str], model: str, identity: Sequence[str], seed: int = 42, **options) -> dict[str, PipelineModel]:
    """``tasks`` maps task to its ground truth column."""
    return {task: fit_task(train, columns, gt, model, identity, seed, **options) for task, gt in tasks.items()}


def score_tasks(df: DataFrame, models: Mapping[str, PipelineModel], columns: Sequence[str], tasks: Mapping[str, str], model: str, keep: Sequence[str]) -> DataFrame:
    """Long predictions: kept columns, task, gt, prob. A margin turns into a score by the logistic function."""
    rows, _ = prepare(df, columns, model in ("RandomForest", "GradientBoosting"))
    parts = []
    for task, fitted in models.items():
        scored = fitted.transform(rows)
        if model == "SVM":
            prob = logistic(vector_to_array("rawPrediction")[1])
        else:
            prob = vector_to_array("probability")[1]
        parts.append(scored.select(*keep, F.lit(task).alias("task"), F.col(tasks[task]).cast("int").alias("gt"), prob.alias("prob")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def log_loss_gradient(df: DataFrame, models: Mapping[str, PipelineModel], columns: Sequence[str], tasks: Mapping[str, str]) -> DataFrame:
    """Per task and input the rows, and the weighted log loss's slope in that input's coefficient at the fitted model.

    The slope is relative to the weighted mean size of the input, so 0 up to the solver's tolerance says that the fit is the optimum. ``intercept`` is an
    input of ones. One pass per task.
    """
    parts = []
    for task, fitted in models.items():
        rows, names = prepare(df.where(F.col(tasks[task]) != -1), columns, False)
        rows = balanced_weights(rows.withColumn("label", F.col(tasks[task]).cast("double")))
        scored = fitted.transform(rows)
        error = F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))
        inputs = {**dict(zip(columns, names)), "intercept": None}
        values = {c: F.col(n) if n else F.lit(1.0) for c, n in inputs.items()}
        slopes = [F.try_divide(F.sum(error * v), F.sum(F.col("weight") * F.abs(v))).alias(c) for c, v in values.items()]
        sums = scored.agg(F.count(F.lit(1)).alias("rows"), *slopes)
        cells = F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).alias("slope")) for c in values])
        parts.append(sums.select(F.lit(task).alias("task"), "rows", F.inline(cells)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
