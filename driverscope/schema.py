"""Column contracts of the study's tables and the declarative feature description."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "resampled_epoch_ns"
OBJECT = "object_id"
RECORDING = ("participant_name", "scenario_path")

SCENARIO_INDEX = T.StructType(
    [
        T.StructField("scenario_index", T.LongType()),
        T.StructField("scenario_name", T.StringType()),
        T.StructField("scenario_path", T.StringType()),
        T.StructField("round", T.StringType()),
        T.StructField("cognitive_task", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("duration_frames", T.LongType()),
    ]
)

INTERVALS = T.ArrayType(
    T.StructType([T.StructField("start_ns", T.LongType()), T.StructField("end_ns", T.LongType())])
)

FOLD_RESULT = T.StructType(
    [
        T.StructField("fold", T.IntegerType()),
        T.StructField("best_epoch", T.IntegerType()),
        T.StructField("uar", T.DoubleType()),
        T.StructField("sensitivity", T.DoubleType()),
        T.StructField("specificity", T.DoubleType()),
        T.StructField("auc", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Aggregate:
    """One summary of one signal, or of several columns pooled as one signal."""

    columns: tuple[str, ...]
    function: str
    name: str | None = None

    @property
    def output(self) -> str:
        if self.name is None and len(self.columns) > 1:
            raise ValueError("an aggregate over several columns needs a name")
        return f"{self.name or self.columns[0]}__{self.function}"


@dataclass(frozen=True)
class FeatureSpec:
    """Where a feature table lies and how it is summarised per chunk."""

    name: str
    relative_path: str
    fps: int
    file_name: str | None = None
    columns: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = field(default=())
    normalize: str = "none"
    normalize_aggregate: str = "none"

    @property
    def file(self) -> str:
        return f"{self.file_name or self.name}.csv"

    @property
    def inputs(self) -> list[str]:
        wanted = dict.fromkeys(self.columns)
        for aggregate in self.aggregates:
            wanted.update(dict.fromkeys(aggregate.columns))
        return list(wanted)


def nan_to_null(column: Column | str) -> Column:
    """The study writes missing values as NaN; inside the library they are NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, once, on read."""
    return df.select(
        *[
            nan_to_null(f"`{f.name}`").alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
