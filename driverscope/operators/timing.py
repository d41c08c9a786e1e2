"""Frame numbers and log times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driverscope.operators.ordered import row_index, time_bin


def rolling_step_mean(rows: DataFrame, keys: Sequence[str], time: str, window: int, slot: int, tie: str | None = None) -> DataFrame:
    """Mean of the last ``window`` steps of a log time; NULL until there are that many.

    Consecutive steps add up to a span, so the mean is one look-up ``window`` rows back.
    """
    order = [time] if tie is None else [time, tie]
    numbered = row_index(rows, keys, time_bin(time, slot), order, "__row")
    # keys and row number meet as one value, whose NULL fields are equal
    before = numbered.select(F.struct(*keys, (F.col("__row") + window).alias("__row")).alias("__at"), F.col(time).alias("__then"))
    joined = numbered.withColumn("__at", F.struct(*keys, "__row")).join(before, "__at", "left")
    return joined.withColumn("mean_step", (F.col(time) - F.col("__then")) / F.lit(window)).drop("__at", "__row", "__then")


def frame_in_chunk(rows: DataFrame, chunk_keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Frame number counted from the chunk's first frame."""
    of = F.struct(*chunk_keys).alias("__of")
    first = rows.groupBy(of).agg(F.min(frame).alias("__first"))
    return rows.withColumn("__of", of).join(first, "__of").withColumn("frame_in_chunk", F.col(frame) - F.col("__first")).drop("__of", "__first")


def renumber_frames(rows: DataFrame, keys: Sequence[str], time: str, slot: int, out: str = "resampled_frame") -> DataFrame:
    """Frames 0 .. n-1 of each recording in time order."""
    return row_index(rows, keys, time_bin(time, slot), [time], out)
