"""Sounding segments of an audio level and the answers that match expected responses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.functions.sound import with_sounds
from driverscope.functions.text import answer_words, answered, best_matches, correct_misheard, nback_score, normalise_text, statement_score
from driverscope.operators.chunks import rows_in_intervals
from driverscope.operators.ordered import time_bin
from driverscope.operators.sequential import scan_blocks
from driverscope.session import settle

# Step in seconds, level below which a sample is silent, padding of a response window.
STEP_S = 0.1
SILENCE = 0.05
PAD_S = 0.1
# Seconds of introduction, lead time and answer window of the digit task.
NBACK_INTRO_S = 7.208
NBACK_LEAD_S = 5.0
NBACK_ANSWER_S = (2.5, 5.0)


def nback_schedule(schedule: DataFrame, start: str = "startime", digit: str = "digit") -> DataFrame:
    """Response windows of the digit task from the spoken times."""
    spoken = F.col(start) + F.lit(NBACK_INTRO_S) - F.lit(NBACK_LEAD_S)
    return schedule.withColumns(
        {
            "start_response": spoken + F.lit(NBACK_ANSWER_S[0]),
            "end_response": spoken + F.lit(NBACK_ANSWER_S[1]),
            "expected_response": F.col(digit).cast("int").cast("string"),
        }
    )


def samples_in_windows(samples: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, slot: int) -> DataFrame:
    """Samples of each response window, half-open, with the time since the window's start."""
    inside = rows_in_intervals(samples, windows, keys, time, "start", "end", slot, closed_end=False)
    return inside.withColumn("offset", F.col(time) - F.col("start"))


class SegmentMachine:
    """Runs of loud steps up to the silent step that closes them, as a machine that can be cut into blocks.

    The state is the first step of the run that is open, or none. A block with a silent step leaves the run at its end,
    whatever came in; a block without one goes on with the run that came in, or begins one.
    """

    def __init__(self, step: str, loud: str, width: int) -> None:
        self.step, self.loud, self.width = step, loud, width

    def begin(self) -> bytes:
        return np.array([0, 0]).tobytes()

    def summary(self, block) -> bytes:
        at, loud = block[self.step], block[self.loud].astype(bool)
        silent = np.flatnonzero(~loud)
        after = silent[-1] + 1 if len(silent) else 0
        return np.array([len(silent) > 0, after < len(at), at[min(after, len(at) - 1)]], np.int64).tobytes()

    def advance(self, state: bytes, summary: bytes) -> bytes:
        closed, opens, first = np.frombuffer(summary, np.int64)
        if not closed and np.frombuffer(state, np.int64)[0]:
            return state
        return np.array([opens, first * opens]).tobytes()

    def run(self, state: bytes, block, last: bool):
        at, loud = block[self.step], block[self.loud].astype(bool)
        is_open, start = np.frombuffer(state, np.int64)
        was = np.concatenate([[bool(is_open)], loud[:-1]])
        starts = at[loud & ~was]
        starts = np.concatenate([[start], starts]) if is_open else starts
        ends = at[~loud & was]
        return np.zeros(len(ends), int), {"start": starts[: len(ends)] * self.width, "end": (ends + 1) * self.width}


def sounding_segments(samples: DataFrame, keys: Sequence[str], time: str, level: str, step: int, slot_steps: int = 600, silence: float = SILENCE) -> DataFrame:
    """Runs of steps with a sounding sample: ``start`` and ``end`` in units of ``time``.

    A run must be closed by a silent step, which it includes; a run at the very end is
    dropped. Samples reduce to one row per step before anything is ordered, and recordings run in blocks of
    ``slot_steps``.
    """
    loud = F.coalesce(F.bool_or(F.abs(F.col(level)) >= silence), F.lit(False)).cast("int")
    steps = samples.where(F.col(time).isNotNull()).groupBy(*keys, F.floor(F.col(time) / step).cast("long").alias("__step")).agg(loud.alias("__loud"))
    steps = settle(steps)  # hundreds of samples per step
    spans = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    return scan_blocks(steps, keys, time_bin("__step", slot_steps), ["__step"], ["__step", "__loud"], SegmentMachine("__step", "__loud", step), keys, spans)


def segment_lists(segments: DataFrame, keys: Sequence[str], unit: float) -> DataFrame:
    """Per response window all its segments as an ordered (start, end) list in seconds.

    A window lasts seconds, so its list is short; for whole recordings keep the table of segments.
    """
    pair = F.struct((F.col("start") / F.lit(unit)).alias("start"), (F.col("end") / F.lit(unit)).alias("end"))
    return segments.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("nonsilent_seg"))


def windows_answered(segments: DataFrame, keys: Sequence[str], unit: float) -> DataFrame:
    """Per window the number of its segments and whether it holds a real answer.

    The judgement looks at the two earliest segments only, which are picked within each map task
    before the shuffle, so whole recordings can serve as windows too.
    """
    counted = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    earliest = segment_lists(segments.withColumn("__rn", order).where(F.col("__rn") <= 2), keys, unit)
    return counted.join(earliest.select(*keys, answered("nonsilent_seg").alias("answered")), list(keys))


def score_answers(transcript: DataFrame, task: str, expected: str = "gt", answer: str = "answer", key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Normalised and corrected texts with their score for a task.

    Statements compare by sound (Double Metaphone, the study's way) unless ``key`` gives another Column function of a word.
    """
    want, got = correct_misheard(normalise_text(expected), task), correct_misheard(normalise_text(answer), task)
    texts = transcript.withColumns({"normalised_gt": want, "normalised_answer": got})
    if task == "nback_task":
        score = nback_score("normalised_answer", "normalised_gt")
    elif key is not None:
        score = statement_score("normalised_answer", "normalised_gt", key)
    else:
        texts = with_sounds(texts, {"__heard": answer_words("normalised_answer"), "__wanted": answer_words("normalised_gt")})
        score = best_matches(F.col("__heard"), F.col("__wanted"))
    return texts.withColumn("score", score).drop("__heard", "__wanted")


def misheard_answers(scored: DataFrame, matched: float = 1.0, segments: str = "nonsilent_seg") -> DataFrame:
    """Answers that were spoken but do not match: candidates for the word lists."""
    return scored.where((F.col("score") < matched) & answered(segments))
