"""Answers of the secondary tasks, annotation cells and scenario names."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from driverscope.functions.geometry import c

# Words the recogniser writes for a spoken digit or a spoken "no".
MISHEARD_NBACK = {
    "0": ["zero", "siro"],
    "1": ["one", "wham", "what", "wow"],
    "2": ["two", "to", "till", "true", "due", "chew"],
    "3": ["three", "free", "theory"],
    "4": ["four", "for", "whore", "or", "sour", "floor", "soar"],
    "5": ["five", "bye", "hi", "fine", "fives", "size", "file", "files"],
    "6": ["six", "fix", "sex"],
    "7": ["seven"],
    "8": ["eight", "eights", "hey", "age", "aids", "a", "wait", "date"],
    "9": ["nine", "nye", "night", "no", "nigh", "nein", "nāi", "wǎn", "dine"],
}
MISHEARD_STATEMENT = {"no": ["now"]}
MISHEARD = {"nback_task": MISHEARD_NBACK, "statement_task": MISHEARD_STATEMENT}


def misheard_words(task: str) -> dict[str, str]:
    if task not in MISHEARD:
        raise ValueError(f"no word list for task {task!r}")
    return {word: spoken for spoken, words in MISHEARD[task].items() for word in words}


def normalise_text(text) -> Column:
    """Lower case, without ``.,!?``, single spaces, trimmed."""
    bare = F.regexp_replace(F.lower(c(text)), r"[.,!?]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def correct_misheard(text, task: str) -> Column:
    """Replace whole words by what was said; a word without an entry stays."""
    words = misheard_words(task)
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(words.items())])
    return F.array_join(F.transform(F.split(c(text), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def answer_words(text) -> Column:
    return F.split(c(text), "[ -]")


def nback_score(answer, expected) -> Column:
    """1 when the expected digit is among the answer's words."""
    return F.array_contains(answer_words(answer), c(expected)).cast("double")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty keys count as equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def best_matches(heard: Column, wanted: Column) -> Column:
    """Mean over the wanted keys of the best similarity with any key heard. Both belong to one spoken answer,
    so the nested loop stays inside a short row."""
    best = F.transform(wanted, lambda w: F.array_max(F.transform(heard, lambda h: edit_similarity(w, h))))
    return F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v) / F.size(best)


def statement_score(answer, expected, key: Callable[[Column], Column] = F.soundex) -> Column:
    """Mean over the expected words of the best similarity with any answer word.

    ``key`` turns a word into its sound and is any Column function (identity compares the spelling). Spark
    ships Soundex; the study's key is in ``functions/sound.py`` and used by ``score_answers``.
    """
    return best_matches(F.transform(answer_words(answer), key), F.transform(answer_words(expected), key))


def answered(segments) -> Column:
    """A real answer starts after 0.7 s: the first sound, or else the second, must.

    ``segments`` is an array of (start, end) structs in seconds.
    """
    starts = F.transform(c(segments), lambda s: s["start"])
    return F.coalesce(F.exists(F.slice(starts, 1, 2), lambda s: s > F.lit(0.7)), F.lit(False))


def anomaly_intervals(cell) -> Column:
    """``"12-15, 40-44"`` (seconds) to intervals in ns; anything but a pair is skipped."""
    pieces = F.transform(F.split(c(cell), ","), lambda p: F.filter(F.split(F.trim(p), "-"), lambda x: x != ""))
    pairs = F.filter(pieces, lambda p: F.size(p) == 2)
    second = F.lit(1_000_000_000).cast("long")
    return F.transform(
        pairs,
        lambda p: F.struct(
            (F.trim(p[0]).cast("long") * second).alias("start_ns"), (F.trim(p[1]).cast("long") * second).alias("end_ns")
        ),
    )


def crash_total(cell) -> Column:
    """Number of comma-separated crashes, 0 for a blank cell."""
    return F.when(F.trim(c(cell)) == "", F.lit(0)).otherwise(F.size(F.split(c(cell), ",", -1)))


def hazard_outcome(cell) -> Column:
    """-1 when the hazard failed to happen, 1 for a crash, else 0."""
    return F.when(c(cell).contains("fail"), F.lit(-1)).when(c(cell).contains("crash"), F.lit(1)).otherwise(F.lit(0))


def scenario_short(name) -> Column:
    """``driving/6e-vehicle_run_red_light`` to ``6e``; NULL outside driving."""
    short = F.regexp_extract(c(name), r"^[^/]*/([^-/]*)", 1)
    return F.when(c(name).contains("driving"), short)


def matches_from_start(name, pattern: str) -> Column:
    """Regular expression anchored at the start only."""
    return c(name).rlike(f"^(?:{pattern})")
