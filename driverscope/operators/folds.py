"""Participant-disjoint folds, exact-size sampling, and clip starts.

Random choices are ranks of a seeded hash of the row's key, so a lost task that
runs again draws the same rows. Ranks over large groups come from ``row_index`` with
slices of the hash range as bins: no task sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driverscope.operators.ordered import row_index, time_bin
from driverscope.operators.spread import join_few
from driverscope.session import settle

HASH_BITS = 63
BIN_BITS = 13


def hash_draw(columns: Sequence[str], seed: int) -> Column:
    """Seeded 63-bit hash of a key."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 1)


def draw_bin(draw: Column, bits: int = HASH_BITS) -> Column:
    """8192 slices of the draw's range, so each holds about the same number of rows."""
    return F.shiftright(draw, max(bits - BIN_BITS, 0))


def ranked(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], seed: int, draw: Column | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """Add ``__rank``: zero-based random order within ``keys``; ``identity`` breaks ties."""
    drawn = df.withColumn("__draw", draw if draw is not None else hash_draw(identity, seed))
    return row_index(drawn, keys, draw_bin(F.col("__draw"), bits), ["__draw", *identity], "__rank").drop("__draw")


@dataclass(frozen=True)
class FoldConfig:
    """Folds over the distinct values of a column."""

    column: str = "participant_name"
    splits: int = 5
    split_train_val: bool = True


def group_folds(df: DataFrame, config: FoldConfig, seed: int = 42, draw: Column | None = None, bits: int = HASH_BITS) -> DataFrame:
    """``(value, fold)`` of every distinct non-NULL value, folds of equal size up to one."""
    values = df.select(config.column).where(F.col(config.column).isNotNull()).distinct()
    return ranked(values, [], [config.column], seed, draw, bits).select(
        config.column, F.pmod(F.col("__rank"), F.lit(config.splits)).cast("int").alias("fold")
    )


def fold_role(fold: Column, test: int, splits: int, split_train_val: bool = True) -> Column:
    """test, val (the next fold, cyclically) or train."""
    role = F.when(fold == test, "test")
    if split_train_val:
        role = role.when(fold == (test + 1) % splits, "val")
    return role.otherwise("train")


def mixed_radix(index: int, radices: Sequence[int]) -> list[int]:
    """Digits of a split number, first radix fastest."""
    digits = []
    for radix in radices:
        index, digit = divmod(index, radix)
        digits.append(digit)
    return digits


def filter_folds(
    df: DataFrame,
    configs: Sequence[FoldConfig],
    split_index: int,
    role: str,
    seed: int = 42,
    draws: Sequence[Column] | None = None,
    bits: int = HASH_BITS,
) -> DataFrame:
    """Rows of a role under nested fold configurations, each over the rows the previous left."""
    if role == "all":
        return df
    for i, (config, test) in enumerate(zip(configs, mixed_radix(split_index, [c.splits for c in configs]))):
        # one row per value, ranked from several passes: settle it before the rows use it
        folds = settle(group_folds(df, config, seed, draws[i] if draws else None, bits))
        wanted = folds.where(fold_role(F.col("fold"), test, config.splits, config.split_train_val) == role)
        df = join_few(df, wanted, [config.column], "left_semi")
    return df


def fixed_folds(df: DataFrame, folds: DataFrame, participant: str = "participant_name") -> DataFrame:
    """Folds from a given table; participants in none keep NULL."""
    return join_few(df, folds.select(participant, "fold"), [participant], "left")


def with_role(df: DataFrame, test: int, splits: int = 5, fold: str = "fold") -> DataFrame:
    """Role of each row under fixed folds; rows without a fold take no part."""
    return df.where(F.col(fold).isNotNull()).withColumn("role", fold_role(F.col(fold), test, splits))


def stratified_folds(
    df: DataFrame, participant: str, label: str, splits: int, seed: int = 42, draw: Column | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """Folds of participants with each label spread evenly. A participant's label is its largest."""
    people = df.groupBy(participant).agg(F.max(label).alias(label))
    return ranked(people, [label], [participant], seed, draw, bits).select(
        participant, label, F.pmod(F.col("__rank"), F.lit(splits)).cast("int").alias("fold")
    )


def take_fraction(
    df: DataFrame, fraction: float, identity: Sequence[str], seed: int = 42, draw: Column | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """Exactly round(fraction * rows) rows, half to even, without replacement."""
    size = df.agg(F.rint(F.count(F.lit(1)) * F.lit(fraction)).cast("long")).scalar()
    return ranked(df, [], identity, seed, draw, bits).where(F.col("__rank") < size).drop("__rank")


def thin_class(
    df: DataFrame, flag: Column, fraction: float, identity: Sequence[str], seed: int = 42, draw: Column | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """Keep a fraction of the flagged rows and all others."""
    kept = take_fraction(df.where(flag), fraction, identity, seed, draw, bits)
    return kept.unionByName(df.where(~F.coalesce(flag, F.lit(False))))


def undersample(
    df: DataFrame, label: str, identity: Sequence[str], seed: int = 42, draw: Column | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """At most as many negatives (label 0) as there are positives (label 1); all positives."""
    positives = df.agg(F.count_if(F.col(label) == 1)).scalar()
    cut = ranked(df.where(F.col(label) == 0), [], identity, seed, draw, bits).where(F.col("__rank") < positives)
    return df.where(F.col(label) == 1).unionByName(cut.drop("__rank"))


def oversample(
    df: DataFrame, multiplier: float, identity: Sequence[str], seed: int = 42, draw: Column | None = None, bits: int = HASH_BITS, pick: Column | None = None
) -> DataFrame:
    """ceil(multiplier * rows) draws with replacement, numbered by ``draw``.

    Row r stands for the draws r, r + n, r + 2n, ...; each draw picks a rank by hash and
    meets it in an equi-join on the rank, so draws and rows spread evenly.
    """
    count = F.count(F.lit(1))
    total = df.agg(F.struct(count.alias("n"), F.ceil(count * F.lit(float(multiplier))).cast("long").alias("draws"))).scalar()
    rows = ranked(df, [], identity, seed, draw, bits)
    numbers = F.when(F.col("__rank") < F.col("__draws"), F.sequence(F.col("__rank"), F.col("__draws") - 1, F.col("__n")))
    picked = pick if pick is not None else hash_draw(["draw"], seed)
    draws = (
        rows.select("__rank")
        .withColumn("__total", total)
        .select("*", F.col("__total.n").alias("__n"), F.col("__total.draws").alias("__draws"))
        .select("__n", F.explode(numbers).alias("draw"))
        .select("draw", F.pmod(picked, F.col("__n")).alias("__rank"))
    )
    return draws.join(rows, "__rank").drop("__rank")


def permute(df: DataFrame, identity: Sequence[str], seed: int = 42) -> DataFrame:
    """Random global order; a range-partitioned sort on the hash."""
    return df.orderBy(hash_draw(identity, seed), *identity)


@dataclass(frozen=True)
class ClipSpec:
    """Clip length, border to leave out, stride and number of validation clips, in frames."""

    length: int
    buffer: int = 0
    stride: int = 1
    validation: int = 1


def scan_sequences(frames: DataFrame, keys: Sequence[str], spec: ClipSpec, exclude: Sequence[str] = (), participant: str = "participant_name") -> DataFrame:
    """Sequences long enough for a clip between the buffers, with their number of training clips."""
    counted = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    if exclude:
        counted = counted.where(~F.col(participant).isin(*exclude))
    usable = F.col("n_frames") - F.lit(2 * spec.buffer)
    return counted.where(usable >= spec.length).withColumn(
        "n_train_chunks", F.greatest(F.lit(1).cast("long"), F.floor(usable / spec.length))
    )


def train_clips(sequences: DataFrame, identity: Sequence[str], spec: ClipSpec, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """One uniform start per training clip, the same on every run."""
    each = sequences.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_train_chunks") - 1)).alias("clip"))
    choices = F.greatest(F.lit(0).cast("long"), F.col("n_frames") - F.lit(2 * spec.buffer + spec.length)) + 1
    drawn = draw if draw is not None else hash_draw([*identity, "clip"], seed)
    return each.withColumn("start", F.pmod(drawn, choices) + F.lit(spec.buffer))


def validation_clips(sequences: DataFrame, spec: ClipSpec) -> DataFrame:
    """The k-th clip from the end, as far as the front buffer allows."""
    each = sequences.select("*", F.explode(F.sequence(F.lit(0), F.lit(spec.validation - 1))).alias("clip"))
    start = F.col("n_frames") - F.lit(spec.buffer + spec.length) - F.col("clip") * F.lit(spec.stride)
    return each.withColumn("start", start).where(F.col("start") >= spec.buffer)


def centre_clip(n_frames: Column, length: int) -> tuple[Column, Column]:
    """First and last frame of the middle clip; a shorter sequence is taken whole."""
    start = F.greatest(F.lit(0).cast("long"), F.floor((n_frames - F.lit(length)) / 2).cast("long"))
    return start, F.least(start + F.lit(length - 1), n_frames - 1)


def clip_frames(frames: DataFrame, clips: DataFrame, keys: Sequence[str], length: int, stride: int = 1, position: str = "position") -> DataFrame:
    """Frames of each clip, every ``stride``-th from its start.

    A clip lists its frame numbers, so frames meet clips in an equi-join on (sequence, frame).
    """
    listed = clips.select(
        *keys, *[c for c in clips.columns if c not in keys], F.explode(F.sequence(F.col("start"), F.col("start") + F.lit(length - 1), F.lit(stride).cast("long"))).alias(position)
    )
    return frames.join(listed, [*keys, position])


def middle_frame(start: Column, length: int) -> Column:
    return start + F.lit(length // 2)


def align_modalities(flow: DataFrame, frames: DataFrame, keys: Sequence[str], flow_frames: int) -> DataFrame:
    """Recordings with at least T flow fields and T + 1 frames. Both sides are counted before they meet."""

    def enough(df: DataFrame, least: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(*keys)

    return enough(flow, flow_frames).join(enough(frames, flow_frames + 1), list(keys), "left_semi")


def last_frames(df: DataFrame, keys: Sequence[str], time: str, span: int | float, slot: int) -> DataFrame:
    """Rows within ``span`` of the end of their recording; the end is a partial maximum joined back."""
    ends = df.groupBy(*keys).agg(F.max(time).alias("__end"))
    return join_few(df, ends, keys, bin=time_bin(time, slot)).where(F.col(time) >= F.col("__end") - F.lit(span)).drop("__end")
