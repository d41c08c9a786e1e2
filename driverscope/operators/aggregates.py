"""Chunk aggregates by name, pooled columns, and z-scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driverscope.operators.ordered import running
from driverscope.operators.spread import hash_bin, join_few
from driverscope.schema import Aggregate

# Which columns the ordered aggregates need next to the value x: the value one row
# earlier (gap included) and the last known value before the row.
PREVIOUS = "__prev_{}"
KNOWN = "__known_{}"


def _minutes(x: Column, fps: float) -> Column:
    return F.count(x) / F.lit(fps * 60.0)


def _changed(x: Column, known: Column) -> Column:
    return F.when(x.isNotNull() & known.isNotNull(), ((x == 1) != (known == 1)).cast("long"))


AggregateBuilder = Callable[[Column, Column, Column, float], Column]

# name -> builder(x, previous row's x, last known x, fps). NULL is "missing" throughout.
AGGREGATES: dict[str, AggregateBuilder] = {
    "mean": lambda x, p, k, fps: F.avg(x),
    "abs_mean": lambda x, p, k, fps: F.avg(F.abs(x)),
    "pos_mean": lambda x, p, k, fps: F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)),
    "neg_mean": lambda x, p, k, fps: F.coalesce(-F.avg(F.when(x < 0, x)), F.lit(0.0)),
    "sum_rate": lambda x, p, k, fps: F.try_divide(F.sum(x), _minutes(x, fps)),
    "std": lambda x, p, k, fps: F.stddev_pop(x),
    "change_rate": lambda x, p, k, fps: F.try_divide(
        F.when(F.count(x) > 0, F.coalesce(F.sum(_changed(x, k)), F.lit(0))), _minutes(x, fps)
    ),
    "skewness": lambda x, p, k, fps: F.skewness(x),
    "kurtosis": lambda x, p, k, fps: F.kurtosis(x),
    # a constant signal has no changes to count, so its complexity is 0
    "cid_ce": lambda x, p, k, fps: F.coalesce(F.try_divide(F.sqrt(F.sum((x - p) * (x - p))), F.stddev_pop(x)), F.lit(0.0)),
}
NEEDS_PREVIOUS = {"cid_ce"}
NEEDS_KNOWN = {"change_rate"}
# A column without any value leaves these functions without a result, and a pooled
# result over several columns is then missing as a whole.
ZERO_WHEN_EMPTY = {"pos_mean", "neg_mean", "cid_ce"}


def aggregate_builder(function: str) -> AggregateBuilder:
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate function {function!r}")
    return AGGREGATES[function]


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], aggregates: Sequence[Aggregate], bin: Column | None
) -> DataFrame:
    """Add the previous and last known values that ``cid_ce`` and ``change_rate`` look at.

    Regular chunks hold a fixed number of frames, so ``bin=None`` windows each chunk
    directly. Whole-recording chunks have no bound: give a time bin.
    """
    previous = sorted({c for a in aggregates if a.function in NEEDS_PREVIOUS for c in a.columns})
    known = sorted({c for a in aggregates if a.function in NEEDS_KNOWN for c in a.columns})
    if not previous and not known:
        return df
    if bin is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {PREVIOUS.format(c): F.lag(c).over(w) for c in previous}
            | {KNOWN.format(c): F.last(c, ignorenulls=True).over(earlier) for c in known}
        )
    out = running(
        df,
        keys,
        bin,
        order,
        lasts={PREVIOUS.format(c): F.struct(F.col(c).alias("v")) for c in previous} | {KNOWN.format(c): F.col(c) for c in known},
        inclusive=False,
    )
    return out.withColumns({PREVIOUS.format(c): F.col(PREVIOUS.format(c))["v"] for c in previous})


def aggregate_chunks(
    rows: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Aggregate],
    fps: float,
    order: Sequence[str] = ("t_ns",),
    bin: Column | None = None,
    poison_empty: bool = True,
) -> DataFrame:
    """One row per chunk with every aggregate, in one grouping pass.

    Several columns pool as the mean of their results weighted by their counts of
    values. ``poison_empty`` keeps the rule that an all-missing column makes the
    pooled result missing (0 times missing is missing) for the functions that
    have no result on empty input; switch it off to skip such columns.
    """
    prepared = with_neighbours(rows, keys, order, aggregates, bin)
    parts: dict[str, Column] = {}
    outputs: list[Column] = []
    for a in aggregates:
        build = aggregate_builder(a.function)
        values, weights = [], []
        for name in a.columns:
            x = F.col(name)
            p = F.col(PREVIOUS.format(name)) if a.function in NEEDS_PREVIOUS else F.lit(None)
            k = F.col(KNOWN.format(name)) if a.function in NEEDS_KNOWN else F.lit(None)
            value, weight = f"__v_{a.function}_{name}", f"__w_{name}"
            parts.setdefault(value, build(x, p, k, float(fps)).alias(value))
            parts.setdefault(weight, F.count(x).alias(weight))
            values.append(value)
            weights.append(weight)
        if len(values) == 1:
            result = F.when(F.col(weights[0]) > 0, F.col(values[0]))
        else:
            keep_gap = poison_empty and a.function not in ZERO_WHEN_EMPTY
            terms = [
                F.col(w) * F.col(v) if keep_gap else F.when(F.col(w) > 0, F.col(w) * F.col(v)).otherwise(F.lit(0.0))
                for v, w in zip(values, weights)
            ]
            total = sum(terms[1:], terms[0])
            weight = sum((F.col(w) for w in weights[1:]), F.col(weights[0]))
            result = F.try_divide(total, weight)
        outputs.append(result.alias(a.output))
    return prepared.groupBy(*keys).agg(*parts.values()).select(*keys, *outputs)


NORMALISERS: dict[str, Callable[[str], list[str]]] = {
    "population": lambda subject: [],
    "subject": lambda subject: [subject],
    "none": lambda subject: [],
}


def normaliser_keys(method: str, subject: str) -> list[str]:
    if method not in NORMALISERS:
        raise ValueError(f"unknown normalisation method {method!r}")
    return NORMALISERS[method](subject)


def fit_normaliser(df: DataFrame, columns: Sequence[str], method: str, subject: str = "participant_name") -> DataFrame:
    """Mean and sample deviation per column, over everyone or per subject."""
    stats = [e for c in columns for e in (F.avg(c).alias(f"{c}__mu"), F.stddev_samp(c).alias(f"{c}__sd"))]
    return df.groupBy(*normaliser_keys(method, subject)).agg(*stats)


def apply_normaliser(
    df: DataFrame, stats: DataFrame, columns: Sequence[str], method: str, subject: str = "participant_name"
) -> DataFrame:
    """z-scores; a deviation of 0 (or a single value) gives NULL."""
    if method == "none":
        return df
    keys = normaliser_keys(method, subject)
    if keys:
        joined = join_few(df, stats, keys, "left", hash_bin(columns))
        fields = {f"{c}__{s}": F.col(f"{c}__{s}") for c in columns for s in ("mu", "sd")}
    else:  # one row of statistics: a scalar subquery
        joined = df.withColumn("__stats", stats.select(F.struct("*")).scalar())
        fields = {f"{c}__{s}": F.col(f"__stats.{c}__{s}") for c in columns for s in ("mu", "sd")}
    scored = {c: F.try_divide(F.col(c) - fields[f"{c}__mu"], fields[f"{c}__sd"]) for c in columns}
    return joined.withColumns(scored).drop("__stats", *fields)


def z_scores(
    df: DataFrame, columns: Sequence[str], method: str, subject: str = "participant_name", train: Column | None = None
) -> DataFrame:
    """z-scores by the table's own statistics: of everyone (of the rows that ``train`` marks), or of each subject."""
    if method == "none":
        return df
    known = df.where(train) if train is not None and method == "population" else df
    return apply_normaliser(df, fit_normaliser(known, columns, method, subject), columns, method, subject)


def normalise_split(
    train: DataFrame, other: DataFrame, columns: Sequence[str], method: str, subject: str = "participant_name"
) -> tuple[DataFrame, DataFrame]:
    """Fit on train; population statistics carry over, subjects unseen in train get their own."""
    stats = fit_normaliser(train, columns, method, subject)
    scored_train = apply_normaliser(train, stats, columns, method, subject)
    if method == "subject":
        unseen = join_few(other, stats, [subject], "left_anti", hash_bin(columns))
        stats = stats.unionByName(fit_normaliser(unseen, columns, method, subject))
    return scored_train, apply_normaliser(other, stats, columns, method, subject)


def participant_means(df: DataFrame, columns: Sequence[str], participant: str = "participant_name") -> DataFrame:
    return df.groupBy(participant).agg(*[F.avg(c).alias(c) for c in columns])


def on_chunks(chunks: DataFrame, tables: Iterable[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Every chunk with the aggregates of every table; a chunk without rows in a table has NULLs there."""
    out = chunks
    for table in tables:
        out = out.join(table, list(keys), "left")
    return out


def combine_sources(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Aggregates of several sources side by side; a source without the chunk leaves NULLs."""
    frames = list(tables.values())
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, list(keys), "full")
    return out


