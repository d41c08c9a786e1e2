"""Ordered computations that never put a whole key into one task.

A recording, a fold or a score list may hold a third of all rows, so a plain
``Window.partitionBy(key)`` would make one task sort that third. Every helper
here takes a *bin*: a column that does not decrease along the order (a time
slot, a slice of the score range). The rows are windowed per (key, bin); what
the earlier bins contribute is computed on a table with one row per (key, bin),
built with map-side partial aggregation, and joined back. Results are the same
as those of the plain window, to the last row.

A NULL key is a key like any other and a NULL bin comes first, as in plain windows: rows and
per-bin results meet on the struct of keys and bin, whose NULL fields are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driverscope.session import settle


def time_bin(time: str | Column, width: int) -> Column:
    """Slot number of an integer time. Frame rates bound the rows of one slot."""
    c = F.col(time) if isinstance(time, str) else time
    return F.floor(c / F.lit(width)).cast("long")


def score_bin(score: str | Column, bins: int = 4096, low: float = 0.0, high: float = 1.0, steps: int = 128) -> Column:
    """Slice of a score range, non-decreasing in the score.

    Classifiers crowd their scores at both ends, so the slices are even in the score and, added to
    that, in its log-odds. Values outside the range fall in the end slices,
    NULL has none.
    """
    c = F.col(score) if isinstance(score, str) else score
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.lit(low)) / F.lit(high - low)))
    odds = F.log(x + F.lit(1e-15)) - F.log(F.lit(1.0) - x + F.lit(1e-15))
    return F.when(c.isNotNull(), F.floor(x * F.lit(float(bins)) + odds * F.lit(float(steps))).cast("long"))


def magnitude_bin(value: str | Column, steps: int = 64) -> Column:
    """Logarithmic slice of an unbounded value, non-decreasing in the value."""
    c = F.col(value) if isinstance(value, str) else value
    size = F.floor(F.log1p(F.abs(c)) * F.lit(steps)).cast("long")
    return F.when(c < 0, -size).otherwise(size)


#: Splitters per level of ``data_bins``: their square is the number of bins of a key.
SPLITTERS = 16


def data_bins(df: DataFrame, keys: Sequence[str], value: str, source: DataFrame | None = None, out: str = "__slice") -> DataFrame:
    """All columns and ``out``: the value's slice of its key's own values, non-decreasing in the value.

    The slices are cut at the key's quantiles, from a mergeable sketch over ``source`` (the rows themselves unless
    given), so they are about evenly filled whatever range the values lie in, and equal values share one. NULL and NaN values and NULL keys have
    slices too. The quantiles, one row per key, are written: both readers of the bins must see the same.
    """
    source = df if source is None else source
    of = F.struct(*keys) if keys else F.lit(0)
    steps = SPLITTERS * SPLITTERS
    quantiles = F.percentile_approx(value, [i / steps for i in range(1, steps)], 4 * steps)
    cuts = settle(source.where(F.col(value).isNotNull()).groupBy(of.alias("__of")).agg(quantiles.alias("__cuts")))
    # two short searches: among every 16th cut, then among the 15 that follow it
    heads = F.transform(F.sequence(F.lit(1), F.lit(SPLITTERS - 1)), lambda i: F.element_at("__cuts", i * SPLITTERS))
    tails = F.transform(F.sequence(F.lit(0), F.lit(SPLITTERS - 1)), lambda i: F.slice("__cuts", i * SPLITTERS + 1, SPLITTERS - 1))
    cuts = cuts.select("__of", heads.alias("__heads"), tails.alias("__tails"))
    below = lambda cut: F.size(F.filter(cut, lambda x: x <= F.col(value)))
    joined = df.withColumn("__of", of).join(cuts, "__of", "left").withColumn("__head", below("__heads"))
    inner = below(F.element_at("__tails", F.col("__head") + 1))
    place = F.when(F.col(value).isNotNull(), F.coalesce(F.col("__head") * SPLITTERS + inner, F.lit(0)).cast("long"))
    return joined.select(*df.columns, place.alias(out))


def cell(keys: Sequence[str]) -> Column:
    """Key and bin as one value that is never NULL."""
    return F.struct(*keys, "__bin").alias("__cell")


def running(
    df: DataFrame,
    keys: Sequence[str],
    bin: Column,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    descending: bool = False,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums and last non-NULL values along ``order`` within ``keys``; ``totals`` are sums over the whole key.

    The input is read twice (rows, and the per-bin table), so chained calls multiply: take
    several results from one call, and ``settle`` a small intermediate table before the next.

    ``sums`` start at 0; ``lasts`` are NULL until the first non-NULL value.
    ``inclusive=False`` looks strictly before the current row. ``order`` must be
    a total order within the key, or the result among ties is arbitrary.
    """
    sums, lasts, totals, keys, order = dict(sums or {}), dict(lasts or {}), dict(totals or {}), list(keys), list(order)
    work = df.select(
        "*",
        bin.alias("__bin"),
        *[F.coalesce(e, F.lit(0)).alias(f"__s_{n}") for n, e in sums.items()],
        *[e.alias(f"__l_{n}") for n, e in lasts.items()],
        *[e.alias(f"__t_{n}") for n, e in totals.items()],
    )
    ordering = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    bin_ordering = F.col("__bin").desc() if descending else F.col("__bin").asc()
    final = F.min_by if descending else F.max_by
    position = F.struct(*[F.col(o) for o in order])

    slots = work.groupBy(*keys, "__bin").agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums],
        *[
            final(F.col(f"__l_{n}"), F.when(F.col(f"__l_{n}").isNotNull(), position)).alias(f"__l_{n}")
            for n in lasts
        ],
        *[F.sum(f"__t_{n}").alias(f"__t_{n}") for n in totals],
    )
    whole = Window.partitionBy(*keys)
    before = Window.partitionBy(*keys).orderBy(bin_ordering).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(
        cell(keys),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__cs_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__cl_{n}") for n in lasts],
        *[F.sum(f"__t_{n}").over(whole).alias(n) for n in totals],
    )
    frame = (
        Window.partitionBy("__cell")
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    inside = work.withColumn("__cell", cell(keys)).select(
        *df.columns,
        "__cell",
        *[F.coalesce(F.sum(f"__s_{n}").over(frame), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(frame).alias(f"__l_{n}") for n in lasts],
    )
    return inside.join(carried, "__cell").select(
        *df.columns,
        *[(F.col(f"__s_{n}") + F.col(f"__cs_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__l_{n}"), F.col(f"__cl_{n}")).alias(n) for n in lasts],
        *totals,
    )


def row_index(
    df: DataFrame, keys: Sequence[str], bin: Column, order: Sequence[str], out: str = "row_index", length: str | None = None
) -> DataFrame:
    """Zero-based position along ``order``, and the number of rows of the key as ``length`` if named."""
    one = F.lit(1).cast("long")
    return running(df, keys, bin, order, sums={out: one}, inclusive=False, totals={length: one} if length else None)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    bin: Column,
    order: Sequence[str],
    values: Mapping[str, Column],
    following: bool = False,
) -> DataFrame:
    """Value of the previous (or following) row, NULL at the edge: ``lag`` and ``lead``."""
    boxed = running(
        df,
        keys,
        bin,
        order,
        lasts={n: F.struct(e.alias("v")) for n, e in values.items()},
        inclusive=False,
        descending=following,
    )
    return boxed.withColumns({n: F.col(n)["v"] for n in values})


def halo(
    df: DataFrame,
    position: Column,
    size: int,
    look_back: int = 0,
    look_ahead: int = 0,
    segment: str = "segment",
    own: str = "is_own",
) -> DataFrame:
    """Cut an integer axis into segments of ``size`` and copy border rows to the neighbours that need them.

    A row whose result needs rows from ``position - look_back`` to
    ``position + look_ahead`` finds them all in its own segment afterwards; drop the
    copies with ``is_own`` after the window. The copied share is
    ``(look_back + look_ahead) / size``.
    """
    first = F.floor((position - F.lit(look_ahead)) / F.lit(size)).cast("long")
    last = F.floor((position + F.lit(look_back)) / F.lit(size)).cast("long")
    home = F.floor(position / F.lit(size)).cast("long")
    return df.select("*", home.alias("__home"), F.explode(F.sequence(first, last)).alias(segment)).select(
        *df.columns, segment, (F.col(segment) == F.col("__home")).alias(own)
    )


def around(df: DataFrame, keys: Sequence[str], bin: Column, order: Sequence[str], values: Sequence[str], previous: str = "previous", following: str = "following") -> DataFrame:
    """Structs with the values of the row before and the row after, NULL at the edges, in one pass."""
    keys, order = list(keys), list(order)
    position = F.struct(*[F.col(o) for o in order])
    work = df.select("*", bin.alias("__bin"), F.struct(*values).alias("__v"))
    slots = work.groupBy(*keys, "__bin").agg(F.min_by("__v", position).alias("__first"), F.max_by("__v", position).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__bin")
    carried = slots.select(cell(keys), F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after"))
    w = Window.partitionBy("__cell").orderBy(*order)
    inside = work.withColumn("__cell", cell(keys)).select(*df.columns, "__cell", F.lag("__v").over(w).alias("__p"), F.lead("__v").over(w).alias("__n"))
    return inside.join(carried, "__cell").select(
        *df.columns, F.coalesce("__p", "__before").alias(previous), F.coalesce("__n", "__after").alias(following)
    )


def step_islands(
    df: DataFrame,
    keys: Sequence[str],
    bin: Column,
    order: Sequence[str],
    values: Sequence[str],
    starts: Callable[[Column, Column], Column],
    out: str = "island",
    previous: str | None = None,
) -> DataFrame:
    """Number the runs that begin where ``starts(current, previous)`` is true, from structs of ``values``.

    The first row of a key begins its first run. Neighbours and numbers come from one pass: only the first
    row of a bin needs the bin before, and that is decided on the per-bin table.
    """
    keys, order = list(keys), list(order)
    position = F.struct(*[F.col(o) for o in order])
    w = Window.partitionBy("__cell").orderBy(*order)

    def flag(current: Column, before: Column) -> Column:
        return F.coalesce(starts(current, before), F.lit(False)).cast("long")

    work = df.select("*", bin.alias("__bin"), F.struct(*values).alias("__v")).withColumn("__cell", cell(keys)).withColumn("__p", F.lag("__v").over(w))
    inner = F.when(F.col("__p").isNotNull(), flag(F.col("__v"), F.col("__p"))).otherwise(F.lit(0).cast("long"))
    slots = work.groupBy(*keys, "__bin").agg(
        F.sum(inner).alias("__inner"), F.min_by("__v", position).alias("__first"), F.max_by("__v", position).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy("__bin")
    linked = slots.withColumn("__before", F.lag("__last").over(across))
    linked = linked.withColumn("__opens", F.when(F.col("__before").isNull(), F.lit(1).cast("long")).otherwise(flag(F.col("__first"), F.col("__before"))))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = linked.select(
        cell(keys), "__before", (F.coalesce(F.sum(F.col("__inner") + F.col("__opens")).over(earlier), F.lit(0)) + F.col("__opens")).alias("__offset")
    )
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = work.select(*df.columns, "__cell", "__p", F.sum(inner).over(upto).alias("__inside"))
    found = inside.join(carried, "__cell")
    extra = [F.coalesce("__p", "__before").alias(previous)] if previous else []
    return found.select(*df.columns, (F.col("__inside") + F.col("__offset")).alias(out), *extra)


def islands(
    df: DataFrame, keys: Sequence[str], bin: Column, order: Sequence[str], starts: Column, out: str = "island"
) -> DataFrame:
    """Number the runs that begin wherever ``starts`` is true."""
    flagged = F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return running(df, keys, bin, order, sums={out: flagged})


def median(df: DataFrame, keys: Sequence[str], value: str, bin: Column, out: str = "median") -> DataFrame:
    """Exact median per key (mean of the middle two) from counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, keys, bin, [value], sums={"__upto": F.col("__n")}, totals={"__total": F.col("__n")})
    first, second = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)

    def at(position: Column) -> Column:
        covers = (position >= F.col("__upto") - F.col("__n")) & (position < F.col("__upto"))
        return F.max(F.when(covers, F.col(value)))

    return upto.groupBy(*keys).agg(((at(first) + at(second)) / 2).alias(out))
