"""Mix sources to target weights by Pareto order sampling, in whole documents and whole copies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, body, ranked, stored, uniform


def word_count(text: str = "text") -> Column:
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources in code-point order, null last, weigh 1 to ``cycle``, repeating. They share all words by
    weight; targets stop at ``most`` times their source's size, the excess reshared by weight until
    none is above. Every round is one sum over the sources' table.
    """
    rank = ranked(sizes, [F.col("source").isNull(), F.col("source")], "mix-sources")
    weighed = rank.select("source", "source_size", (F.col("rank") % cycle + 1).alias("weight"))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    share = 0.0
    while True:
        over = F.col("weight") * share > most * F.col("source_size")
        now = weighed.agg(F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w")).first()
        # all sources full: nothing is left to share out
        following = (total - now.full) / now.w if now.w else share
        if following <= share:
            break
        share = following
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), (most * F.col("source_size")).cast("double")))


def expected_copies(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``copies``: how often each row is taken on average, at most ``most`` times.

    Rows of a source share its target in proportion to their importance class (a small number of
    classes): copies = min(most, c * importance), with c such that the expected words meet the target.
    Solved per source on one row per class.
    """
    classes = rows.groupBy("source", "importance").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    by = W.partitionBy("source").orderBy(F.col("importance").desc())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    # classes above are full; c follows from the words left for this class and those below
    left = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    scale = F.try_divide(left, F.sum(F.col("words") * F.col("importance")).over(after))
    solved = classes.withColumn("scale", scale).withColumn("fits", F.coalesce(F.col("scale") * F.col("importance") <= most * (1 + 1e-12), F.lit(False)))
    chosen = solved.withColumn("c", F.max(F.when(F.col("fits"), F.struct("importance", "scale"))).over(W.partitionBy("source")))
    copies = F.when(F.col("importance") <= F.col("c.importance"), F.least(F.lit(float(most)), F.col("c.scale") * F.col("importance"))).otherwise(float(most))
    table = chosen.select(F.col("source").alias("_s"), F.col("importance").alias("_i"), F.greatest(copies, F.lit(0.0)).alias("copies"))
    return rows.join(table, rows["source"].eqNullSafe(table["_s"]) & (rows["importance"] == table["_i"])).drop("_s", "_i")


def fill_rounds(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """How each source's gap is filled, one row per source and round: first, last, left, start, after.

    A round goes on from slice ``first`` with ``left`` words missing and sees only rows that fit them. They
    are all taken up to slice ``last``, the first to overflow; that one is gone through row by row, with
    ``start`` words missing before and ``after`` behind it. The next round goes on from the slice
    after it. A round without ``last`` takes every row left that fits.
    """
    drawn = rows.filter("slice IS NOT NULL").select("source", "slice", "order", "doc_id", "_text", "_row", "size")
    state, rounds = gaps.select(F.col("source").alias("_s"), F.col("gap").cast("double").alias("left"), F.lit(-(1 << 62)).alias("first")), []
    by_slice = W.partitionBy("_s").orderBy("slice")
    schema = "_s string, after double"

    def rest(part: pa.Table) -> pa.Table:
        left = fit(part)[1]
        return pa.table([part["source"].slice(0, 1), pa.array([left], pa.float64())], names=["_s", "after"])

    while True:
        fits = drawn.join(state, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") >= F.col("first")) & (F.col("size") <= F.col("left")))
        sums = fits.groupBy("_s", "slice").agg(F.sum("size").alias("words"), F.first("left").alias("missing"))
        sums = sums.withColumn("through", F.sum("words").over(by_slice))
        over = F.when(F.col("through") > F.col("missing"), F.struct("slice", (F.col("through") - F.col("words")).alias("before")))
        found = sums.groupBy(F.col("_s").alias("_o")).agg(F.min(over).alias("over"), F.sum("words").alias("words"))
        found = state.join(found, F.col("_s").eqNullSafe(F.col("_o")), "left").drop("_o")
        start = F.col("left") - F.coalesce("over.before", "words", F.lit(0))
        found = stored(found.select("_s", "first", F.col("over.slice").alias("last"), "left", start.alias("start")), "mix-round")
        edge = drawn.join(found, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("last")) & (F.col("size") <= F.col("left"))).drop("_s")
        after = edge.groupBy("source").applyInArrow(rest, schema).withColumnRenamed("_s", "_a")
        done = stored(found.join(after, F.col("_s").eqNullSafe(F.col("_a")), "left").drop("_a").withColumn("after", F.coalesce("after", "start")), "mix-filled")
        rounds.append(done)
        state = done.filter("last IS NOT NULL AND after >= 1").select("_s", F.col("after").alias("left"), (F.col("last") + 1).alias("first"))
        if state.isEmpty():
            break
    out = rounds[0]
    for done in rounds[1:]:
        out = out.unionByName(done)
    return out


def fit(part: pa.Table) -> tuple[pa.Table, float, list[bool]]:
    """A slice in its order, the words still missing behind it, and which rows fitted."""
    part = part.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("_text", "ascending"), ("_row", "ascending")])
    left, taken = part["start"][0].as_py(), []
    for size in part["size"].to_pylist():
        taken.append(size <= left)
        left -= size if taken[-1] else 0
    return part, left, taken


def mix(docs: DataFrame, cycle: int = 3, most: int = 3, seed: str = "mix", slice_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, chosen (times it is taken).

    Size is the number of words, 0 for null texts. Each document is certain of the whole part of its
    expected copies. The words still missing are filled in Pareto order: rows ranked by the odds of a
    hash-drawn number over the odds of their inclusion, from the top whatever still fits, down to the
    last row, and one closing row if it brings the sum nearer. Importance rises with the logarithm of
    the size up to twice, so inclusion probabilities differ within a source. Documents of no words are
    never taken. Repeated rows tie in their rank; it does not matter which of them is taken.
    An empty table gives no rows. Only doc_id, text and source are read.

    The rank is cut into slices of about ``slice_rows`` / 8 rows of a source at most: the logarithm of
    odds has a density of at most 1/4, whatever the chances. Slices count by their sums, and only
    those that overflow are sorted, so a source of a third of all rows is never in one task.
    """
    base = docs.select("doc_id", "source", word_count().alias("size"), F.md5(body()).alias("_text"))
    base = stored(base.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    targets = source_targets(sizes.drop("_n"), cycle, most).select(F.col("source").alias("_source"), "source_size", "target")
    importance = 1.0 + F.least(F.floor(F.log2(F.col("size") + 1.0)), F.lit(16)) / 16.0
    rows = base.join(targets, base["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumn("importance", importance)
    rows = expected_copies(rows, most)
    whole = F.floor("copies").cast("long")
    chance = F.col("copies") - whole
    draw = uniform("doc_id", "_text", salt=seed)
    odds = (draw / (1 - draw)) * F.try_divide(1 - chance, chance)
    rows = rows.withColumn("whole", whole).withColumn("chance", F.when((F.col("size") > 0) & (chance > 1e-12), chance))
    rows = rows.withColumn("order", F.when(F.col("chance").isNotNull(), F.log(odds)))
    width = sizes.select(F.col("source").alias("_w"), F.least(F.lit(1.0), F.lit(slice_rows / 2) / F.col("_n")).alias("width"))
    rows = rows.join(width, F.col("source").eqNullSafe(F.col("_w"))).withColumn("slice", F.floor(F.col("order") / F.col("width"))).drop("_w", "width")
    rows = stored(rows, "mix-order")
    gaps = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("gap"))
    rounds = fill_rounds(rows, gaps)
    plan = rounds.groupBy(F.col("_s").alias("_p")).agg(F.collect_list(F.struct("first", "last", "left", "start")).alias("rounds"), F.min("after").alias("missing"))
    here = F.filter("rounds", lambda r: (F.col("slice") >= r["first"]) & (r["last"].isNull() | (F.col("slice") <= r["last"])))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_p"))).withColumn("round", F.get(here, F.lit(0))).drop("_p", "rounds")
    fits = F.coalesce(F.col("size") <= F.col("round.left"), F.lit(False))
    edge = fits & F.coalesce(F.col("slice") == F.col("round.last"), F.lit(False))
    names = ["doc_id", "source", "size", "source_size", "target", "copies", "whole", "_text", "order", "_row", "missing"]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("in", T.BooleanType())])

    def fill(part: pa.Table) -> pa.Table:
        part, _, taken = fit(part)
        return part.select(names).append_column("in", pa.array(taken, pa.bool_()))

    inside = rows.filter(edge).select(*names, "slice", F.col("round.start").alias("start")).groupBy("source", "slice").applyInArrow(fill, schema)
    drawn = stored(inside.unionByName(rows.filter(~edge).select(*names, fits.alias("in"))), "mix-drawn")
    # one closing row, if it brings the sum nearer
    off = F.abs(F.col("missing") - F.col("size"))
    nearest = F.min(F.struct(off.alias("off"), "order", "doc_id", "_text", "_row"))
    closing = drawn.filter(~F.col("in") & F.col("order").isNotNull() & (off < F.col("missing"))).groupBy("source").agg(nearest.alias("_c")).select(F.col("_c._row").alias("_closing"))
    drawn = drawn.join(closing, F.col("_row") == F.col("_closing"), "left")
    chosen = (F.col("whole") + (F.col("in") | F.col("_closing").isNotNull()).cast("long")).alias("chosen")
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", chosen, F.col("_text").alias("text_hash")).withColumn("taken", F.col("chosen") * F.col("size"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as documents: every row of ``docs`` as often as ``mixed`` chose it, all columns kept."""
    twin = W.partitionBy("_id", "_hash")
    picks = mixed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "chosen").withColumn("_k", F.row_number().over(twin.orderBy(F.desc("chosen"))))
    rows = docs.select(F.struct("*").alias("_doc"), F.md5(body()).alias("_own"))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_doc.doc_id", "_own").orderBy("_own")))
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")) & (F.col("_n") == F.col("_k"))
    return rows.join(picks.filter("chosen > 0"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("chosen")))).select("_doc.*")
