"""Joins of many rows with few per-key fields that survive a key holding a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to.
SALTS = 32


def hash_bin(columns: Sequence[str | Column], bins: int = 1024) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bins).cast("long"))


def join_few(big: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner", bin: Column | None = None) -> DataFrame:
    """Join on ``keys`` where ``few`` has at most one row per key; ``big`` is read and moved once.

    Without ``bin`` it is a plain join: Spark broadcasts a small ``few`` and splits a hot key while
    running. Give a ``bin`` (a time slot, say) where a later grouping holds the keys and more: it would
    take the rows of a plain join as clustered already and leave a hot key in one task. The rows
    are then dealt to ``SALTS`` parts by a hash of their bin, and every row of ``few`` stands once in
    each part. ``how`` is inner, left, left_semi or left_anti; a NULL key matches nothing, as in any join.
    """
    keys = list(keys)
    if how in ("left_semi", "left_anti"):
        few = few.select(*keys)
    if bin is None:
        return big.join(few, keys, how)
    part = F.pmod(F.xxhash64(bin), F.lit(SALTS).cast("long")).cast("int")
    listed = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__part", part).join(listed, [*keys, "__part"], how).drop("__part")
