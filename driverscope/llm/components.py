"""Connected components of a table of links, by alternating star operations on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(u, v) -> (node, component): the smallest node reachable. Only nodes with links appear.

    Large stars hang the larger neighbours of a node on its smallest one, small stars the smaller
    ones; the number of rounds is logarithmic in the longest chain. Each round is written, so a lost
    executor costs one round at most. A node of many links is grouped by its minimum alone (partial
    sums in the tasks), then joined, which the engine splits when skewed.
    """
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("_k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("_k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("_k"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("_k").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        following = stored(small, "cc")
        same = [d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() for d in (edges, following)]
        edges = following
        if same[0] == same[1]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
