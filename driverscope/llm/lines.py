"""Line removal by the spread of a line over distinct sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, stored


def split_lines(text: str | Column = "text") -> Column:
    """Lines between line feeds; null text is one empty line."""
    return F.split(body(text), "\n")


def line_key(line: Column) -> Column:
    """Lines are the same when equal but for blanks at their ends."""
    return F.xxhash64(F.trim(line))


def line_spread(docs: DataFrame, sites: int, site: str = "source", precision: int = 12, margin: float = 0.25) -> DataFrame:
    """(line_hash, n_sites) of lines on at least ``sites`` distinct sites.

    HyperLogLog sketches per line hash merge by aggregation, within tasks first, so a common line
    costs one small sketch per task. Lines whose estimate is within ``margin`` of the threshold get
    exact distinct counts; beyond it the estimate stands. Sketches of a few sites are exact up to
    hash collisions, and the margin is over ten times the sketch's relative standard error.
    Blank lines and rows without a site have no part.
    """
    lines = docs.filter(F.col(site).isNotNull()).select(F.col(site).cast("string").alias("site"), F.explode(split_lines()).alias("line"))
    lines = lines.filter(F.length(F.trim("line")) > 0).select("site", line_key(F.col("line")).alias("line_hash"))
    sketched = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", precision)).alias("estimate"))
    sketched = stored(sketched.filter(F.col("estimate") >= sites * (1 - margin)), "line-spread")
    near = sketched.filter(F.col("estimate") < sites * (1 + margin)).select(F.col("line_hash").alias("_near"))
    exact = lines.join(near, F.col("line_hash") == F.col("_near"), "left_semi").groupBy("line_hash").agg(F.count_distinct("site").alias("n_sites"))
    sure = sketched.filter(F.col("estimate") >= sites * (1 + margin)).select("line_hash", F.col("estimate").alias("n_sites"))
    return sure.unionByName(exact.filter(F.col("n_sites") >= sites))


def boilerplate_places(docs: DataFrame, sites: int, site: str = "source") -> DataFrame:
    """(doc_id, text_hash, places): the 0-based numbers of each document's boilerplate lines."""
    spread = stored(line_spread(docs, sites, site).select(F.col("line_hash").alias("_hash")), "line-boilerplate")
    rows = docs.select("doc_id", F.xxhash64(body()).alias("text_hash"), split_lines().alias("lines"))
    lines = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("place", "line")).filter(F.length(F.trim("line")) > 0)
    hits = lines.select("doc_id", "text_hash", "place", line_key(F.col("line")).alias("line_hash")).join(spread, F.col("line_hash") == F.col("_hash"), "left_semi")
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def remove_boilerplate(docs: DataFrame, sites: int = 10, site: str = "source") -> DataFrame:
    """The documents without lines that stand on ``sites`` or more sites; adds n_lines and n_removed.

    All rows and columns stay; only text changes (null stays null), and n_chars if there is one. A
    document may lose all its lines; its text is then empty. Documents without a site lose such lines
    too but do not count towards the spread. Repeated rows are treated alike. Blank lines stay.
    """
    places = boilerplate_places(docs, sites, site).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    held = docs.select(F.struct("*").alias("_doc"))
    match = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(body("_doc.text")) == F.col("_hash"))
    rows = held.join(places, match, "left").withColumn("_lines", split_lines("_doc.text"))
    kept = F.array_join(F.filter("_lines", lambda _, i: ~F.array_contains(F.col("places"), i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("_doc.text")).otherwise(kept)
    rows = rows.select("_doc", text.alias("_text"), F.size("_lines").alias("_n_lines"), F.coalesce(F.size("places"), F.lit(0)).alias("_n_removed"))
    columns = [F.col("_text").alias(c) if c == "text" else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*columns, F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"))
