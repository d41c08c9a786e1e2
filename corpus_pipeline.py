"""A training corpus from raw documents: drop toxic ones, strip boilerplate, keep one of each group of
near copies, mix sources to weights, pack into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each result and goes on from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driverscope.llm import jaccard, lines, mixing, packing, toxicity
from driverscope.llm.common import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels of the given table teach the model."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on ten or more sources go; every document stays."""
    return lines.remove_boilerplate(docs).select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at 0.8 stays, the smallest doc_id."""
    return jaccard.one_per_group(docs, width=5, threshold=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out, so that sources meet their weights."""
    return mixing.take(docs, mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids.

    Workers stay after this stage beside heaps that earlier stages have grown, so their caches are kept small.
    """
    return packing.pack_documents(docs, cache_bytes=48 << 20)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: A model and a tokenizer stand between the documents and the result; see the brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
