"""The pipeline's stages on the smallest tables, and its result against a plain version of its steps."""

import collections

import corpus_pipeline
from tokenizers import Tokenizer

from driverscope.llm.common import stored, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER), "test-stage")
        left[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = collections.Counter()
    for r in before.collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for p in docs.collect():
        got[p.doc_id] += p.length
    assert got == want
    assert left["toxicity"] < 200 and left["line dedup"] == left["toxicity"] and left["n-gram Jaccard join"] < left["line dedup"]


def test_stages_take_odd_and_empty_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
        stage(spark, odd, FOLDER).collect()
