"""The registered queries of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from driverscope.session import scratch_path

from . import blocks, exact, hard_negatives, jaccard, licences, lines, mixing, neighbours, packing, pieces, quality, resampling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query()
def op3_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_path(spark, "token-blocks")
    blocks.write_tokens(table(spark, folder, "documents"), files)
    return blocks.read_tokens(spark, files)


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY t)
    """
)
def op4_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_copies(table(spark, folder, "documents"))


@query(
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w
    ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
    ), pairs AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
    ), reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
    ), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x
    ), links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
    SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(least.y, s.doc_id)) AS component_id,
           coalesce(links.n, 0) AS n_links
    FROM s LEFT JOIN least ON least.x = s.doc_id LEFT JOIN links ON links.x = s.doc_id
    """
)
def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, folder, "documents"), width=4, threshold=0.85)


@query()
def op10_pack_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.severity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    """
    WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    k AS (SELECT doc_id, source, trim(line, ' ') AS line FROM l),
    spread AS (SELECT line FROM k WHERE length(line) > 0 GROUP BY line HAVING count(DISTINCT source) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(spread.line) AS n_removed FROM k LEFT JOIN spread USING (line) GROUP BY doc_id
    """
)
def op8_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed")


@query()
def op5_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query()
def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files below their source and language: source/lang/doc_id."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = licences.scan(docs.select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.expr("try_cast(element_at(split(path, '/'), -1) AS long)"))


@query(
    r"""
    WITH crc_table AS (
      SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), texts AS (SELECT 'raw' AS side, doc_id, text FROM documents UNION ALL SELECT 'target', NULL, text FROM benchmark
    ), worded AS (
      SELECT row_number() OVER () AS r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
    ), f AS (
      SELECT r, side, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM worded
    ), hexed AS (SELECT DISTINCT f, hex(f) AS h FROM f
    ), bytes AS (
      SELECT f, list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT)) AS b FROM hexed
    ), hashed AS (
      SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table
    ), placed AS (SELECT r, side, bucket FROM f JOIN hashed USING (f)
    ), sums AS (SELECT count(*) FILTER (side = 'raw') AS big_s, count(*) FILTER (side = 'target') AS big_t FROM placed
    ), per AS (SELECT bucket, count(*) FILTER (side = 'raw') AS s, count(*) FILTER (side = 'target') AS t FROM placed GROUP BY bucket
    ), gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (big_s + 10000))::DOUBLE / ((s + 1) * (big_t + 10000))::DOUBLE))::BIGINT AS g FROM per, sums
    ), weighed AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'raw' GROUP BY r
    ), scored AS (
      SELECT doc_id, len(w) >= 20 AS enough, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM worded LEFT JOIN weighed USING (r) WHERE side = 'raw'
    ), placed_docs AS (
      SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST) AS place, floor(count(*) FILTER (enough) OVER () * 25 / 100) AS drawn FROM scored
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= drawn THEN place END AS rank FROM placed_docs
    """
)
def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    """
    WITH v AS (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
    ), p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
    """
)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


@query()
def op13_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
