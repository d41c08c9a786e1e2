"""Importance resampling towards a target: hashed n-gram features from overlapped regex scans, log-ratio
weights per feature, and the highest scores after Gumbel noise."""

from __future__ import annotations

import itertools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, body, ranked, stored

#: Matches taken at a time from one text, so that a very long one is never a list of all its matches.
BLOCK = 1 << 16


def separators() -> bytes:
    """Table for ``bytes.translate``: A-Z in lower case, every ASCII byte but digits and letters a blank.
    Bytes from 128 on belong to words, so characters of several bytes stay whole."""
    return bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or 48 <= k <= 57 or 97 <= k <= 122 else 32 for k in range(256))


class NgramScanner:
    """CRC-32 of all runs of 1 to ``width`` consecutive words of a text, repeats included.

    Separators collapse to single blanks. One pattern then matches up to ``width`` words from a word's
    beginning on, told by a lookbehind, with a group per length; ``overlapped`` starts the next
    match one byte later, hence at the next word. The groups' spans are the n-grams, joined by
    one blank as they stand. Near the end of the text longer groups end where shorter ones do and are cut.
    """

    def __init__(self, width: int = 2) -> None:
        word = rb"[^ ]++"
        group = b"(" + word + b")"
        for _ in range(width - 1):
            group = b"(" + group + b"(?: " + word + b")?)"
        self.width, self.table = width, separators()
        self.pattern = regex.compile(rb"(?<![^ ])" + group)
        self.groups = operator.methodcaller("groups")

    def hashes(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, hashes of all features)."""
        data = b" ".join(text.encode().translate(self.table).split())
        found = map(self.groups, self.pattern.finditer(data, overlapped=True))
        parts: list[list[np.ndarray]] = [[] for _ in range(self.width)]
        while block := list(itertools.islice(found, BLOCK)):
            for part, column in zip(parts, zip(*block)):
                part.append(np.fromiter(map(zlib.crc32, column), np.uint32, len(column)))
        words = sum(map(len, parts[0]))
        # groups are numbered from the longest; a run of n words begins at all but the last n - 1 words
        runs = [np.concatenate(p)[: max(0, words - self.width + 1 + k)] for k, p in enumerate(parts) if p]
        return words, np.concatenate(runs) if runs else np.empty(0, np.uint32)


def features(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """doc_id, n_words, found (the buckets of all features as little-endian numbers) of every text."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]):
        scanner = NgramScanner(width)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first in range(0, batch.num_rows, 256):  # texts are long: small results, one after the other
                rows = [scanner.hashes(t.as_py()) for t in texts.slice(first, 256)]
                yield [ids.slice(first, 256), [n for n, _ in rows], [(h % buckets).astype(kind).tobytes() for _, h in rows]]

    rows = docs.select(F.col("doc_id").cast("long"), body().alias("text"))
    return rows.mapInArrow(arrow_rows(scan, schema), "doc_id long, n_words long, found binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all texts: summed per task, then per bucket; at most ``buckets`` rows arrive."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.bincount(np.frombuffer(one.as_py(), kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield [seen, total[seen]]

    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
    rows = found.select("found").mapInArrow(arrow_rows(count, schema), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw texts."""
    buckets = len(raw)
    above = (target + 1).astype(float) * float(raw.sum() + buckets)
    below = (raw + 1).astype(float) * float(target.sum() + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def resample(
    docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, buckets: int = 10_000, width: int = 2, seed: int = 7
) -> DataFrame:
    """Weigh every document by its features' log ratio of target to raw and draw ``share`` percent of the long enough ones.

    Returns one row per row of ``docs``: doc_id, n_features, weight (floored mean of gains, 0 without
    features), score (weight plus Gumbel noise from a digest of the seed and doc_id), rank (from 1 for the
    drawn ones, else null). Highest scores are drawn, ties by smaller doc_id. Null texts have no words; a null doc_id
    counts as the empty string in the digest and comes last among ties; repeated rows are drawn one by
    one. Only doc_id and text are read, and text of ``target``. With an empty target all counts there
    are 0; an empty table gives no rows.

    Texts are scanned once; their buckets are written and read by the counts and the weights. Ranks come
    from a range sort of narrow rows in which equal rows still differ by position, so none crowds a task.
    """
    if not 1 <= buckets <= 1 << 32:
        raise ValueError("buckets must lie between 1 and 2^32")
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    found = stored(features(docs, buckets, width), "resample-features")
    aimed = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, width)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aimed, buckets))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            own = [np.frombuffer(x.as_py(), kind) for x in batch.column(2)]
            yield [batch.column(0), batch.column(1), [len(x) for x in own], [int(gain[x].sum()) // len(x) if len(x) else 0 for x in own]]

    weighed = found.mapInArrow(arrow_rows(weigh, schema), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise).withColumn("enough", F.col("n_words") >= least_words), "resample-scores")
    drawn = scored.agg(F.floor(F.count_if("enough") * share / 100).alias("n")).first().n
    placed = scored.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    rank = F.when(F.col("enough") & (F.col("rank") < drawn), F.col("rank") + 1)
    return ranked(placed, order, "resample-ranks").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
