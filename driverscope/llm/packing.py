"""Packing by lexical retrieval: an inverted BM25 index per shard fills each seed's window with its neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, body, chunk_tokens, slices, stored, tokenizer_file

PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class InvertedIndex:
    """Postings of one shard: term -> documents with their BM25 weights. Terms are token ids."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float, k1: float = 1.2, b: float = 0.75) -> None:
        terms, owners, counts = [], [], []
        for k, ids in enumerate(documents):
            own, n = np.unique(ids, return_counts=True)
            terms.append(own)
            owners.append(np.full(len(own), k))
            counts.append(n)
        self.own, self.size = terms, len(documents)
        term = np.concatenate(terms) if terms else np.empty(0, int)
        order = np.argsort(term, kind="stable")
        lengths = np.array([len(d) for d in documents], float)
        tf = np.concatenate(counts).astype(float)[order] if terms else np.empty(0)
        self.docs = np.concatenate(owners)[order] if terms else np.empty(0, int)
        term = term[order]
        norm = k1 * (1 - b + b * lengths[self.docs] / max(mean_length, 1.0))
        self.weights = idf[term] * tf * (k1 + 1) / (tf + norm)
        self.starts = np.searchsorted(term, np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's distinct terms."""
        first = self.starts[self.own[seed]]
        length = self.starts[self.own[seed] + 1] - first
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        return np.bincount(self.docs[at], self.weights[at], self.size)


def by_score(scores: np.ndarray, first: int = 64) -> Iterator[int]:
    """Documents by falling score, ties in their order; only as many are sorted as are asked for."""
    size, done = first, 0
    while done < len(scores):
        if size >= len(scores):
            order = np.argsort(-scores, kind="stable")
        else:
            # all that are as good as the one at place ``size``, so that ties stay in order
            least = np.partition(scores, len(scores) - size)[len(scores) - size]
            best = np.flatnonzero(scores >= least)
            order = best[np.argsort(-scores[best], kind="stable")]
        yield from order[done:].tolist()
        done, size = len(order), 4 * size


def fill(lengths: list[int], scores, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard.

    A window begins with what is left of the last cut document, or with the next unused one: its
    seed. Unused neighbours follow in the order of their score, ties in shard order; the one that
    does not fit is cut, and its rest seeds the next window. So only the last window has room left.
    """
    pieces, used, following, sequence = [], [False] * len(lengths), 0, 0
    doc, start = -1, 0
    while True:
        if doc < 0:
            while following < len(lengths) and used[following]:
                following += 1
            if following == len(lengths):
                return pieces
            doc, start = following, 0
            used[doc] = True
        seed, offset, near = doc, 0, None
        while doc >= 0:
            length = min(window - offset, lengths[doc] - start)
            pieces.append((doc, start, length, sequence, offset))
            offset, start = offset + length, start + length
            if start < lengths[doc]:
                break
            doc, start = -1, 0
            if offset < window:
                if near is None:
                    near = by_score(scores(seed))
                doc = next((k for k in near if not used[k]), -1)
                if doc >= 0:
                    used[doc] = True
        sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, shard_tokens: int = 400_000, cache_bytes: int = 128 << 20) -> DataFrame:
    """Cut and pack the ids of all documents into sequences of at most ``window`` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null texts are empty and hold the end id alone; a null doc_id stays null. Repeated rows are packed
    as often as they occur. Only doc_id and text are read. An empty table gives no pieces.

    Ids are written once. Document frequencies of all documents are summed per token id, so that
    table is bounded by the vocabulary. Shards of about ``shard_tokens`` ids are dealt by a hash of
    the document's id and content and a row number, so no id, source or group of copies can crowd one.
    ``cache_bytes`` bounds each worker's cache of encoded chunks; less memory costs time, the result is the same.
    """
    tokenizer = tokenizer or tokenizer_file()
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary())])

    def encode(batches):
        """Ids of every text; some rows carry the document counts per term of the rows since the last such row."""
        cache, end = chunk_tokens(tokenizer, kind, cache_bytes), np.array([end_id], kind).tobytes()
        for batch in batches:
            count = np.zeros(vocabulary, np.uint32)
            ids = [cache.ids(text.as_py()) + end for text in batch.column(1)]
            for one in ids:
                count[np.unique(np.frombuffer(one, kind))] += 1
            seen = np.flatnonzero(count).astype(np.uint32)
            told = np.concatenate([seen, count[seen]]).astype("<u4").tobytes()
            yield [batch.column(0), [len(x) // len(end) for x in ids], ids, [None] * (len(ids) - 1) + [told] * bool(ids)]

    rows = docs.select("doc_id", body().alias("text")).mapInArrow(arrow_rows(encode, schema), "doc_id long, doc_tokens long, ids binary, terms binary")
    tokens = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pack-tokens")

    def present(batches):
        count = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for told in batch.column(0):
                seen, n = np.frombuffer(told.as_py(), "<u4").reshape(2, -1)
                count[seen] += n
        seen = np.flatnonzero(count)
        yield [seen, count[seen]]

    told = tokens.select("terms").filter(F.col("terms").isNotNull())
    terms = told.mapInArrow(arrow_rows(present, pa.schema([("term", pa.int32()), ("n", pa.int64())])), "term int, n long")
    frequency = np.zeros(vocabulary)
    for row in terms.groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most one row per vocabulary entry
        frequency[row.term] = row.n
    size = tokens.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("doc_tokens"), F.lit(0)).alias("ids")).first()
    idf = np.log1p((size.docs - frequency + 0.5) / (frequency + 0.5)).astype("f4")
    mean_length = size.ids / max(size.docs, 1)

    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), kind) for x in rows["ids"]]
        index = InvertedIndex(ids, idf.astype(float), mean_length)
        number = rows["shard"][0].as_py()
        found = fill([len(x) for x in ids], index.scores, window)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*found))
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, *_ in found]
        whole = np.array([len(x) for x in ids], np.int64)[doc]
        names = rows["doc_id"].combine_chunks().take(pa.array(doc))
        return pa.table([names, start, length, pa.array(crc, pa.int64()), whole, (number << 32) | sequence, offset], schema=out)

    shards = slices(size.ids, shard_tokens)
    dealt = tokens.select("doc_id", "row", "ids", F.pmod(F.xxhash64("doc_id", F.length("ids"), "row"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(shard, PIECE_DDL)
