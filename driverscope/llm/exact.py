"""Exact duplicates by a cuckoo-filter index of live digests, one filter per bucket of digests."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, body, slices


class CuckooIndex:
    """Digests that are live, found by fingerprints in two possible places each.

    ``slots`` holds the fingerprints, ``keys`` the stored digest behind each, against which every
    fingerprint hit is verified. When no place is free after ``kicks`` moves, the table doubles and
    is filled anew from the stored keys. ``live`` counts the rows of a digest; a digest whose last
    row is deleted leaves the filter.
    """

    ways, kicks = 4, 200

    def __init__(self, expected: int = 1024) -> None:
        self.live: dict[bytes, int] = {}
        self._room(max(8, 1 << (max(1, expected) * 10 // (self.ways * 9)).bit_length()))

    def _room(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]
        self.keys: list[list[bytes]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = digest[15] << 8 | digest[14] or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, place: int, print_: int) -> int:
        return place ^ (print_ * 0x5BD1E995 & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        return any(f == print_ and self.keys[p][k] == digest for p in (one, two) for k, f in enumerate(self.slots[p]))

    def insert(self, digest: bytes, rows: int = 1) -> bool:
        """Add rows of a digest; True if it was live before."""
        if digest in self:
            self.live[digest] += rows
            return True
        self.live[digest] = rows
        if not self._put(digest):
            self._grow()
        return False

    def _put(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        for place in (one, two):
            if len(self.slots[place]) < self.ways:
                self.slots[place].append(print_)
                self.keys[place].append(digest)
                return True
        place = two
        for turn in range(self.kicks):
            k = turn % self.ways
            self.slots[place][k], print_ = print_, self.slots[place][k]
            self.keys[place][k], digest = digest, self.keys[place][k]
            place = self._other(place, print_)
            if len(self.slots[place]) < self.ways:
                self.slots[place].append(print_)
                self.keys[place].append(digest)
                return True
        return False

    def _grow(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._room(buckets)
            if all(self._put(digest) for digest in self.live):
                return

    def delete(self, digest: bytes, rows: int = 1) -> bool:
        """Take rows of a digest away; False if it was not live."""
        if digest not in self:
            return False
        self.live[digest] -= rows
        if self.live[digest] <= 0:
            print_, one, two = self._places(digest)
            for place in (one, two):
                if digest in self.keys[place]:
                    k = self.keys[place].index(digest)
                    del self.slots[place][k], self.keys[place][k]
                    break
            del self.live[digest]
        return True

    def __iter__(self) -> Iterable[tuple[bytes, int]]:
        return iter(self.live.items())


def digest_of(text: str = "text"):
    return F.sha2(body(text), 256)


def bucket_of(digest: str, buckets: int):
    return F.pmod(F.xxhash64(digest), F.lit(buckets))


def combined(digests: DataFrame) -> DataFrame:
    """(digest) -> (digest, n): copies within a batch become one row before any shuffle."""

    def run(batches):
        for batch in batches:
            names, counts = zip(*((v["values"].as_py(), v["counts"].as_py()) for v in batch.column(0).value_counts())) if batch.num_rows else ((), ())
            yield [list(names), list(counts)]

    return digests.mapInArrow(arrow_rows(run, pa.schema([("digest", pa.string()), ("n", pa.int64())])), "digest string, n long")


def repeated_digests(docs: DataFrame, bucket_rows: int = 200_000) -> DataFrame:
    """Digests of more than one row, as the filters of their buckets find them.

    The number of buckets follows the number of rows, so a bucket's filter and stored keys stay small.
    """
    buckets = slices(docs.count(), bucket_rows)

    def run(batches):
        index = CuckooIndex()
        told: set[bytes] = set()
        for batch in batches:
            new = []
            for digest, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = bytes.fromhex(digest)
                if (index.insert(key, n) or n > 1) and key not in told:
                    told.add(key)
                    new.append(digest)
            yield [new]

    rows = combined(docs.select(digest_of().alias("digest"))).repartition(buckets, bucket_of("digest", buckets))
    return rows.mapInArrow(arrow_rows(run, pa.schema([("digest", pa.string())])), "digest string")


def exact_copies(docs: DataFrame, bucket_rows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays; a
    null doc_id is smaller than any. Rows that repeat an id and a text are the same document and share
    its fate. group_size counts rows. Only doc_id and text are read. An empty table gives no rows.

    Filter hits are verified twice: against the stored key of the bucket, and by grouping the whole
    texts of all documents with a repeated digest, so even equal digests of different texts stay apart.
    """
    rows = docs.select("doc_id", body().alias("text"), digest_of().alias("text_sha256"))
    suspects = repeated_digests(docs, bucket_rows).withColumnRenamed("digest", "_digest")
    match = F.col("text_sha256") == F.col("_digest")
    marked = rows.select("doc_id", "text_sha256").join(suspects, match, "left")
    single = marked.filter("_digest IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    several = rows.join(suspects, match, "left_semi")
    # a second hash stands for the text once the texts themselves have been grouped
    groups = several.groupBy("text_sha256", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("text_sha256").alias("_sha"), F.xxhash64("text").alias("_second"), "keep_id", "group_size")
    copies = several.select("doc_id", "text_sha256", F.xxhash64("text").alias("_own")).join(groups, (F.col("text_sha256") == F.col("_sha")) & (F.col("_own") == F.col("_second")))
    found = single.unionByName(copies.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def build_index(docs: DataFrame, buckets: int) -> DataFrame:
    """The live index as a table: bucket, digest, n. Buckets stay fixed for later changes."""
    return combined(docs.select(digest_of().alias("digest"))).groupBy("digest").agg(F.sum("n").alias("n")).select(bucket_of("digest", buckets).alias("bucket"), "digest", "n")


def change_index(index: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    """Apply inserted and deleted documents (text, deleted boolean) to the index; returns the new index.

    Deletions of digests that are not live change nothing. Within one call inserts go first.
    """
    net = changes.select(digest_of().alias("digest"), F.coalesce("deleted", F.lit(False)).alias("gone"))
    net = net.groupBy("digest").agg(F.count_if(~F.col("gone")).alias("added"), F.count_if("gone").alias("removed"))
    net = net.withColumn("bucket", bucket_of("digest", buckets))

    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        live = CuckooIndex(len(old) + len(new))
        for digest, n in zip(old["digest"], old["n"]):
            live.insert(bytes.fromhex(digest), int(n))
        for digest, added, removed in zip(new["digest"], new["added"], new["removed"]):
            if added:
                live.insert(bytes.fromhex(digest), int(added))
            if removed:
                live.delete(bytes.fromhex(digest), int(removed))
        return pd.DataFrame([(key[0], d.hex(), n) for d, n in live], columns=["bucket", "digest", "n"])

    return index.groupBy("bucket").cogroup(net.groupBy("bucket")).applyInPandas(run, "bucket long, digest string, n long")
