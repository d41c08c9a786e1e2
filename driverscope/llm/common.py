"""Words, shingles, tokens and small distributed helpers shared by the operators."""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driverscope.session import scratch_path

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and go on from the files, which outlive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def body(column: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def arrow_rows(function: Callable, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Wrap ``function(iterator of batches) -> iterator of column lists`` for mapInArrow."""

    def run(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types)], schema=schema)

    return run


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and text ends of consecutive texts, about ``limit`` bytes at a time, at least one text."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        after = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        yield data[ends[row] : ends[after]], ends[row + 1 : after + 1] - ends[row]
        row = after


class WordHasher:
    """64-bit hashes of all words of many texts at once; only A-Z are lower-cased.

    A word's hash is the sum of one number per byte and place in the word, each from a mixing of both: words that differ
    sum up different numbers, which no repetition inside them can make cancel. Sums come from running sums over
    all bytes.
    """

    def __init__(self) -> None:
        values = np.random.RandomState(20).randint(0, 1 << 62, 256).astype(np.uint64)
        values[65:91] = values[97:123]
        self.values = values
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, number of words up to each text's end)."""
        size = len(data)
        if not size:
            return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
        blank = self.blank[data]
        opens = np.ones(size + 1, bool)
        opens[1:-1] = blank[:-1]
        opens[ends] = True  # a text's first byte opens a word whatever stands before
        closes = opens[1:].copy()
        closes[:-1] |= blank[1:]
        first, last = np.flatnonzero(opens[:-1] & ~blank), np.flatnonzero(closes & ~blank) + 1
        # place in the word: steps of one, set back at each beginning
        step = np.ones(size, np.int64)
        step[0] = 0
        if len(first):
            step[first[1:]] = 1 - np.diff(first)
            step[first[0]] = min(0, 1 - first[0])
        place = np.cumsum(step).astype(np.uint64)
        place *= np.uint64(0x9E3779B97F4A7C15)
        place += self.values[data]
        place ^= place >> np.uint64(30)
        place *= np.uint64(0xBF58476D1CE4E5B9)
        place ^= place >> np.uint64(27)
        place *= np.uint64(0x94D049BB133111EB)
        place ^= place >> np.uint64(31)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(place, out=sums[1:])
        out = sums[last] - sums[first]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out, np.searchsorted(first, ends)


def shingle_sets(column: pa.Array, width: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles; a shorter text is one, no words none."""

    def fold(hashes: np.ndarray, size: int) -> np.ndarray:
        rows = len(hashes) - size + 1
        out = np.full(rows, size, np.uint64)
        for k in range(size):
            out = (out ^ hashes[k : k + rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)

    for data, ends in text_chunks(column):
        hashes, words = hasher.words(data, ends)
        whole = fold(hashes, width) if len(hashes) >= width else None
        start = 0
        for end in words.tolist():
            size = end - start
            if size >= width:
                own = np.sort(whole[start : end - width + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif size:
                yield fold(hashes[start:end], size)
            else:
                yield np.empty(0, np.uint64)
            start = end


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable bytes for
    themselves, the others for characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class ChunkTokens(dict):
    """Blank-free chunk -> its ids as little-endian bytes, encoded by the tokenizer once per chunk.

    The vocabulary splits at white space and drops it before merging, so the ids of a text are the
    ids of its chunks in order. A chunk of letters and closing marks is split once more, as the
    vocabulary's own pattern does, and plain letters go straight to the tokenizer's merges, lower-cased;
    every other chunk takes the tokenizer's whole way. When full, the cache becomes the one before,
    from which chunks still in use are taken over; long chunks are not kept. Both halves together hold about
    ``limit`` bytes at most.
    """

    limit = 128 << 20
    longest = 64
    #: Bytes of an entry besides its letters and ids: two object headers and a place in the table.
    entry = 180

    def __init__(self, tokenizer_path: str, kind: str = "<u4") -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(tokenizer_path), {"<u2": "H", "<u4": "I"}[kind]
        self.merges, self.letters = self.tokenizer.model, byte_letters()
        self.before: dict[str, bytes] = {}
        self.held = 0
        # another vocabulary, with other rules, takes the whole way alone
        trial = "Straße naïve, hello WORLD."
        self.plain = True
        self.plain = self.ids(trial) == self._whole(trial)
        self.clear()
        self.held = 0

    def _whole(self, chunk: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > self.longest:
            return self._whole(chunk)
        if (value := self.before.get(chunk)) is None:
            value = self._encode(chunk)
        if self.held >= self.limit // 2:
            self.before = dict(self)
            self.clear()
            self.held = 0
        self[chunk] = value
        self.held += self.entry + len(chunk) + len(value)
        return value

    def _encode(self, chunk: str) -> bytes:
        word = chunk.rstrip(CLOSING)
        if not self.plain or not word.isalpha() or not (word.isascii() or max(word) < "\u0100"):
            return self._whole(chunk)
        if word != chunk:
            return self[word] + self[chunk[len(word) :]]
        if (low := word.lower()) != word:
            return self[low]
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array(self.kind, [t.id for t in self.merges.tokenize(spelt)]).tobytes()

    def ids(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return self._whole(text)
        if self.plain:
            # the vocabulary lower-cases; letters up to U+00FF change one by one, so it may be done first
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.__getitem__, text.split()))


#: Marks that follow a word as a run of their own; an apostrophe may begin an ending instead.
CLOSING = ",.;:!?*#$%&|)]}>\"/-_=+~@^"
#: Characters at which Python splits and the vocabulary does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def chunk_tokens(tokenizer_path: str, kind: str = "<u4", limit: int = ChunkTokens.limit) -> ChunkTokens:
    """The worker process's cache of about ``limit`` bytes, kept from task to task; one at a time, so memory stays bounded."""
    keep = sys.modules.setdefault("_driverscope_worker", ModuleType("_driverscope_worker"))
    key = (tokenizer_path, kind)
    if getattr(keep, "key", None) != key:
        keep.key, keep.cache = key, ChunkTokens(tokenizer_path, kind)
    keep.cache.limit = limit
    return keep.cache


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with a global 0-based ``rank``, without one task seeing them all.

    The rows are range-sorted and written with their place in their file's task; only the number of
    rows per task is summed up over all tasks.
    """
    from pyspark.sql import Window as W

    placed = stored(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    before = placed.groupBy(part.alias("__bin")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("__bin", (F.sum("_n").over(W.orderBy("__bin")) - F.col("_n")).alias("_before"))
    return (
        placed.withColumn("__bin", part)
        .join(before, "__bin")
        .withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__bin", "_place", "_before")
    )


def uniform(*columns: Column | str, salt: str) -> Column:
    """A number in (0, 1) from the digest of the columns: the same on every run and after lost tasks."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(salt), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def slices(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))
