"""Token ids in patched frame-of-reference blocks: write, index, read back.

A segment holds whole documents in ascending doc_id order. Its ids are cut into blocks of 128. Each
block keeps its minimum, packs the differences at the width that fits the given percentile of them,
and lists the ids that need more bits as exceptions. Block starts are indexed, so one block can be
read alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driverscope.operators.ordered import running, time_bin

from .common import arrow_rows, body, chunk_tokens, tokenizer_file

BLOCK = 128
MAGIC = b"PFOR0001"
SEGMENT_SCHEMA = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
SEGMENT_DDL = "part int, segment long, n_docs long, n_tokens long, image binary"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) numbers below 2**width -> (blocks, 2 * width) 64-bit words."""
    out = np.zeros((len(values), 2 * width), np.uint64)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        out[:, word] |= values[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, j] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(words), BLOCK), np.uint64)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        out[:, j] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1)


def encode(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """Block image of 32-bit ids: counts, minima, widths, exception counts, block starts, data, exceptions."""
    blocks = -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[: len(ids)] = ids
    if blocks:
        full[len(ids) :] = full[(blocks - 1) * BLOCK]
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.empty(0, np.uint64)
    rest = full - least[:, None]
    bits = np.zeros(rest.shape, np.uint8)
    bits[rest > 0] = np.floor(np.log2(rest[rest > 0])).astype(np.uint8) + 1
    rank = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    widths = np.sort(bits, axis=1)[:, rank] if blocks else np.empty(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(16 * widths.astype(np.int64))]).astype("<u4")
    data = np.empty(int(starts[-1]), np.uint8)
    for width in map(int, np.unique(widths[widths > 0])):
        at = np.flatnonzero(widths == width)
        low = pack(rest[at] & np.uint64((1 << width) - 1), width).astype("<u8")
        data[starts[at][:, None].astype(np.int64) + np.arange(16 * width)] = low.view(np.uint8).reshape(len(at), -1)
    block, place = np.nonzero(bits > widths[:, None])
    counts = np.bincount(block, minlength=blocks).astype("<u1")
    return b"".join(
        [np.array([len(ids), blocks, len(block)], "<u8").tobytes(), least.astype("<u4").tobytes(), widths.astype("<u1").tobytes(), counts.tobytes(), starts.tobytes(), data.tobytes(), place.astype("<u1").tobytes(), rest[block, place].astype("<u4").tobytes()]
    )


def decode(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (excluded) of an image; all by default."""
    view = memoryview(image)
    ids, blocks, outliers = map(int, np.frombuffer(view, "<u8", 3))
    at, fields = 24, []
    for kind, count in (("<u4", blocks), ("<u1", blocks), ("<u1", blocks), ("<u4", blocks + 1)):
        fields.append(np.frombuffer(view, kind, count, at))
        at += fields[-1].nbytes
    least, widths, counts, starts = fields
    data = np.frombuffer(view, np.uint8, int(starts[-1]), at)
    places = np.frombuffer(view, "<u1", outliers, at + len(data))
    values = np.frombuffer(view, "<u4", outliers, at + len(data) + outliers)
    last = blocks if last is None else min(last, blocks)
    out = np.zeros((max(0, last - first), BLOCK), np.uint64)
    for width in map(int, np.unique(widths[first:last])):
        if width:
            own = first + np.flatnonzero(widths[first:last] == width)
            words = data[starts[own][:, None].astype(np.int64) + np.arange(16 * width)].reshape(-1).view("<u8").reshape(len(own), -1)
            out[own - first] = unpack(words, width)
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    own = slice(ends[first], ends[last]) if last > first else slice(0, 0)
    out[np.repeat(np.arange(first, last), counts[first:last]) - first, places[own]] = values[own]
    out += least[first:last, None]
    return out.reshape(-1)[: max(0, min(ids, last * BLOCK) - first * BLOCK)].astype("<u4")


def segment_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float) -> bytes:
    known = np.array([d is not None for d in doc_ids], "<u1").tobytes()
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    return MAGIC + np.array([len(doc_ids)], "<u8").tobytes() + known + numbers + np.array(lengths, "<u8").tobytes() + encode(ids, percentile)


def open_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, numbers of ids, ids) of a segment."""
    if image[:8] != MAGIC:
        raise ValueError("not a token segment")
    docs = int(np.frombuffer(image, "<u8", 1, 8)[0])
    known = np.frombuffer(image, "<u1", docs, 16)
    numbers = np.frombuffer(image, "<i8", docs, 16 + docs)
    lengths = np.frombuffer(image, "<u8", docs, 16 + 9 * docs).astype(np.int64)
    return [int(n) if k else None for n, k in zip(numbers, known)], lengths, decode(image[16 + 17 * docs :])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, segment_tokens: int = 1 << 18, percentile: float = 90.0) -> None:
    """Encode every whole text, append the end id, and write segments in ascending doc_id order.

    Null texts are empty (the end id alone); a null doc_id sorts first; rows with the same doc_id
    follow each other in the order of a hash of their texts. An empty table gives no segment.
    Only doc_id and text are read, whatever other columns there are.
    """
    tokenizer = tokenizer or tokenizer_file()

    def segments(batches):
        cache, part, number = chunk_tokens(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        names, lengths, held, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cache.ids(text.as_py()) + end
                names.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += lengths[-1]
                if size >= segment_tokens:
                    yield [part], [number], [len(names)], [size], [segment_image(names, lengths, np.frombuffer(b"".join(held), "<u4"), percentile)]
                    names, lengths, held, size, number = [], [], [], 0, number + 1
        if names:
            yield [part], [number], [len(names)], [size], [segment_image(names, lengths, np.frombuffer(b"".join(held), "<u4"), percentile)]

    rows = docs.select("doc_id", body().alias("text"))
    order = [F.col("doc_id").asc(), F.xxhash64("text").asc()]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(arrow_rows(segments, SEGMENT_SCHEMA), SEGMENT_DDL).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for.

    A start is the sum of three numbers: ids of earlier parts, of earlier segments of the part, of
    earlier documents of the segment. Only one number per 64 parts is summed up in one place.
    """
    files = spark.read.schema(SEGMENT_DDL).parquet(folder)
    sizes = files.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    parts = running(parts, [], time_bin("part", 64), ["part"], {"_part_start": F.col("_all")}, inclusive=False).drop("_all")
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    offsets = sizes.select("part", "segment", within.alias("_segment_start")).join(parts, "part")
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def documents(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, segment, image = (batch.column(c)[k].as_py() for c in range(3))
                names, lengths, ids = open_segment(image)
                ends = np.cumsum(lengths)
                starts, raw = ends - lengths, memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [[part] * len(names), [segment] * len(names), names, starts, lengths, crc]
                yield columns + [[ids[a:b].tolist() for a, b in zip(starts, ends)]] * with_ids

    ddl = "part int, segment long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    read = files.select("part", "segment", "image").mapInArrow(arrow_rows(documents, schema), ddl)
    return read.join(offsets, ["part", "segment"]).select(
        "doc_id", (F.col("_part_start") + F.col("_segment_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
