"""Subword pieces of whole texts and back: a prefix table over the vocabulary's matches, with a test whether two
pieces can stand side by side, in place of merging step by step."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body

BLANK = "▁"
IDS_DDL = "doc_id long, ids array<int>, decoded string"


class PieceTable:
    """Encoder and decoder for a merge-type (BPE) model file of the sentencepiece library.

    The library joins, again and again, the neighbouring pieces whose union has the highest score, the
    leftmost of equals. A sequence of pieces is its result exactly if every two neighbours alone give back
    themselves: merges inside a piece do not see beyond it until one crosses an edge, and the first that
    does would do so with the two pieces alone as well. Hence each prefix of a text has one last piece,
    the one vocabulary match ending there that is compatible with the last piece of the prefix before it. The table stores
    these, and the ids are read off backwards: time linear in the text, however long it is.

    Normalisation is the identity with a blank in front, blanks written as U+2581, and letters without a piece become
    their UTF-8 bytes; other models are refused.
    """

    #: Chunks kept, and pairs judged; emptied when full, so memory is bounded whatever the texts hold.
    limit = 200_000
    longest = 48

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" ﬁ  A") != f"{BLANK}{BLANK}ﬁ{BLANK}{BLANK}A" or model.normalize(""):
            raise ValueError("the model's normalisation is not the identity with a blank in front")
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes_of = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.bytes_of) != 256:
            raise ValueError("the model does not fall back to bytes")
        self.plain = {names[i]: i for i in range(size) if not (special[i] or model.is_byte(i) or model.is_unused(i))}
        self.score = {p: model.get_score(i) for p, i in self.plain.items()}
        # what a piece reads as; a control piece reads as nothing
        self.surface = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.byte_ids = np.zeros(size, bool)
        for value, i in self.bytes_of.items():
            self.surface[i], self.byte_ids[i] = bytes([value]), True
        self.opens = [n.startswith(BLANK) for n in names]
        self.silent = {i for i in range(size) if model.is_control(i)}

        self.automaton = ahocorasick.Automaton()
        self.followers: list[dict[str, bool]] = []
        self.judged = 0
        for piece in self.plain:
            self.followers.append({})
            self.automaton.add_word(piece, (piece, len(piece), self.followers[-1]))
        self.automaton.make_automaton()
        letters = set("".join(self.plain))
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in letters and chr(c) != " "))
        # no piece goes on with a blank after another letter, or holds a letter that has no piece: cut there
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.plain):
            pattern = f"[^{alone}]+|[{alone}]" if alone else "(?s:.+)"
        else:
            pattern = f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")
        self.chunks = re.compile(pattern).findall
        self.traces: dict[str, tuple | None] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    # encoding

    def trace(self, piece: str) -> tuple | None:
        """How the letters of a piece become one: per merge (score, last part before it, first part before it).
        None if merging them does not end in the piece, which then occurs nowhere."""
        if piece not in self.traces:
            parts, left, right = list(piece), [], []
            while len(parts) > 1:
                scores = [self.score.get(a + b) for a, b in itertools.pairwise(parts)]
                known = [s for s in scores if s is not None]
                if not known:
                    break
                top = max(known)
                left.append((top, parts[0]))
                right.append((top, parts[-1]))
                at = scores.index(top)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = len(parts) == 1
            self.traces[piece] = ((*left, (None, piece)), (*right, (None, piece))) if whole else None
        return self.traces[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether the letters of ``a`` and ``b`` together end as these two pieces.

        Both pieces' own merges run in the order of their scores; at each point the last part of ``a`` and the
        first of ``b`` must not join: their score has to stay below the next merge in ``a``, which lies further left
        and wins a tie, or below the next in ``b``, which loses one.
        """
        left, right = self.trace(a), self.trace(b)
        if left is None or right is None:
            return False
        left, right, i, j = left[1], right[0], 0, 0
        while True:
            (in_a, x), (in_b, y) = left[i], right[j]
            across = self.score.get(x + y)
            if across is not None and (in_a is None or across > in_a) and (in_b is None or across >= in_b):
                return False
            if in_a is None and in_b is None:
                return True
            if in_b is None or (in_a is not None and in_a >= in_b):
                i += 1
            else:
                j += 1

    def pieces(self, chunk: str) -> list[str]:
        """Pieces of a text in which blanks are written as U+2581."""
        # a letter that no piece ends with stands alone, so each prefix begins with its last letter
        last, done = ["", *chunk], -1
        for end, (piece, size, known) in self.automaton.iter(chunk):
            if end == done:
                continue
            before = last[end + 1 - size]
            fits = known.get(before)
            if fits is None:
                fits = self.judge(before, piece, known)
            if fits:
                last[end + 1] = piece
                done = end
        out, at = [], len(chunk)
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def judge(self, before: str, piece: str, known: dict[str, bool]) -> bool:
        """Whether ``piece`` can follow; the answer is kept with the piece. The empty text begins a chunk."""
        if self.judged >= self.limit:
            self.judged = 0
            for other in self.followers:
                other.clear()
        self.judged += 1
        known[before] = fits = self.compatible(before, piece) if before else self.trace(piece) is not None
        return fits

    def _ids(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pieces(chunk):
            if (known := self.plain.get(piece)) is not None:
                out.append(known)
            else:
                out += [self.bytes_of[b] for b in piece.encode()]
        return tuple(out)

    def lookup(self, chunk: str) -> tuple[int, ...]:
        found = self.cache.get(chunk)
        if found is None:
            found = self._ids(chunk)
            if len(chunk) <= self.longest:
                if len(self.cache) >= self.limit:
                    self.cache.clear()
                self.cache[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without marks for its beginning and end; none for the empty text."""
        if not text:
            return np.empty(0, np.int32)
        chunks = self.chunks(BLANK + text.replace(" ", BLANK))
        return np.fromiter(itertools.chain.from_iterable(map(self.lookup, chunks)), np.int32)

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids: one blank in front is dropped, bytes that are no UTF-8 become U+FFFD one by one."""
        listed = ids.tolist()
        data = b"".join(map(self.surface.__getitem__, listed))
        # the blank in front counts once control pieces are passed over, and only on a piece that is written with it
        first = next((i for i in listed if self.surface[i]), None)
        cut = first is not None and self.opens[first]
        if self.silent.isdisjoint(listed):
            try:
                return data[cut:].decode()
            except UnicodeDecodeError:
                pass
        return self._patched(ids, cut)

    def _patched(self, ids: np.ndarray, cut: bool) -> str:
        """Runs of byte pieces are read on their own, letter by letter; a control piece ends a run."""
        out: list[str] = []
        for is_bytes, run in itertools.groupby(ids.tolist(), key=self.byte_ids.__getitem__):
            data = b"".join(map(self.surface.__getitem__, run))
            if not is_bytes:
                out.append(data.decode())
                continue
            while data:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(data[:size].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    size = 1
                data = data[size:]
        text = "".join(out)
        return text[1:] if cut else text


def piece_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def _parts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``limit`` bytes of text, one row at least."""
    first = 0
    while first < len(column):
        last, size = first, 0
        while last < len(column) and (last == first or size < limit):
            size += len(column[last].as_buffer()) if column[last].is_valid else 0
            last += 1
        yield first, last
        first = last


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, ids (array<int>), decoded.

    Null texts are empty: no ids, an empty text. Repeated rows are encoded one by one; a null doc_id stays
    null. Only doc_id and text are read. An empty table gives no rows. Needs no shuffle.
    """
    path = model or piece_file()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        table = PieceTable(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for a, b in _parts(texts, 1 << 22):
                ids = [table.encode(t.as_py()) for t in texts.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), _lists(ids).cast(schema.types[1]), pa.array(map(table.decode, ids), pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(run, IDS_DDL)


def decode_ids(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """All columns, and the text of each row's ids as ``out``; null ids give null."""
    path = model or piece_file()

    def run(batches: Iterator[pa.RecordBatch]):
        table = PieceTable(path)
        for batch in batches:
            lists = batch.column(ids)
            texts = [table.decode(x.values.to_numpy()) if x.is_valid else None for x in lists]
            kept = [batch.column(c) for c in batch.schema.names if c != out]
            names = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*names, out])

    kept = rows.drop(out)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row of ``round_trip`` doc_id, n_tokens and the SHA-256 of the decimal ids, joined by commas, and of the decoded text."""
    rows = round_trip(docs, model)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
