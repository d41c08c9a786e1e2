"""The study's file tree as a Spark data source.

``<root>/<participant>/<round>/<section>/<scenario>/<task>/.../<file>`` holds one CSV table per recording. Equality
and IN filters on the five path parts are pushed into the listing, so other directories are never looked at; files are cut into
parts of bounded size, small ones share a part, and every part streams Arrow batches. Each file's
columns are found by its own header.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Directory levels below the root, in order.
LEVELS = ("participant_name", "round", "section", "scenario", "task")
PATH = "__path"
#: Bytes of a part, and of a text block inside it; rows of an Arrow batch, each of which names its file.
PART_BYTES, BLOCK_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 10_000
PACKED = re.compile(r"\.(gz|bz2|zst|lz4)$")
VIDEO = re.compile(r"^video\.[^/]*$")


class TreeError(ValueError):
    """A directory does not hold what the study promises."""


def open_root(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    if "://" not in root and not root.startswith("file:"):
        return arrow_fs.LocalFileSystem(), root.rstrip("/")
    if re.match(r"file:/(?!/)", root):
        root = "file://" + root.removeprefix("file:")
    system, path = arrow_fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def clean_name(name: str) -> str:
    return name.strip().replace(" ", "_")


def recording_files(system: arrow_fs.FileSystem, directory: str, wanted: Mapping[str, set[str]], level: int = 0) -> Iterator[arrow_fs.FileInfo]:
    """Files below a directory; levels with ``wanted`` names are walked through these alone."""
    if not any(name in wanted for name in LEVELS[level:]):
        for info in system.get_file_info(arrow_fs.FileSelector(directory, recursive=True, allow_not_found=True)):
            if info.type == arrow_fs.FileType.File:
                yield info
        return
    for info in system.get_file_info(arrow_fs.FileSelector(directory, allow_not_found=True)):
        names = wanted.get(LEVELS[level])
        if names is not None and info.base_name not in names:
            continue
        if info.type == arrow_fs.FileType.Directory:
            yield from recording_files(system, info.path, wanted, level + 1)
        elif level == len(LEVELS) - 1:  # a scenario without tasks: its files stand at the last level
            yield info


def path_parts(root: str, path: str) -> tuple[str | None, ...]:
    """The first five parts of a file's path below the root; all missing where it has fewer. The last is the
    file itself where a scenario has no tasks."""
    parts = path.removeprefix(root).strip("/").split("/")
    return tuple(parts[: len(LEVELS)]) if len(parts) >= len(LEVELS) else (None,) * len(LEVELS)


def header(stream, clean: bool = True) -> tuple[list[str], int]:
    """(names of the first line that is not blank, where the next one begins)."""
    seen, at = b"", 0
    while True:
        data = stream.read(1 << 16)
        seen += data
        while (end := seen.find(b"\n", at)) >= 0 or not data:
            line = seen[at : end if end >= 0 else None].decode("utf-8-sig", "replace").strip("\r\n")
            at = end + 1 if end >= 0 else len(seen)
            if line.strip():
                return [clean_name(c) if clean else c.strip() for c in next(csv.reader([line]))], at
            if end < 0:
                return [], at


def blocks(stream, start: int, end: int | None, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Whole lines of a stream that stands at ``start``: those that begin before ``end``."""
    rest, at = b"", start
    while end is None or at < end:
        data = stream.read(size)
        block = rest + data
        cut = block.rfind(b"\n") + 1 if data else len(block)
        if end is not None and at + cut > end:
            stop = block.find(b"\n", max(0, end - at - 1)) + 1
            yield block[: stop or cut]
            return
        if cut:
            yield block[:cut]
        if not data:
            return
        rest, at = block[cut:], at + cut


def parse(block: bytes, names: Sequence[str], columns: Sequence[str]) -> pa.Table:
    """Cells as strings, empty ones NULL; short and long rows are filled or cut, as a permissive reader does."""
    unique = [n if n not in names[:i] else f"\0{i}" for i, n in enumerate(names)]
    present = [c for c in columns if c in names]
    try:
        table = arrow_csv.read_csv(
            io.BytesIO(block),
            read_options=arrow_csv.ReadOptions(column_names=unique, use_threads=False),
            convert_options=arrow_csv.ConvertOptions(
                include_columns=present, column_types={c: pa.string() for c in unique}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False
            ),
        )
    except pa.ArrowInvalid:
        rows = [r for r in csv.reader(io.StringIO(block.decode("utf-8", "replace"), newline="")) if r]
        cells = {n: i for i, n in reversed([*enumerate(names)])}
        table = pa.table({c: pa.array([(r[cells[c]] or None) if cells[c] < len(r) else None for r in rows], pa.string()) for c in present})
        if not present:
            return pa.table({c: pa.nulls(len(rows), pa.string()) for c in columns})
    if not present:
        lines = sum(1 for line in block.splitlines() if line.strip())
        return pa.table({c: pa.nulls(lines, pa.string()) for c in columns})
    return pa.table({c: table.column(c) if c in present else pa.nulls(table.num_rows, pa.string()) for c in columns})


class Part(InputPartition):
    """Byte ranges of files: (path, start, end)."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]) -> None:
        super().__init__(None)
        self.ranges = ranges


class TreeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType) -> None:
        self.root, self.file = options["path"], options.get("file", "*.csv")
        self.inside, self.video = options.get("inside"), options.get("video") == "one"
        self.part_bytes, self.clean = int(options.get("partBytes", PART_BYTES)), options.get("clean") != "no"
        self.wanted: dict[str, set[str]] = {k: set(v) for k, v in json.loads(options.get("wanted", "{}")).items()}
        self.columns = [f.name for f in schema.fields if f.name not in (*LEVELS, PATH)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            column = one.attribute[0] if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 else None
            values = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else set()
            if column in LEVELS and all(isinstance(v, str) for v in values):
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield one

    def files(self) -> list[arrow_fs.FileInfo]:
        """The files to read, by path; hidden ones are passed over."""
        system, root = open_root(self.root)
        listed = [i for i in recording_files(system, root, self.wanted) if not re.search(r"/[._][^/]*$", i.path)]
        if self.wanted:  # a path part is only known for files that lie deep enough
            listed = [i for i in listed if path_parts(root, i.path)[0] is not None]
        found = [i for i in listed if fnmatch.fnmatchcase(i.base_name, self.file) and (not self.inside or f"/{self.inside}/" in i.path)]
        if self.video:
            videos: dict[str, int] = {}
            for i in listed:
                if VIDEO.match(i.base_name):
                    folder = i.path.rpartition("/")[0]
                    videos[folder] = videos.get(folder, 0) + 1
            for i in found:
                folder = i.path.rpartition("/")[0]
                if videos.get(folder, 0) != 1:
                    raise TreeError(f"{folder} holds {videos.get(folder, 0)} video files instead of one")
        return sorted(found, key=lambda i: i.path)

    def names(self) -> list[str]:
        """All column names, in the order in which the files show them; every header is read once."""
        system, _ = open_root(self.root)

        def first(info: arrow_fs.FileInfo) -> list[str]:
            with system.open_input_stream(info.path) as stream:
                return header(stream, self.clean)[0]

        with ThreadPoolExecutor(16) as pool:
            return [n for n in dict.fromkeys(n for names in pool.map(first, self.files()) for n in names) if n]

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        room = 0
        for info in self.files():
            if info.size > self.part_bytes and not PACKED.search(info.path):
                edges = [*range(0, info.size, self.part_bytes), info.size]
                parts += [Part([(info.path, a, b)]) for a, b in zip(edges, edges[1:])]
                room = 0
                continue
            # opening a file costs about as much as reading some of it
            cost = max(info.size, self.part_bytes >> 6)
            if cost > room or not parts:
                parts.append(Part([]))
                room = self.part_bytes
            parts[-1].ranges.append((info.path, 0, None))
            room -= cost
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, root = open_root(self.root)
        for path, start, end in partition.ranges:
            with system.open_input_stream(path) as stream:
                names, after = header(stream, self.clean)
            if not names:
                continue
            known = [*path_parts(root, path), path]
            with system.open_input_stream(path) if PACKED.search(path) else system.open_input_file(path) as stream:
                begin = self._line_start(stream, path, start, after)
                for block in blocks(stream, begin, end):
                    for batch in parse(block, names, self.columns).combine_chunks().to_batches(BATCH_ROWS):
                        fixed = [pa.nulls(batch.num_rows, pa.string()) if v is None else pa.repeat(v, batch.num_rows) for v in known]
                        yield pa.RecordBatch.from_arrays([*fixed, *batch.columns], names=[*LEVELS, PATH, *self.columns])

    def _line_start(self, stream, path: str, start: int, after: int) -> int:
        """Move to the first line that begins at ``start`` or later, past the header."""
        if PACKED.search(path):
            stream.read(after)
            return after
        if start <= after:
            stream.seek(after)
            return after
        at = start - 1
        stream.seek(at)
        while data := stream.read(1 << 16):
            end = data.find(b"\n")
            if end >= 0:
                at += end + 1
                break
            at += len(data)
        stream.seek(at)
        return at


class StudyTree(DataSource):
    """Options: path, file (glob of names), columns (JSON list; all without it), present ("only" leaves out columns that no file has),
    wanted (JSON: level to names), clean ("no" keeps names), inside (a directory the file must lie in), video ("one": exactly one video beside each file)."""

    @classmethod
    def name(cls) -> str:
        return "study_tree"

    def schema(self) -> T.StructType:
        columns = json.loads(self.options.get("columns", "[]"))
        if not columns or self.options.get("present") == "only":
            found = TreeReader(self.options, T.StructType()).names()
            columns = [c for c in columns if c in found] if columns else found
        return T.StructType([T.StructField(n, T.StringType()) for n in (*LEVELS, PATH, *dict.fromkeys(columns))])

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self.options, schema)


def read_tree(
    spark: SparkSession,
    root: str,
    file: str,
    columns: Sequence[str] = (),
    wanted: Mapping[str, Sequence[str]] | None = None,
    inside: str | None = None,
    one_video: bool = False,
    present_only: bool = True,
    clean: bool = True,
) -> DataFrame:
    """Tables of one file name below a root: the path's parts, ``__path``, and the columns as strings.

    ``clean`` writes blanks in column names as underscores. The first of equal names counts.

    Filters on the path's parts reach the listing; ``wanted`` narrows it from the start, also for the look at the headers
    that finds the names (not needed when ``columns`` are given and ``present_only`` is off: a column
    that no file has is then NULL). Parts are missing where a file lies less deep than a task.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StudyTree)
    options = {"path": root, "file": file, "columns": json.dumps(list(columns)), "wanted": json.dumps({k: list(v) for k, v in (wanted or {}).items()})}
    options |= {"inside": inside} if inside else {}
    options |= {"video": "one"} if one_video else {}
    options |= {"present": "only"} if present_only else {}
    options |= {} if clean else {"clean": "no"}
    return spark.read.format("study_tree").options(**options).load()
