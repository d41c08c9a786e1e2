"""Frame grids and time chunks of recordings, and the rows that fall into them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driverscope.operators.ordered import time_bin
from driverscope.operators.spread import join_few
from driverscope.schema import INTERVALS

SECOND = 1_000_000_000


def _long(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def floor_div(a, b: int) -> Column:
    """Integer quotient towards minus infinity, in exact 64-bit arithmetic."""
    whole, by = _long(a), F.lit(b).cast("long")
    return F.call_function("div", whole - F.pmod(whole, by), by)


def frame_ns(frame, fps: int) -> Column:
    """Time of a frame, in ns after the recording's start."""
    return floor_div(_long(frame) * F.lit(SECOND).cast("long"), fps)


def frame_count(start, end, fps: int) -> Column:
    """Frames of a recording: one per 1/fps second that starts before its end."""
    scaled = (_long(end) - _long(start)) * F.lit(fps).cast("long")
    return F.greatest(F.lit(0).cast("long"), -floor_div(-scaled, SECOND))


def frame_grid(
    recordings: DataFrame, fps: int, start: str = "start_time", end: str = "end_time", keys: Sequence[str] = (), block: int = 1_000_000
) -> DataFrame:
    """One row per frame: ``frame`` and ``t_ns``. At fps 0 only the two end points, as given.

    One row becomes millions, so recordings are first cut into blocks of frames that are spread
    over the cluster, by ``keys`` and block, before they unfold. (The partition number is given, or the
    small block table would be merged into one task.)
    """
    if fps == 0:
        ends = F.array(_long(F.col(start)), _long(F.col(end)))
        return recordings.select("*", F.posexplode(ends).alias("frame", "t_ns"))
    frames = frame_count(F.col(start), F.col(end), fps)
    firsts = F.when(frames > 0, F.sequence(F.lit(0).cast("long"), frames - 1, F.lit(block).cast("long")))
    blocks = recordings.select("*", F.explode(firsts).alias("__first"))
    parts = int(recordings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, *(keys or (start, end)), "__first")
    numbers = F.sequence(F.col("__first"), F.least(F.col("__first") + F.lit(block), frames) - 1)
    return blocks.select(*recordings.columns, F.explode(numbers).alias("frame")).withColumn("t_ns", frame_ns(F.col("frame"), fps))


@dataclass(frozen=True)
class ChunkSpec:
    """How recordings are cut. Offsets count from the other end when negative."""

    strategy: str = "end"
    duration: float = 10.0
    stride: float = 5.0
    per_recording: int | None = 1
    start_offset: float = 0.0
    end_offset: float = 0.0
    fps: int | None = None
    remove_anomalies: float | None = 0.0
    seed: int = 42

    def at(self, fps: int) -> "ChunkSpec":
        from dataclasses import replace

        return replace(self, fps=fps)

    def frames(self, seconds: float) -> int:
        return int(round(seconds * (self.fps or 0)))


def default_fps(feature_fps: Sequence[int]) -> int:
    """The largest feature rate; 0 (whole recordings only) when no feature has one."""
    return int(max(feature_fps, default=0))


def overlap_share(start, end, other_start, other_end) -> Column:
    """Share of [start, end] covered by the other closed interval; NULL when they do not touch."""
    shared = F.least(end, other_end) - F.greatest(start, other_start)
    return F.when((other_start <= end) & (other_end >= start), F.try_divide(shared.cast("double"), (end - start).cast("double")))


def blocked(start, end, anomalies, limit: float) -> Column:
    """True when any anomaly covers at least ``limit`` of the chunk; 0 blocks on the slightest touch."""
    return F.exists(
        anomalies,
        lambda a: F.coalesce(overlap_share(start, end, a["start_ns"], a["end_ns"]) >= F.lit(limit), F.lit(False)),
    )


def mix(value: Column, seed: int, prime: int = 2147483647) -> Column:
    """Seeded integer scramble below 2**31 that plain SQL can repeat (squares modulo a prime)."""
    v = F.pmod(value.cast("long"), F.lit(prime).cast("long"))
    return F.pmod(F.pmod(v * v, F.lit(prime)) * F.lit(48271) + v * F.lit(16807) + F.lit(seed), F.lit(prime).cast("long"))


def blocked_starts(anomalies: Column, length: int, fps: int, limit: float) -> Column:
    """Frames at which no chunk of ``length`` frames may start, one closed interval (lo, hi) per anomaly that blocks any.

    A chunk's overlap with an anomaly grows, stays and falls as the chunk moves on, so the starts that are
    blocked lie together. Their ends are reckoned from the frame rate and then tried frame by frame, as frames fall on rounded times.
    """
    span = (length - 1) * SECOND / fps

    def blocks(f: Column, a: Column) -> Column:
        return blocked(frame_ns(f, fps), frame_ns(f + F.lit(length - 1), fps), F.array(a), limit)

    def near(at: Column, a: Column) -> Column:
        first = F.floor(at).cast("long")
        return F.filter(F.sequence(first - 2, first + 2), lambda f: blocks(f, a))

    def interval(a: Column) -> Column:
        # the earliest start that reaches into the anomaly far enough, and the last that still does
        low = (a["start_ns"] + limit * span - span) / SECOND * fps
        high = (a["end_ns"] - limit * span) / SECOND * fps
        return F.struct(F.array_min(near(low, a)).alias("lo"), F.array_max(near(high, a)).alias("hi"))

    return F.filter(F.transform(anomalies, interval), lambda i: i["lo"] <= i["hi"])


def open_starts(blocked_at: Column, first: Column, last: Column) -> Column:
    """(segments, total): the stretches of first .. last that no interval covers, each with the number of starts before it."""
    kind = "struct<cursor:bigint,segments:array<struct<start:bigint,before:bigint>>,total:bigint>"

    def cut(state: Column, lo: Column, hi: Column) -> Column:
        free = F.least(lo, last + 1) - state["cursor"]
        grown = F.concat(state["segments"], F.array(F.struct(state["cursor"].alias("start"), state["total"].alias("before"))))
        return F.struct(
            F.greatest(state["cursor"], hi + 1).alias("cursor"),
            F.when(free > 0, grown).otherwise(state["segments"]).alias("segments"),
            (state["total"] + F.greatest(free, F.lit(0).cast("long"))).alias("total"),
        ).cast(kind)

    begin = F.struct(first.cast("long").alias("cursor"), F.array().cast("array<struct<start:bigint,before:bigint>>").alias("segments"), F.lit(0).cast("long").alias("total")).cast(kind)
    ordered = F.array_append(F.array_sort(blocked_at), F.struct((last + 1).cast("long").alias("lo"), (last + 1).cast("long").alias("hi")))
    return F.aggregate(ordered, begin, lambda state, i: cut(state, i["lo"], i["hi"]))


def drawn_starts(segments: Column, wanted: Column, draw: Callable[[Column], Column]) -> Column:
    """``wanted`` distinct starts out of open segments, or all where there are fewer; every set is equally likely.

    One number is drawn per chunk: for each j among the last ``wanted`` ranks a rank up to j, and j itself where that is taken
    already. ``draw`` gives a whole number for a rank.
    """
    total = segments["total"]
    count = F.least(total, F.greatest(wanted, F.lit(0).cast("long")))
    ranks = F.when(count > 0, F.sequence(total - count, total - 1)).otherwise(F.array().cast("array<bigint>"))

    def pick(taken: Column, j: Column) -> Column:
        drawn = F.pmod(draw(j), j + 1).cast("long")
        return F.array_append(taken, F.when(F.array_contains(taken, drawn), j).otherwise(drawn))

    chosen = F.aggregate(ranks, F.array().cast("array<bigint>"), pick)

    def place(r: Column) -> Column:
        own = F.element_at(F.filter(segments["segments"], lambda s: s["before"] <= r), -1)
        return own["start"] + r - own["before"]

    return F.transform(chosen, place)


def chunk_recordings(
    recordings: DataFrame,
    spec: ChunkSpec,
    keys: Sequence[str],
    start: str = "start_time",
    end: str = "end_time",
    anomalies: str | None = None,
    rank: Column | None = None,
) -> DataFrame:
    """One row per chunk with ``chunk_number``, ``start_ns``, ``end_ns`` (closed, relative to the start).

    Numbers are given out before anomalous chunks are dropped, so gaps stay
    visible. Every strategy is row-local: ``random`` draws n distinct ones of a recording's admissible starts, whose
    number comes from the intervals that anomalies leave free, never from unfolded frames (``drawn_starts``). Only
    with a ``rank`` of one's own are all admissible starts ranked by it (Spark then prunes the ranking before its shuffle when n is fixed).
    """
    fps = spec.fps or 0
    strategy = "full" if fps == 0 else spec.strategy
    total = frame_count(F.col(start), F.col(end), fps) if fps else F.lit(2).cast("long")
    df = recordings.withColumn("__total", total)
    n = F.col("__total")

    if strategy == "full":
        last = frame_ns(n - 1, fps) if fps else _long(F.col(end))
        end_s = last / F.lit(1e9)

        def edge(offset: float) -> Column:
            seconds = F.lit(float(offset)) if offset >= 0 else end_s + F.lit(float(offset))
            return F.rint(seconds * F.lit(1e9)).cast("long")

        return (
            df.where(n > 0)
            .withColumns({"chunk_number": F.lit(0).cast("long"), "start_ns": edge(spec.start_offset), "end_ns": last - edge(spec.end_offset)})
            .drop("__total")
        )

    length, stride = spec.frames(spec.duration), spec.frames(spec.stride)
    head, tail = spec.frames(spec.start_offset), spec.frames(spec.end_offset)
    head_c = F.lit(head).cast("long") if head >= 0 else n + F.lit(head)
    tail_c = F.lit(tail).cast("long") if tail >= 0 else n + F.lit(tail)
    usable = n - head_c - tail_c

    if strategy in ("start", "end"):
        count = F.greatest(F.lit(0).cast("long"), floor_div(usable - F.lit(length), stride) + 1)
        if spec.per_recording is not None:
            count = F.least(count, F.lit(spec.per_recording).cast("long"))
        numbers = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))
        step = F.col("chunk_number") * F.lit(stride)
        first = head_c + step if strategy == "start" else n - tail_c - F.lit(length) - step
        df = df.select("*", F.explode(numbers).alias("chunk_number")).withColumn("__first", first)
    elif strategy == "random" and rank is None:
        wanted = F.lit(spec.per_recording).cast("long") if spec.per_recording is not None else floor_div(usable, length)
        found = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
        if anomalies is not None and spec.remove_anomalies is not None:
            found = blocked_starts(F.coalesce(F.col(anomalies), F.array().cast(INTERVALS)), length, fps, spec.remove_anomalies)
        df = df.withColumn("__open", open_starts(found, head_c, head_c + usable - F.lit(length)))
        draw = lambda j: F.xxhash64(*keys, j, F.lit(spec.seed))
        starts = drawn_starts(F.col("__open"), wanted, draw)
        df = df.select("*", F.posexplode(starts).alias("chunk_number", "__first")).withColumn("chunk_number", F.col("chunk_number").cast("long"))
        times = {"start_ns": frame_ns(F.col("__first"), fps), "end_ns": frame_ns(F.col("__first") + F.lit(length - 1), fps)}
        return df.withColumns(times).drop("__total", "__first", "__open")
    elif strategy == "random":
        starts = F.when(usable >= F.lit(length), F.sequence(head_c, head_c + usable - F.lit(length)))
        df = df.select("*", F.explode(starts).alias("__first"))
    else:
        raise ValueError(f"unknown chunk strategy {strategy!r}")

    df = df.withColumns(
        {"start_ns": frame_ns(F.col("__first"), fps), "end_ns": frame_ns(F.col("__first") + F.lit(length - 1), fps)}
    )
    if anomalies is not None and spec.remove_anomalies is not None:
        df = df.where(~blocked(F.col("start_ns"), F.col("end_ns"), F.col(anomalies), spec.remove_anomalies))
    if strategy == "random":
        draw = rank if rank is not None else F.xxhash64(*keys, F.col("__first"), F.lit(spec.seed))
        order = Window.partitionBy(*keys).orderBy(draw, F.col("__first"))
        df = df.withColumn("__draw", F.row_number().over(order))
        kept = F.lit(spec.per_recording) if spec.per_recording is not None else floor_div(usable, length)
        df = df.where(F.col("__draw") <= kept).withColumn("chunk_number", F.col("__draw").cast("long") - 1).drop("__draw")
    return df.drop("__total", "__first")


def rows_in_chunks(
    rows: DataFrame,
    recordings: DataFrame,
    spec: ChunkSpec,
    keys: Sequence[str],
    time: str = "t_ns",
    start: str = "start_time",
    end: str = "end_time",
    anomalies: str | None = None,
    slot: int = 600 * SECOND,
) -> DataFrame:
    """Sensor rows with the number of every ``start``/``end`` chunk they belong to.

    The chunk numbers follow from the row's time by arithmetic, so the only join
    is rows with their recording's few fields, spread by time slots of ``slot``; there is no
    range join. The closed bounds are checked afterwards because a row's clock may differ from the chunk grid.
    """
    if spec.strategy not in ("start", "end") or not spec.fps:
        raise ValueError("rows_in_chunks serves regular chunks; use rows_in_intervals otherwise")
    fps, length, stride = spec.fps, spec.frames(spec.duration), spec.frames(spec.stride)
    head, tail = spec.frames(spec.start_offset), spec.frames(spec.end_offset)
    total = frame_count(F.col(start), F.col(end), fps)
    head_c = F.lit(head).cast("long") if head >= 0 else total + F.lit(head)
    tail_c = F.lit(tail).cast("long") if tail >= 0 else total + F.lit(tail)
    count = F.greatest(F.lit(0).cast("long"), floor_div(total - head_c - tail_c - F.lit(length), stride) + 1)
    if spec.per_recording is not None:
        count = F.least(count, F.lit(spec.per_recording).cast("long"))
    base = head_c if spec.strategy == "start" else total - tail_c - F.lit(length)
    few = recordings.select(
        *keys, count.alias("__count"), base.alias("__base"), *([F.col(anomalies).alias("__anomalies")] if anomalies else [])
    ).where(F.col("__count") > 0)

    frame = floor_div(F.col(time) * F.lit(fps), SECOND)
    offset = (frame - F.col("__base")) if spec.strategy == "start" else (F.col("__base") - frame)
    # chunk k covers frames base±k*stride .. +length-1; one frame of slack on both sides
    if spec.strategy == "start":
        low, high = floor_div(offset - F.lit(length + 1), stride), floor_div(offset + 1, stride) + 1
    else:
        low, high = floor_div(offset - 1, stride), floor_div(offset + F.lit(length + 1), stride) + 1
    low, high = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.col("__count") - 1)
    joined = join_few(rows, few, keys, bin=time_bin(time, slot))
    spread = joined.select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("chunk_number"))
    step = F.col("chunk_number") * F.lit(stride)
    first = F.col("__base") + step if spec.strategy == "start" else F.col("__base") - step
    out = spread.withColumns(
        {"start_ns": frame_ns(first, fps), "end_ns": frame_ns(first + F.lit(length - 1), fps)}
    ).where(F.col(time).between(F.col("start_ns"), F.col("end_ns")))
    if anomalies and spec.remove_anomalies is not None:
        out = out.where(~blocked(F.col("start_ns"), F.col("end_ns"), F.col("__anomalies"), spec.remove_anomalies))
    return out.drop("__count", "__base", "__anomalies")


def rows_in_intervals(
    rows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    slot: int,
    closed_end: bool = True,
) -> DataFrame:
    """Range join on time slots: an interval is listed under every slot it covers, a row under one.

    Choose ``slot`` near the usual interval length; each interval then has a couple of entries.
    """
    listed = intervals.withColumn(
        "__slot",
        F.explode(F.sequence(F.floor(F.col(start) / slot).cast("long"), F.floor(F.greatest(F.col(start), F.col(end)) / slot).cast("long"))),
    )
    slotted = rows.withColumn("__slot", F.floor(F.col(time) / slot).cast("long"))
    upper = F.col(time) <= F.col(end) if closed_end else F.col(time) < F.col(end)
    return slotted.join(listed, [*keys, "__slot"]).where((F.col(time) >= F.col(start)) & upper).drop("__slot")


def attributes_in_chunks(
    attributes: DataFrame, chunks: DataFrame, keys: Sequence[str], slot: int, start: str = "start_epoch_ns", end: str = "end_epoch_ns"
) -> DataFrame:
    """Attributes valid at some time of each chunk; a table without validity columns holds for every chunk."""
    if start in attributes.columns and end in attributes.columns:
        return overlapping(attributes, chunks, keys, (start, end), ("start_ns", "end_ns"), slot)
    return attributes.join(chunks, list(keys))


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], slot: int
) -> DataFrame:
    """Pairs of closed intervals that touch, each pair once, by shared time slots."""

    def listed(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        first = F.floor(F.col(span[0]) / slot).cast("long")
        last = F.floor(F.col(span[1]) / slot).cast("long")
        return df.where(F.col(span[0]) <= F.col(span[1])).select("*", first.alias(name), F.explode(F.sequence(first, last)).alias("__slot"))

    a, b = listed(left, left_span, "__a"), listed(right, right_span, "__b")
    touch = (F.col(right_span[0]) <= F.col(left_span[1])) & (F.col(right_span[1]) >= F.col(left_span[0]))
    once = F.col("__slot") == F.greatest("__a", "__b")
    return a.join(b, [*keys, "__slot"]).where(touch & once).drop("__slot", "__a", "__b")
