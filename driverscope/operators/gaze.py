"""Eye tracking: areas of interest, entropy, fixations, saccades, gaze on frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.functions.frames import pixel_at
from driverscope.functions.geometry import gaze_pixel
from driverscope.operators.chunks import rows_in_intervals
from driverscope.operators.ordered import halo, neighbour, row_index, running, time_bin
from driverscope.operators.sequential import scan_blocks
from driverscope.session import settle

SECOND = 1_000_000_000
# Viewing distance in mm, and the angles and durations of the detectors.
VIEWING_MM = 650.0
FIXATION_MM = VIEWING_MM * math.tan(math.radians(2))
FIXATION_MS = 100.0
SACCADE_MM_S = VIEWING_MM * math.tan(math.radians(30))
SACCADE_MM_S2 = VIEWING_MM * math.tan(math.radians(8000))
SACCADE_MS = 5.0


def area_of_interest(x: Column, y: Column, grid_x: int, grid_y: int) -> Column:
    """Cell number (row by row) of a point on the unit screen; NULL outside or missing."""

    def cell(v: Column, n: int) -> Column:
        return F.least(F.floor(v * n), F.lit(n - 1)).cast("int")

    inside = x.between(0.0, 1.0) & y.between(0.0, 1.0)
    return F.when(inside, cell(y, grid_y) * grid_x + cell(x, grid_x))


def _entropy(counts: Sequence[Column]) -> Column:
    """-sum p log2 p of a few counts."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, c / total * F.log2(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return F.when(total > 0, -sum(terms[1:], terms[0]) + 0.0)


def _transition_entropy(counts: Sequence[Column], moves: Sequence[Sequence[Column]]) -> Column:
    """-sum over areas of their share times sum p(to|from) log2 p(to|from)."""
    total = sum(counts[1:], counts[0])
    parts = [
        c / total * F.coalesce(_entropy(row), F.lit(0.0))
        for c, row in zip(counts, moves)
    ]
    return F.when(total > 0, sum(parts[1:], parts[0]))


def rolling_entropy(
    gaze: DataFrame, keys: Sequence[str], area: str, areas: int, window: int, slot: int, stride: int = 1, time: str = "t_ns", segment: int | None = None
) -> DataFrame:
    """Stationary and transition entropy of the ``window`` rows before each row.

    The first ``window`` rows stay NULL. Rows are cut into position segments with the
    needed rows copied over, and window counts are differences of running counts, so the
    cost per row does not grow with the window and no task holds a recording.
    """
    size = segment or max(4 * window, 2000)
    numbered = row_index(gaze, keys, time_bin(time, slot), [time], "__row")
    placed = halo(numbered, F.col("__row"), size, look_back=window + 1)
    w = Window.partitionBy(*keys, "segment").orderBy("__row")
    placed = placed.withColumn("__from", F.lag(area).over(w))
    flags = {f"c{a}": F.col(area) == a for a in range(areas)}
    flags |= {f"m{a}_{b}": (F.col("__from") == a) & (F.col(area) == b) for a in range(areas) for b in range(areas)}
    upto = placed.withColumns({f"__{n}": F.count_if(e).over(w) for n, e in flags.items()})

    def counted(name: str, skip: int) -> Column:
        """Rows -window+skip .. -1. A move belongs to the later of its two rows, so the first row's is skipped."""
        return F.lag(f"__{name}", 1).over(w) - F.coalesce(F.lag(f"__{name}", window + 1 - skip).over(w), F.lit(0))

    windowed = upto.withColumns({f"w_{n}": counted(n, 1 if n[0] == "m" else 0) for n in flags})
    counts = [F.col(f"w_c{a}") for a in range(areas)]
    moves = [[F.col(f"w_m{a}_{b}") for b in range(areas)] for a in range(areas)]
    ready = (F.col("__row") >= window) & ((F.col("__row") - window) % stride == 0)
    return windowed.where("is_own").select(
        *gaze.columns,
        F.when(ready, _entropy(counts)).alias("stationary_entropy"),
        F.when(ready, _transition_entropy(counts, moves)).alias("transition_entropy"),
    )


def recording_entropy(gaze: DataFrame, keys: Sequence[str], area: str, areas: int, slot: int, time: str = "t_ns") -> DataFrame:
    """The same two entropies over whole recordings, from counts of areas and moves."""
    moved = neighbour(gaze, keys, time_bin(time, slot), [time], {"__from": F.col(area)})
    flags = {f"c{a}": F.col(area) == a for a in range(areas)}
    flags |= {f"m{a}_{b}": (F.col("__from") == a) & (F.col(area) == b) for a in range(areas) for b in range(areas)}
    counted = moved.groupBy(*keys).agg(*[F.count_if(e).alias(n) for n, e in flags.items()])
    counts = [F.col(f"c{a}") for a in range(areas)]
    moves = [[F.col(f"m{a}_{b}") for b in range(areas)] for a in range(areas)]
    return counted.select(
        *keys, _entropy(counts).alias("stationary_entropy"), _transition_entropy(counts, moves).alias("transition_entropy")
    )


def fixation_saccade_ratio(
    rows: DataFrame, keys: Sequence[str], slot: int, window_s: float = 5.0, fps: int = 60, step: int = 1, time: str = "t_ns", segment: int | None = None
) -> DataFrame:
    """Fixation to saccade rows, and the reverse, over the window before each row.

    NULL for the first window and where the divisor is 0. With ``step`` above 1 a
    value is computed every ``step`` rows and holds until the next.
    """
    n = int(window_s * fps)
    size = segment or max(4 * n, 2000)
    numbered = row_index(rows, keys, time_bin(time, slot), [time], "__row")
    start = F.col("__row") - F.pmod(F.col("__row") - n, F.lit(step))
    placed = halo(numbered, F.col("__row"), size, look_back=n + step).withColumn("__start", start)
    w = Window.partitionBy(*keys, "segment").orderBy("__row")
    frame = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = placed.withColumns({f"__u_{c}": F.sum(c).over(frame) for c in ("fixation", "saccade")})
    sums = upto.withColumns(
        {f"__w_{c}": F.lag(f"__u_{c}", 1).over(w) - F.coalesce(F.lag(f"__u_{c}", n + 1).over(w), F.lit(0)) for c in ("fixation", "saccade")}
    )
    if step > 1:
        block = Window.partitionBy(*keys, "segment", "__start").orderBy("__row")
        at_start = {f"__w_{c}": F.first(F.when(F.col("__row") == F.col("__start"), F.col(f"__w_{c}")), ignorenulls=True).over(block) for c in ("fixation", "saccade")}
        sums = sums.withColumns(at_start)
    ready, f, s = F.col("__row") >= n, F.col("__w_fixation"), F.col("__w_saccade")
    return sums.where("is_own").select(
        *rows.columns,
        F.when(ready, F.try_divide(f, s)).alias("fixation_saccade_ratio"),
        F.when(ready, F.try_divide(s, f)).alias("saccade_fixation_ratio"),
    )


def mark_intervals(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], name: str, slot: int, time: str = "t_ns") -> DataFrame:
    """1 for rows inside any interval, else 0; rows of one key and time share the answer."""
    of = F.struct(*keys).alias("__of")
    hits = rows_in_intervals(rows.select(of, time), intervals.select(of, "start", "end"), ["__of"], time, "start", "end", slot)
    # keys and time meet as one value, whose NULL fields are equal
    flagged = hits.select(F.struct("__of", time).alias("__at")).distinct().withColumn(name, F.lit(1))
    marked = rows.withColumn("__at", F.struct(of, time)).join(flagged, "__at", "left").drop("__at")
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def detect_saccades(
    gaze: DataFrame,
    keys: Sequence[str],
    slot: int,
    x: str = "x_mm",
    y: str = "y_mm",
    time: str = "t_ns",
    max_velocity: float = SACCADE_MM_S,
    max_acceleration: float = SACCADE_MM_S2,
    min_ms: float = SACCADE_MS,
) -> DataFrame:
    """Intervals of fast movement: speed or its increase per sample over the limit.

    An interval runs from the sample before the first fast step to the last fast sample.
    Missing samples (NULL) are passed over.
    """
    seen = gaze.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, time, x, y)
    # four consecutive samples decide a row, so rows are numbered once and cut into overlapping segments
    numbered = row_index(seen, keys, time_bin(time, slot), [time], "__row")
    placed = halo(numbered, F.col("__row"), 4096, look_back=3, look_ahead=1)
    w = Window.partitionBy(*keys, "segment").orderBy("__row")
    moved = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    elapsed = (F.col(time) - F.lag(time).over(w)) / F.lit(1e9)
    speeds = placed.withColumns({"__v": F.try_divide(moved, elapsed), "__before": F.lag(time).over(w)})
    gained = F.col("__v") - F.lag("__v").over(w)
    fast = F.coalesce(F.col("__v") > max_velocity, F.lit(False)) | F.coalesce(gained > max_acceleration, F.lit(False))
    flagged = speeds.withColumn("__fast", fast)
    beside = {"__was": F.lag("__fast").over(w), "__will": F.lead("__fast").over(w)}
    edges = flagged.withColumns(beside).where(F.col("is_own") & F.col("__fast"))
    edges = edges.select(
        *keys,
        time,
        F.when(~F.coalesce(F.col("__was"), F.lit(False)), F.col("__before")).alias("__start"),
        (~F.coalesce(F.col("__will"), F.lit(False))).alias("__ends"),
    ).where(F.col("__start").isNotNull() | F.col("__ends"))
    # runs are few next to samples: settle their ends, then give each end the latest start
    spans = running(settle(edges), keys, time_bin(time, slot), [time], lasts={"start": F.col("__start")})
    spans = spans.where("__ends").select(*keys, "start", F.col(time).alias("end"))
    return spans.where((F.col("end") - F.col("start")) / 1e6 >= min_ms)


class FixationMachine:
    """Anchored fixations as a machine that can be cut into blocks.

    Between fixations the anchor is the sample before; a sample near it begins a fixation and becomes its anchor; the
    first sample further than ``max_distance`` from the anchor ends it. What a block does to a fixation
    that comes in depends on the first of its samples that lies outside the disc around the anchor. The
    samples before that one lie inside, and so does their convex hull: it is a sample that extends the hull of
    those before it. The summary lists these few samples with the state at the block's end after each.
    """

    STATE = np.dtype([("kind", "i8"), ("x", "f8"), ("y", "f8"), ("began", "i8"), ("last", "i8")])
    RECORD = np.dtype(STATE.descr + [("sx", "f8"), ("sy", "f8")])
    START, BETWEEN, INSIDE = 0, 1, 2

    def __init__(self, time: str, x: str, y: str, max_distance: float, min_ns: float) -> None:
        self.names, self.reach, self.least = (time, x, y), max_distance, min_ns

    def begin(self) -> bytes:
        return np.zeros(1, self.STATE).tobytes()

    def _open(self, block) -> tuple:
        """Times, positions as arrays and as lists."""
        t, x, y = (block[n] for n in self.names)
        return t.tolist(), x, y, x.tolist(), y.tolist()

    def _leaves(self, opened: tuple, px: float, py: float, start: int) -> int:
        """First sample from ``start`` outside the disc around (px, py), or their number.

        Most stays are short, so a few samples are looked at one by one before whole stretches are.
        """
        _, x, y, xs, ys = opened
        soon = min(start + 32, len(xs))
        for k in range(start, soon):
            dx, dy = xs[k] - px, ys[k] - py
            if math.sqrt(dx * dx + dy * dy) > self.reach:
                return k
        size = 256
        while soon < len(xs):
            out = np.sqrt((x[soon : soon + size] - px) ** 2 + (y[soon : soon + size] - py) ** 2) > self.reach
            if out.any():
                return soon + int(np.argmax(out))
            soon, size = soon + size, 2 * size
        return len(xs)

    def _next(self, opened: tuple, j: int) -> int:
        """First sample after ``j`` that is near the one before it: there a fixation begins. 0 if none does."""
        _, _, _, xs, ys = opened
        for k in range(j + 1, len(xs)):
            dx, dy = xs[k] - xs[k - 1], ys[k] - ys[k - 1]
            if math.sqrt(dx * dx + dy * dy) <= self.reach:
                return k
        return 0

    def _exit(self, opened: tuple, j: int, seen: dict[int, tuple]) -> tuple:
        """State at the block's end, if no fixation runs at sample ``j``; (kind, x, y, began)."""
        t, _, _, xs, ys = opened
        passed = []
        while j not in seen:
            passed.append(j)
            begin = self._next(opened, j)
            if not begin:
                seen[j] = (self.BETWEEN, xs[-1], ys[-1], 0)
                break
            left = self._leaves(opened, xs[begin], ys[begin], begin + 1)
            if left == len(xs):
                seen[j] = (self.INSIDE, xs[begin], ys[begin], t[begin])
                break
            j = left
        for k in passed:
            seen[k] = seen[j]
        return seen[j]

    def summary(self, block) -> bytes:
        """Header (last time, first sample's state as an anchor), then the samples that extend the hull, each with its exit."""
        opened = t, x, y, xs, ys = self._open(block)
        seen: dict[int, tuple] = {}
        left = self._leaves(opened, xs[0], ys[0], 1)
        own = (self.INSIDE, xs[0], ys[0], t[0]) if left == len(xs) else self._exit(opened, left, seen)
        rows = [(*own, t[-1], xs[0], ys[0])]
        rows += [(*self._exit(opened, k, seen), t[-1], xs[k], ys[k]) for k in hull_records(x, y, 2 * self.reach)]
        return np.array(rows, self.RECORD).tobytes()

    def advance(self, state: bytes, summary: bytes) -> bytes:
        now = np.frombuffer(state, self.STATE)[0]
        rows = np.frombuffer(summary, self.RECORD)
        out = np.sqrt((rows["sx"] - now["x"]) ** 2 + (rows["sy"] - now["y"]) ** 2) > self.reach
        if now["kind"] == self.BETWEEN and not out[0]:
            found = rows[0]
        elif now["kind"] != self.INSIDE:
            found = rows[1]
        else:
            found = rows[1 + int(np.argmax(out[1:]))] if out[1:].any() else now
        exit = np.zeros(1, self.STATE)
        for name in ("kind", "x", "y", "began"):
            exit[name] = found[name]
        exit["last"] = rows["last"][0]
        return exit.tobytes()

    def run(self, state: bytes, block, last: bool):
        opened = t, _, _, xs, ys = self._open(block)
        kind, px, py, entered, seen = np.frombuffer(state, self.STATE)[0].item()
        found: list[tuple[int, int]] = []

        def inside(px: float, py: float, began: int, start: int) -> int:
            """Where the fixation ends that began at ``began``."""
            left = self._leaves(opened, px, py, start)
            if left < len(xs) or last:
                ended = t[left - 1] if left else seen
                if ended - began >= self.least:
                    found.append((began, ended))
            return left

        j = 0
        if kind == self.INSIDE:
            j = inside(px, py, entered, 0)
        elif kind == self.BETWEEN and math.sqrt((xs[0] - px) * (xs[0] - px) + (ys[0] - py) * (ys[0] - py)) <= self.reach:
            j = inside(xs[0], ys[0], t[0], 1)
        while j < len(xs) and (begin := self._next(opened, j)):
            j = inside(xs[begin], ys[begin], t[begin], begin + 1)
        spans = np.array(found, np.int64).reshape(-1, 2)
        return np.zeros(len(spans), int), {"start": spans[:, 0], "end": spans[:, 1]}


def convex(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of a few points, counter-clockwise."""
    rows = sorted({(float(a), float(b)) for a, b in points})

    def chain(row):
        out: list[tuple[float, float]] = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(rows if len(rows) < 3 else chain(rows) + chain(rows[::-1]))


def hull_records(x: np.ndarray, y: np.ndarray, enough: float) -> list[int]:
    """All samples outside the convex hull of those before them, up to the first with another further away than ``enough``.

    The first few samples are listed as they come. Then the hull is taken from the inside, by the furthest samples in sixteen
    directions, renewed while ever longer stretches are tested at once. So some samples inside the true
    hull are listed as well, which does no harm.
    """
    first, ax, ay = min(16, len(x)), float(x[0]), float(y[0])
    for k, (bx, by) in enumerate(zip(x[:first].tolist(), y[:first].tolist())):
        if math.hypot(bx - ax, by - ay) > enough * 1.001:
            return list(range(k + 1))
    if first == len(x):
        return list(range(first))
    turns = np.arange(16) * (math.pi / 8)
    ways = np.stack([np.cos(turns), np.sin(turns)])
    points = np.stack([x, y], axis=1)
    found, corners, size = list(range(first)), convex(points[:first]), first
    while first < len(points):
        now = points[first : first + size]
        (ax, ay), (bx, by) = corners[0], corners[-1]
        if len(corners) < 3:
            aside = (bx - ax) * (now[:, 1] - ay) != (by - ay) * (now[:, 0] - ax)
            out = aside | (now < corners.min(axis=0)).any(axis=1) | (now > corners.max(axis=0)).any(axis=1)
        else:
            along = np.roll(corners, -1, axis=0) - corners
            away = now[:, None, :] - corners[None, :, :]
            out = (along[:, 0] * away[:, :, 1] < along[:, 1] * away[:, :, 0]).any(axis=1)
        far = np.sqrt(((now[:, None, :] - corners[None, :, :]) ** 2).sum(axis=2)).max(axis=1) > enough * 1.001
        if far.any():
            return found + (first + np.flatnonzero(out[: int(np.argmax(far)) + 1])).tolist()
        found += (first + np.flatnonzero(out)).tolist()
        if out.any():
            known = np.concatenate([corners, now[out]])
            corners = convex(known[np.unique(np.argmax(known @ ways, axis=0))])
        first, size = first + size, min(2 * size, 512)
    return found


def detect_fixations(
    gaze: DataFrame,
    keys: Sequence[str],
    slot: int,
    x: str = "x_mm",
    y: str = "y_mm",
    time: str = "t_ns",
    max_distance: float = FIXATION_MM,
    min_ms: float = FIXATION_MS,
) -> DataFrame:
    """Intervals in which the gaze stays within ``max_distance`` of where the fixation began.

    The anchor makes this sequential: recordings are cut into blocks of ``slot``, which run side by side once their
    entry states are known (``scan_blocks``); the result is that of one pass over the whole recording,
    also for a gaze that never moves. Samples without position or time take no part; samples of one time go in
    the order of their position.
    """
    seen = gaze.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(time).isNotNull())
    seen = seen.select(*keys, F.col(time).cast("long").alias(time), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    machine = FixationMachine(time, x, y, max_distance, min_ms * 1e6)
    spans = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    return scan_blocks(seen, keys, time_bin(time, slot), [time, x, y], [time, x, y], machine, keys, spans)


def value_at_gaze(frames: DataFrame, gaze: DataFrame, keys: Sequence[str], pixels: str, width: int, height: int, x: str, y: str, out: str) -> DataFrame:
    """Frame value under the gaze of the same time; NULL off screen, without gaze or without value.

    ``keys`` hold the recording and the time, so the join spreads evenly.
    """
    px, py = gaze_pixel(F.col(x), width), gaze_pixel(F.col(y), height)
    value = pixel_at(F.col(pixels), width, px, py)
    return gaze.join(frames.select(*keys, pixels), list(keys), "left").withColumn(out, value).drop(pixels)


def latest_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: int, values: Sequence[str], tie: str, time: str = "t_ns", slot: int | None = None
) -> DataFrame:
    """Newest right row at or before each left row, at most ``tolerance`` old, with possibly missing values.

    Right rows are listed under their time slot and, when their tolerance reaches over,
    the next; each (key, slot) is then one small ordered pass. Right columns
    come out with the prefix ``latest_``. A missing value in the newest row stays missing.
    """
    size = max(slot or 0, tolerance, 1)
    left_rows = left.select("*", F.floor(F.col(time) / size).cast("long").alias("__slot"), F.lit(1).alias("__side"))
    packed = F.struct(F.col(time).alias("__at"), *values)
    listed = right.select(
        *keys,
        time,
        F.col(tie).alias("__tie"),
        packed.alias("__r"),
        F.explode(F.sequence(F.floor(F.col(time) / size).cast("long"), F.floor((F.col(time) + F.lit(tolerance)) / size).cast("long"))).alias("__slot"),
        F.lit(0).alias("__side"),
    )
    both = left_rows.unionByName(listed, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__slot").orderBy(time, "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__f", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    fresh = F.col(time) - F.col("__f")["__at"] <= tolerance
    return found.select(
        *left.columns,
        F.when(fresh, F.col("__f")["__at"]).alias("latest_time"),
        *[F.when(fresh, F.col("__f")[v]).alias(f"latest_{v}") for v in values],
    )


def gaze_in_frames(gaze: DataFrame, frames: DataFrame, keys: Sequence[str], slot: int, frame: str = "frame", time: str = "t_ns") -> DataFrame:
    """Gaze rows with the frame on screen: frame time <= gaze time < next frame's time.

    Frames and gaze are merged on the time axis and the last frame is carried forward slot by
    slot; nothing is on screen from the last frame's start on.
    """
    bin = time_bin(time, slot)
    shown = neighbour(frames.select(*keys, time, frame), keys, bin, [time], {"__next": F.col(time)}, following=True)
    marks = shown.select(*keys, time, F.lit(0).alias("__side"), F.struct(F.col(frame), F.col("__next")).alias("__frame"))
    both = gaze.withColumn("__side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    extra = [c for c in gaze.columns if c not in (*keys, time)]
    merged = running(both, keys, bin, [time, "__side", *extra], lasts={"__on": F.col("__frame")})
    return merged.where(F.col("__side") == 1).where(F.col("__on")["__next"] > F.col(time)).select(
        *gaze.columns, F.col("__on")[frame].alias(frame)
    )


def frame_pixel(fraction: Column, size: int, mirrored: bool = False) -> Column:
    """Drawing position of a gaze fraction, cut to whole pixels; the face camera shows x mirrored."""
    position = (fraction * size).cast("int")
    return F.lit(size) - position if mirrored else position


def complete_gaze(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without rows that miss any gaze coordinate."""
    return rows.na.drop(subset=list(columns))


def both_eyes(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Results of both eyes side by side with an eye prefix."""

    def named(df: DataFrame, eye: str) -> DataFrame:
        return df.select(*keys, *[F.col(n).alias(f"gaze_{eye}_{n}") for n in names])

    return named(left, "left").join(named(right, "right"), list(keys), "full")
