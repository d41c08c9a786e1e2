"""Steering: smoothing, turning points, reversals; ego kinematics by local fits."""

from __future__ import annotations

import itertools
import math
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driverscope.functions.geometry import quaternion_yaw
from driverscope.operators import splines
from driverscope.operators.ordered import around, halo, row_index, time_bin
from driverscope.operators.sequential import map_groups, scan_blocks
from driverscope.session import settle

EDGE_ROWS = 9
PRECISION = 1e-18


def butterworth_low_pass(cutoff: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order low-pass coefficients (b, a) by the bilinear transform."""
    k = math.tan(math.pi * cutoff / fps)
    norm = 1.0 / (1.0 + math.sqrt(2.0) * k + k * k)
    b = np.array([1.0, 2.0, 1.0]) * (k * k * norm)
    a = np.array([1.0, 2.0 * (k * k - 1.0) * norm, (1.0 - math.sqrt(2.0) * k + k * k) * norm])
    return b, a


def impulse_response(cutoff: float, fps: float) -> np.ndarray:
    """The filter's response until it falls below double precision."""
    b, a = butterworth_low_pass(cutoff, fps)
    radius = math.sqrt(a[2])
    length = max(8, math.ceil(math.log(PRECISION) / math.log(radius))) if radius > 0 else 8
    h = np.zeros(length)
    for i in range(length):
        h[i] = (b[i] if i < 3 else 0.0) - sum(a[j] * h[i - j] for j in (1, 2) if i >= j)
    return h


def _one_way(values: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Filter as if the first value had lasted forever (steady state)."""
    pad = len(response)
    return np.convolve(np.concatenate([np.full(pad, values[0]), values]), response)[pad : pad + len(values)]


def filter_both_ways(values: np.ndarray, response: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
    """Forward and backward pass; recording ends are extended by point reflection."""
    head = 2 * values[0] - values[EDGE_ROWS:0:-1] if at_start else values[:0]
    tail = 2 * values[-1] - values[-2 : -EDGE_ROWS - 2 : -1] if at_end else values[:0]
    forward = _one_way(np.concatenate([head, values, tail]), response)
    both = _one_way(forward[::-1], response)[::-1]
    return both[len(head) : len(head) + len(values)]


def smooth_low_pass(
    rows: DataFrame, keys: Sequence[str], value: str, slot: int, cutoff: float = 2.0, fps: float = 10.0, time: str = "t_ns", out: str = "smoothed", segment: int = 6000
) -> DataFrame:
    """Zero-phase low-pass. Recordings of at most nine rows have no result.

    The response dies out within a known number of rows, so a recording is cut into
    segments that overlap by twice that number: the same values as one pass over all rows, to
    rounding, without ever holding a whole recording.
    """
    response = impulse_response(cutoff, fps)
    reach = 2 * len(response) + EDGE_ROWS
    size = max(segment, 2 * reach)
    # rows of one time go in the order of their values; every row keeps its other columns, so nothing is joined back
    numbered = row_index(rows, keys, time_bin(time, slot), [time, value], "__row", "__length")
    placed = halo(numbered, F.col("__row"), size, reach, reach)

    def smooth(piece: dict[str, np.ndarray]):
        row, own, length = piece["__row"], piece["is_own"].astype(bool), piece["__length"][0]
        if length <= EDGE_ROWS:
            result = np.full(len(row), np.nan)
        else:
            result = filter_both_ways(piece[value].astype(float), response, row[0] == 0, row[-1] == length - 1)
        return np.flatnonzero(own), {out: result[own]}

    needed = ["__row", "__length", "is_own", value]
    return map_groups(placed, [*keys, "segment"], ["__row"], needed, smooth, rows.columns, [T.StructField(out, T.DoubleType())])


def stationary_points(rows: DataFrame, keys: Sequence[str], value: str, slot: int, time: str = "t_ns", out: str = "is_stationary") -> DataFrame:
    """Flat steps and local maxima: the step into the row is 0, or up and followed by down."""
    beside = around(rows, keys, time_bin(time, slot), [time], [value], "__prev", "__next")
    step_in, step_out = F.col(value) - F.col("__prev")[value], F.col("__next")[value] - F.col(value)
    flat = F.coalesce(step_in == 0, F.lit(False))
    peak = F.coalesce((step_in > 0) & (step_out < 0), F.lit(False))
    return beside.withColumn(out, flat | peak).drop("__prev", "__next")


class ReversalMachine:
    """Steering reversals as a machine that can be cut into blocks.

    A reference level per direction follows the signal while it moves away and jumps to it once it has come
    back by ``theta``: a reversal. Until its first reversal in a block a level only falls to the lowest value so far, and
    that reversal comes at the first value that is ``theta`` above the level on entry, or above an earlier
    value of the block. The first kind are values higher than all before them; so the summary lists these, up to
    the first of the second kind, each with the level at the block's end after a reversal there.
    """

    def __init__(self, value: str, theta: float, out: str) -> None:
        self.value, self.theta, self.out = value, theta, out

    def begin(self) -> bytes:
        return np.full(2, np.inf).tobytes()

    def _next(self, x: np.ndarray, xs: list[float], level: float, start: int) -> tuple[int, float]:
        """(first reversal from ``start`` on, or the number of values; the level there or at the end)."""
        soon = min(start + 32, len(xs))
        for k in range(start, soon):  # most come soon
            v = xs[k]
            if v - level >= self.theta:
                return k, v
            if v < level:
                level = v
        size = 256
        while soon < len(xs):
            now = x[soon : soon + size]
            low = np.minimum.accumulate(np.concatenate([[level], now]))
            hit = now - low[:-1] >= self.theta
            if hit.any():
                at = int(np.argmax(hit))
                return soon + at, float(now[at])
            soon, size, level = soon + size, 2 * size, float(low[-1])
        return len(xs), level

    def _exit(self, x: np.ndarray, xs: list[float], j: int, seen: dict[int, float]) -> float:
        """Level at the block's end after a reversal at ``j``."""
        passed = []
        while j not in seen:
            passed.append(j)
            after, level = self._next(x, xs, xs[j], j + 1)
            if after == len(xs):
                seen[j] = level
                break
            j = after
        for k in passed:
            seen[k] = seen[j]
        return seen[j]

    def summary(self, block) -> bytes:
        """Per direction: number of records, lowest value, then (value, level at the end) of each record."""
        parts: list[float] = []
        for x in (block[self.value], -block[self.value]):
            xs = x.tolist()
            certain, _ = self._next(x, xs, math.inf, 0)
            seen: dict[int, float] = {}
            records: list[tuple[float, float]] = []
            high = -math.inf
            for k in range(min(certain + 1, len(xs))):
                if xs[k] > high:
                    high, end = xs[k], self._exit(x, xs, k, seen)
                    # a level that reaches this value reaches an earlier one first; if both end alike the higher says it all
                    if records and records[-1][1] == end:
                        records.pop()
                    records.append((high, end))
            if certain < len(xs):  # none gets past it
                records.append((math.inf, self._exit(x, xs, certain, seen)))
            parts += [len(records), min(xs), *itertools.chain.from_iterable(records)]
        return array("d", parts).tobytes()

    def advance(self, state: bytes, summary: bytes) -> bytes:
        levels, parts = np.frombuffer(state).copy(), np.frombuffer(summary)
        for side in range(2):
            size = int(parts[0])
            records, low = parts[2 : 2 + 2 * size].reshape(-1, 2), parts[1]
            reached = np.flatnonzero(records[:, 0] - levels[side] >= self.theta) if np.isfinite(levels[side]) else np.flatnonzero(records[:, 0] == np.inf)
            levels[side] = records[reached[0], 1] if len(reached) else min(levels[side], low)
            parts = parts[2 + 2 * size :]
        return levels.tobytes()

    def run(self, state: bytes, block, last: bool):
        hits = np.zeros(len(block[self.value]), np.int32)
        for level, x in zip(np.frombuffer(state).tolist(), (block[self.value], -block[self.value])):
            xs = x.tolist()
            j, level = self._next(x, xs, level, 0)
            while j < len(xs):
                hits[j] = 1
                j, level = self._next(x, xs, level, j + 1)
        return np.arange(len(hits)), {self.out: hits}


def with_reversals(still: DataFrame, keys: Sequence[str], value: str, theta: float, slot: int, time: str = "t_ns", out: str = "reversal") -> DataFrame:
    """Stationary points with 1 where the wheel has turned back by ``theta``, in either direction, else 0.

    Runs in blocks of ``slot`` side by side, however smooth the signal. Points of one time go in the order of their
    values; every column is kept.
    """
    rows = still.withColumn("__value", F.col(value).cast("double"))
    flag = T.StructField(out, T.IntegerType())
    return scan_blocks(rows, keys, time_bin(time, slot), [time, "__value"], ["__value"], ReversalMachine("__value", theta, out), still.columns, [flag])


def steering_reversals(rows: DataFrame, keys: Sequence[str], value: str, theta: float, slot: int, time: str = "t_ns") -> DataFrame:
    """Times of the stationary points where the wheel has turned back by ``theta``, once each."""
    return with_reversals(rows.select(*keys, time, value), keys, value, theta, slot, time, "__hit").where("__hit = 1").select(*keys, time).distinct()


def mark_reversals(rows: DataFrame, keys: Sequence[str], value: str, thetas: Sequence[float], slot: int, time: str = "t_ns") -> DataFrame:
    """0/1 column per threshold, named like ``reversals_0_5``. Rows keep all columns; nothing is joined back."""
    names = {theta: f"reversals_{theta}".replace(".", "_") for theta in thetas}
    flagged = stationary_points(rows, keys, value, slot, time, "__still")
    # turning points are few next to samples, and every threshold starts from them
    marked = settle(flagged.where("__still").drop("__still"))
    for theta, name in names.items():
        marked = with_reversals(marked, keys, value, theta, slot, time, name)
    rest = flagged.where("NOT __still").drop("__still")
    return rest.withColumns({name: F.lit(0) for name in names.values()}).unionByName(marked)


KINEMATICS = [f"{axis}_{kind}" for kind in ("speed", "acceleration", "jerk") for axis in ("lateral", "longitudinal")]


def local_derivatives(t_ns: np.ndarray, x: np.ndarray, y: np.ndarray, yaw: np.ndarray, wanted: np.ndarray, half_s: float, smoothing: bool = True) -> np.ndarray:
    """First to third derivative at each wanted row of a cosine-weighted cubic fit in the row's own heading.

    Returns rows x 6, ordered as KINEMATICS; NaN where fewer than four points carry weight. All rows' cubics are solved
    at once. With ``smoothing``, a row whose weighted squared distance is over the spline call's bound takes
    a smoothing spline with knots instead; on a road that is rare, as a cubic follows five seconds of driving.
    """
    rows = np.flatnonzero(wanted)
    half = int(half_s * 1e9)
    low = np.searchsorted(t_ns, t_ns[rows] - half, "left")
    high = np.searchsorted(t_ns, t_ns[rows] + half, "right")
    width = int((high - low).max()) if len(rows) else 0
    at = low[:, None] + np.arange(width)[None, :]
    inside = at < high[:, None]
    at = np.where(inside, at, rows[:, None])
    tau = (t_ns[at] - t_ns[rows][:, None]) / 1e9
    weight = np.where(inside, np.cos(tau / half_s * (math.pi / 2)), 0.0)
    weight[weight < 1e-9] = 0.0
    c, s = np.cos(yaw[rows])[:, None], np.sin(yaw[rows])[:, None]
    dx, dy = x[at] - x[low][:, None], y[at] - y[low][:, None]
    right, ahead = dx * c + dy * s, dy * c - dx * s
    basis = tau[:, :, None] ** np.arange(4)
    squared = (weight * weight)[:, :, None]
    normal = np.einsum("imp,imq->ipq", basis * squared, basis)
    target = np.einsum("imp,imk->ipk", basis * squared, np.stack([right, ahead], axis=-1))
    out = np.full((len(rows), 6), np.nan)
    good = (weight > 0).sum(axis=1) >= 4
    if good.any():
        fit = np.linalg.pinv(normal[good], hermitian=True) @ target[good]
        out[good] = np.concatenate([fit[:, 1, :], 2 * fit[:, 2, :], 6 * fit[:, 3, :]], axis=1)
        if smoothing:
            curve = np.stack([right, ahead], axis=-1)[good]
            misfit = (squared[good] * (curve - basis[good] @ fit) ** 2).sum(axis=(1, 2))
            points = inside[good].sum(axis=1)
            bound = points - np.sqrt(2 * points)
            for k in np.flatnonzero(misfit - bound >= splines.CLOSE * bound):
                row = np.flatnonzero(good)[k]
                use = inside[row]
                knots, coefficients = splines.smoothing_spline(tau[row, use], curve[k, use], weight[row, use], bound[k])
                out[row] = splines.derivatives(knots, coefficients, 0.0).ravel()
    return out


def ego_kinematics(
    ego: DataFrame,
    keys: Sequence[str],
    time: str = "t_ns",
    half_s: float = 2.5,
    segment_s: int = 60,
    quaternion: Sequence[str] = ("qx", "qy", "qz", "qw"),
    pose: Sequence[str] = ("pose_x", "pose_y"),
    keep: Sequence[str] | None = None,
    smoothing: bool = True,
) -> DataFrame:
    """Yaw and lateral/longitudinal speed, acceleration and jerk of the ego at every row, next to the columns ``keep`` (keys and time).

    A row needs its 5 s neighbourhood only: recordings are cut into minutes with that margin
    copied over. Rows without time have no neighbourhood and no result. The fit is a weighted cubic, or
    with ``smoothing`` a spline with knots where the cubic misses the points by more than the study's bound.
    """
    half_ns = int(half_s * 1e9)
    keep = list(keep or [*keys, time])
    turned = ego.select(*dict.fromkeys([*keys, time, *pose, *keep]), quaternion_yaw(*quaternion).alias("yaw_rad"))
    placed = halo(turned, F.col(time), segment_s * 1_000_000_000, half_ns, half_ns)

    def derive(piece: dict[str, np.ndarray]):
        own = piece["is_own"].astype(bool)
        x, y, yaw = (piece[c].astype(float) for c in (*pose, "yaw_rad"))
        values = local_derivatives(piece[time], x, y, yaw, own, half_s, smoothing)
        return np.flatnonzero(own), {"yaw": np.rad2deg(yaw[own])} | {n: values[:, i] for i, n in enumerate(KINEMATICS)}

    added = [T.StructField(n, T.DoubleType()) for n in ("yaw", *KINEMATICS)]
    return map_groups(placed, [*keys, "segment"], [time, *pose], [time, *pose, "yaw_rad", "is_own"], derive, keep, added)


def with_kinematics(ego: DataFrame, keys: Sequence[str], time: str = "t_ns", **options) -> DataFrame:
    """All columns of the ego rows with their kinematics, row by row: also where keys are NULL or times repeat."""
    return ego_kinematics(ego, keys, time, keep=ego.columns, **options)
