"""Weighted smoothing splines of plane curves, for windows that one cubic does not fit closely enough.

The spline with the fewest knots whose weighted squared distance to the points stays within a bound, then the smoothest
one on these knots that uses the bound up (the published method of the curve fitting package behind
the study's spline calls). Knots go to the middle point of the stretch with the largest misfit.
"""

from __future__ import annotations

import functools
import math

import numpy as np

DEGREE = 3
#: Share of the bound by which the result may miss it, and rounds of the search for the smoothness.
CLOSE, ROUNDS = 0.001, 60
#: Largest condition of columns that count as independent, and kept windows: on a grid of frames most are alike.
INDEPENDENT, KEPT = 1e4, 128


def basis(knots: np.ndarray, at: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Values of all B-splines at every place; the last stretch holds its right end."""
    last = len(knots) - degree - 2
    stretch = np.clip(np.searchsorted(knots, at, side="right") - 1, degree, last)
    rows = np.arange(len(at))
    out = np.zeros((len(at), len(knots) - 1))
    out[rows, stretch] = 1.0
    for d in range(1, degree + 1):
        width = knots[d:] - knots[:-d]
        ratio = np.divide(at[:, None] - knots[None, :-d], width, out=np.zeros((len(at), len(width))), where=width > 0)
        out = ratio[:, :-1] * out[:, : len(width) - 1] + np.where(width[1:] > 0, 1 - ratio[:, 1:], 0.0) * out[:, 1 : len(width)]
    return out


def jumps(knots: np.ndarray) -> np.ndarray:
    """How much the third derivative jumps at each inner knot, per coefficient, scaled to the range."""
    inner = len(knots) - 2 * (DEGREE + 1)
    factor = (inner + 1) / (knots[-1] - knots[0])
    out = np.zeros((inner, len(knots) - DEGREE - 1))
    for r in range(inner):
        at = knots[r + DEGREE + 1]
        for j in range(DEGREE + 2):
            around = np.delete(knots[r + j : r + j + DEGREE + 2], np.flatnonzero(np.arange(r + j, r + j + DEGREE + 2) == r + DEGREE + 1))
            out[r, r + j] = (knots[r + j + DEGREE + 1] - knots[r + j]) / np.prod((at - around)[: DEGREE + 1]) / factor**DEGREE
    return out


def derivatives(knots: np.ndarray, coefficients: np.ndarray, at: float) -> np.ndarray:
    """First to third derivative of the curve at one place: an array of 3 x dimensions."""
    return _slopes(knots.tobytes(), at) @ coefficients


@functools.lru_cache(KEPT)
def _slopes(knots: bytes, at: float) -> np.ndarray:
    """What each coefficient adds to the derivatives at one place."""
    t = np.frombuffer(knots)
    out, c = [], np.eye(len(t) - DEGREE - 1)
    for degree in range(DEGREE, 0, -1):
        width = t[degree + 1 : -1] - t[1 : -degree - 1]
        c = degree * np.diff(c, axis=0) / width[:, None]
        t = t[1:-1]
        out.append((basis(t, np.array([at]), degree - 1) @ c)[0])
    return np.stack(out)


class Window:
    """All that the places, the weights and the knots alone decide about a fit."""

    def __init__(self, u: np.ndarray, weights: np.ndarray, places: tuple[int, ...]) -> None:
        self.knots = np.array([*[u[0]] * (DEGREE + 1), *(u[i] for i in places), *[u[-1]] * (DEGREE + 1)])
        self.matrix = weights[:, None] * basis(self.knots, u)

    def fitted(self, weighted: np.ndarray) -> np.ndarray:
        """Coefficients of the closest curve."""
        if self.back is not None:
            return self.back @ (self.factors[0].T @ weighted)
        return np.linalg.lstsq(self.matrix, weighted, rcond=None)[0]

    @functools.cached_property
    def penalty(self) -> np.ndarray:
        return jumps(self.knots)

    @functools.cached_property
    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        return np.linalg.qr(self.matrix)

    @functools.cached_property
    def back(self) -> np.ndarray | None:
        """Inverse of the triangle; none where columns depend on others."""
        _, r = self.factors
        if r.shape[0] < r.shape[1] or not np.linalg.cond(r) < INDEPENDENT:
            return None
        return np.linalg.inv(r)

    @functools.cached_property
    def modes(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(squared sizes, directions) of the jumps seen in the columns' orthogonal base, if there is an inverse."""
        if self.back is None:
            return None
        _, sizes, directions = np.linalg.svd(self.penalty @ self.back, full_matrices=False)
        return sizes**2, directions


@functools.lru_cache(KEPT)
def _window(u: bytes, weights: bytes, places: tuple[int, ...]) -> Window:
    return Window(np.frombuffer(u), np.frombuffer(weights), places)


class Knots:
    """Inner knots with the points inside each stretch and its misfit."""

    def __init__(self, points: int) -> None:
        self.places: list[int] = []
        self.inside = [points - 2]
        self.misfit = [0.0]

    def add(self) -> None:
        """One more knot, at the middle point of the stretch with the largest misfit that has points inside."""
        best = max((j for j, n in enumerate(self.inside) if n), key=lambda j: (self.misfit[j], -j))
        begin = sum(self.inside[:best]) + best
        count, half = self.inside[best], self.inside[best] // 2 + 1
        total = self.misfit[best]
        self.inside[best : best + 1] = [half - 1, count - half]
        self.misfit[best : best + 1] = [total * (half - 1) / count, total * (count - half) / count]
        self.places.insert(best, begin + half)


def smoothing_spline(u: np.ndarray, points: np.ndarray, weights: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(knots, coefficients) of the curve through ``points`` at ``u``, with a weighted squared distance of at most about ``bound``."""
    m, weighted = len(u), weights[:, None] * points
    known = np.asarray(u, float).tobytes(), np.asarray(weights, float).tobytes()
    close, most = CLOSE * bound, m - DEGREE - 1
    chosen = Knots(m)
    places, added, before, first = [], 0, 0.0, None

    while True:
        window = _window(*known, tuple(places))
        knots, matrix = window.knots, window.matrix
        coefficients = window.fitted(weighted)
        errors = ((weighted - matrix @ coefficients) ** 2).sum(axis=1)
        misfit = float(errors.sum())
        first = misfit if first is None else first
        over = misfit - bound
        if abs(over) < close or (over < 0 and not places) or (over > 0 and len(places) >= most):
            return knots, coefficients
        if over < 0:
            break
        if added:
            wanted = added * over / (before - misfit) if before - misfit > close else 2 * added
            added = min(2 * added, max(int(wanted), added // 2, 1))
        else:
            added = 1
        before = misfit
        # a point that is a knot counts half for either side
        halves = np.zeros(m)
        halves[places] = errors[places] / 2
        cuts = [0, *places, m]
        chosen.misfit = [float(errors[a:b].sum() - halves[a] + (halves[b] if b < m else 0.0)) for a, b in zip(cuts, cuts[1:])]
        for _ in range(added):
            chosen.add()
            if len(chosen.places) == most:
                break
        # with as many knots as points allow, they lie as for the interpolating spline
        places = list(range(2, m - 2)) if len(chosen.places) == most else list(chosen.places)

    base, triangle = window.factors
    p = matrix.shape[1] / np.abs(np.diag(triangle)).sum()
    if window.modes is not None:
        # in the base of the jumps every smoothness only scales the modes of the points
        sizes, directions = window.modes
        turned = base.T @ weighted
        shares = directions @ turned
        rest = float(((weighted - base @ turned) ** 2).sum())
        energy = (shares**2).sum(axis=1)

    def smoothed(p: float) -> tuple[float, np.ndarray | None]:
        """(misfit, coefficients) at one smoothness; without coefficients where the modes give them later."""
        if window.modes is not None:
            return rest + float(((sizes / (p * p + sizes)) ** 2 @ energy)), None
        bent, still = np.concatenate([matrix, window.penalty / p]), np.zeros((len(window.penalty), points.shape[1]))
        found = np.linalg.lstsq(bent, np.concatenate([weighted, still]), rcond=None)[0]
        return float(((weighted - matrix @ found) ** 2).sum()), found

    p1, f1, p3, f3 = 0.0, first - bound, -1.0, over
    below = above = False
    for _ in range(ROUNDS):
        used = p
        misfit, coefficients = smoothed(p)
        over = misfit - bound
        if abs(over) < close:
            break
        if not below:
            if over - f3 <= close:  # p is too large
                p3, f3 = p, over
                p = 0.04 * p if 0.04 * p > p1 else 0.9 * p1 + 0.1 * p3
                continue
            below = over < 0
        if not above:
            if f1 - over <= close:  # p is too small
                p1, f1, p = p, over, p / 0.04
                if p3 > 0 and p >= p3:
                    p = 0.1 * p1 + 0.9 * p3
                continue
            above = over > 0
        if over >= f1 or over <= f3:
            break
        p, (p1, f1, p3, f3) = _rational(p1, f1, p, over, p3, f3)
    if coefficients is None:
        coefficients = window.back @ (turned - directions.T @ ((sizes / (used * used + sizes))[:, None] * shares))
    return knots, coefficients


def _rational(p1: float, f1: float, p2: float, f2: float, p3: float, f3: float) -> tuple[float, tuple[float, float, float, float]]:
    """Zero of the rational curve through three places, the third at infinity if negative, and the new bracket."""
    if p3 > 0:
        h1, h2, h3 = f1 * (f2 - f3), f2 * (f3 - f1), f3 * (f1 - f2)
        p = -(p1 * p2 * h3 + p2 * p3 * h1 + p3 * p1 * h2) / (p1 * h1 + p2 * h2 + p3 * h3)
    else:
        p = (p1 * (f1 - f3) * f2 - p2 * (f2 - f3) * f1) / ((f1 - f2) * f3)
    return p, ((p1, f1, p2, f2) if f2 < 0 else (p2, f2, p3, f3))


def bound_for(points: int) -> float:
    """The distance that the study's spline call allows by default."""
    return points - math.sqrt(2 * points)
