"""Smoothing splines: B-splines and derivatives by their definitions, the bound, cubics where they suffice."""

import math

import numpy as np
import pytest

from driverscope.operators import splines, steering

U = np.linspace(-2.5, 2.5, 61)
W = np.cos(U / 2.5 * math.pi / 2)


def curve(noise, seed=1):
    r = np.random.RandomState(seed)
    return np.stack([5 * U + noise * np.sin(3 * U), U**2 - U**3 / 4], axis=1) + r.normal(size=(len(U), 2)) * noise / 4


def one(knots, j, degree, u):
    """A B-spline by its recursion."""
    if degree == 0:
        return float(knots[j] <= u < knots[j + 1] or (u == knots[-1] == knots[j + 1] and knots[j] < u))
    left, right = knots[j + degree] - knots[j], knots[j + degree + 1] - knots[j + 1]
    a = (u - knots[j]) / left * one(knots, j, degree - 1, u) if left else 0.0
    b = (knots[j + degree + 1] - u) / right * one(knots, j + 1, degree - 1, u) if right else 0.0
    return a + b


@pytest.mark.parametrize("inner", [[], [0.5], [-1.0, 0.0, 2.0]])
def test_basis_and_derivatives(inner):
    knots = np.array([-2.5] * 4 + inner + [2.5] * 4)
    places = np.array([-2.5, -1.0, -0.3, 0.0, 0.5, 2.2, 2.5])
    got = splines.basis(knots, places)
    np.testing.assert_allclose(got, [[one(knots, j, 3, u) for j in range(len(knots) - 4)] for u in places], atol=1e-12)
    c = np.random.RandomState(0).rand(len(knots) - 4, 2)
    h, at = 1e-3, 0.31
    near = splines.basis(knots, at + h * np.arange(-2, 3)) @ c
    first, second, third = splines.derivatives(knots, c, at)
    np.testing.assert_allclose(first, (near[3] - near[1]) / (2 * h), rtol=1e-5)
    np.testing.assert_allclose(second, (near[3] - 2 * near[2] + near[1]) / h**2, rtol=1e-4)
    np.testing.assert_allclose(third, (near[4] - 2 * near[3] + 2 * near[1] - near[0]) / (2 * h**3), rtol=1e-3)


def test_jumps_are_those_of_the_third_derivative():
    knots = np.array([0.0] * 4 + [1.0, 2.5, 3.0] + [4.0] * 4)
    found, ratios = splines.jumps(knots), []
    for r, at in enumerate((1.0, 2.5, 3.0)):
        for j in range(len(knots) - 4):
            c = np.zeros((len(knots) - 4, 1))
            c[j] = 1.0
            step = splines.derivatives(knots, c, at + 1e-9)[2, 0] - splines.derivatives(knots, c, at - 1e-9)[2, 0]
            if abs(step) > 1e-9:
                ratios.append(found[r, j] / step)
            else:
                assert found[r, j] == pytest.approx(0.0, abs=1e-9)
    np.testing.assert_allclose(ratios, ratios[0])


@pytest.mark.parametrize("noise", [0.0, 0.3, 2.0, 8.0, 40.0])
def test_the_bound_is_met_and_used_up(noise):
    points, bound = curve(noise), splines.bound_for(len(U))
    knots, c = splines.smoothing_spline(U, points, W, bound)
    misfit = ((W[:, None] * (points - splines.basis(knots, U) @ c)) ** 2).sum()
    assert misfit <= bound * 1.0011
    if len(knots) > 8:
        assert misfit >= bound * 0.9989
    else:
        cubic = np.linalg.lstsq(W[:, None] * U[:, None] ** np.arange(4), W[:, None] * points, rcond=None)[0]
        np.testing.assert_allclose(splines.derivatives(knots, c, 0.0), cubic[1:] * np.array([[1], [2], [6]]), rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("size", range(4, 12))
def test_few_points(size):
    u = np.linspace(-2.0, 2.0, size)
    w = np.cos(u / 2.5 * math.pi / 2)
    points = np.random.RandomState(size).normal(size=(size, 2)) * 30
    knots, c = splines.smoothing_spline(u, points, w, splines.bound_for(size))
    assert ((w[:, None] * (points - splines.basis(knots, u) @ c)) ** 2).sum() <= splines.bound_for(size) * 1.002


@pytest.mark.parametrize("noise", [3.0, 9.0])
def test_smoother_than_the_closest_spline_on_its_knots(noise):
    points = curve(noise)
    knots, c = splines.smoothing_spline(U, points, W, splines.bound_for(len(U)))
    matrix = W[:, None] * splines.basis(knots, U)
    closest = np.linalg.lstsq(matrix, W[:, None] * points, rcond=None)[0]

    def misfit(k):
        return ((W[:, None] * points - matrix @ k) ** 2).sum()

    def roughness(k):
        return ((splines.jumps(knots) @ k) ** 2).sum()

    assert len(knots) > 8 and misfit(closest) < misfit(c) and roughness(c) < roughness(closest)
    # no small step makes it smoother without leaving the points further
    r = np.random.RandomState(3)
    for _ in range(200):
        other = c + r.normal(size=c.shape) * 1e-4
        assert misfit(other) > misfit(c) or roughness(other) > roughness(c)


def test_rows_take_a_spline_only_where_a_cubic_misses():
    t = (U * 1e9).astype(np.int64)
    wanted = U == 0.0
    yaw = np.zeros(len(U))
    for noise, same in ((0.1, True), (9.0, False)):
        x, y = curve(noise).T
        cubic = steering.local_derivatives(t, x, y, yaw, wanted, 2.5, smoothing=False)
        smooth = steering.local_derivatives(t, x, y, yaw, wanted, 2.5)
        assert np.allclose(cubic, smooth) is same
        knots, c = splines.smoothing_spline(U, np.stack([x - x[0], y - y[0]], axis=1), np.where(W < 1e-9, 0, W), splines.bound_for(len(U)))
        np.testing.assert_allclose(smooth[0], splines.derivatives(knots, c, 0.0).ravel(), rtol=1e-6)


def test_the_search_for_the_smoothness_solves_no_fit_per_round(monkeypatch):
    """On independent columns every smoothness only scales the points' modes, whatever the number of rounds."""
    def fail(*_, **__):
        raise AssertionError("a fit per round")

    monkeypatch.setattr(np.linalg, "lstsq", fail)
    u = np.arange(-2.0, 3.0)
    weights = np.cos(u / 2.5 * np.pi / 2)
    points = np.array([[0.0, 0.0], [30.0, 2.0], [4.0, 44.0], [41.0, 7.0], [8.0, 90.0]])
    bound = splines.bound_for(5)
    knots, c = splines.smoothing_spline(u, points, weights, bound)
    misfit = ((weights[:, None] * (points - splines.basis(knots, u) @ c)) ** 2).sum()
    assert abs(misfit - bound) <= splines.CLOSE * bound
