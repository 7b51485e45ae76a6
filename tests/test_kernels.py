"""Kernels against plain numpy and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyframes.functions import expressions as ex
from skyframes.kernels import images, linear, minimize


@pytest.mark.parametrize("shape", [(20, 64), (64, 20)])
def test_kl_residuals_match_svd(shape):
    x = np.random.default_rng(1).normal(size=shape)
    basis = linear.kl_basis(x, 5)
    vt = np.linalg.svd(x, full_matrices=False)[2]
    for n, r in zip((1, 5), linear.kl_residuals(x, basis, [1, 5]), strict=True):
        assert np.allclose(r, x - x @ vt[:n].T @ vt[:n], atol=1e-9)


def test_kl_more_modes_than_rank_and_order():
    x = np.outer(np.arange(1, 5), np.arange(1, 7)).astype(float)
    r = linear.kl_residuals(x, linear.kl_basis(x, 10), [10, 1])
    assert np.allclose(r, 0, atol=1e-9)
    assert linear.kl_basis(np.zeros((3, 4)), 2).shape == (2, 4)


@pytest.mark.parametrize("shape", [(30, 8), (8, 30)])
def test_pixel_regression_matches_truncated_svd(shape):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=shape), rng.normal(size=shape[0])
    u = np.linalg.svd(x, full_matrices=False)[0]
    got, rank = linear.pixel_regression(y, x, [1, 4])
    assert rank == min(shape)
    for m, r in zip((1, 4), got, strict=True):
        assert np.allclose(r, y - u[:, :m] @ (u[:, :m].T @ y), atol=1e-8)


def test_pixel_regression_rank_rule():
    x = np.outer(np.arange(1.0, 7), [1.0, 2.0, 3.0])
    got, rank = linear.pixel_regression(np.arange(6.0), x, [1, 2])
    assert rank == 1 and np.isfinite(got[0]).all() and np.isnan(got[1]).all()
    centred, rank = linear.pixel_regression(3 + 2 * np.arange(6.0), np.arange(6.0)[:, None], [1], centred=True)
    assert np.allclose(centred[0], 3)
    assert np.isnan(linear.pixel_regression(np.ones(3), np.zeros((3, 2)), [1])[0]).all()


def test_coefficients_and_frozen_response():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 5)), rng.normal(size=12)
    b = linear.regression_coefficients(y, x, 3)
    assert np.allclose(y - x @ b, linear.pixel_regression(y, x, [3])[0][0])
    assert np.allclose(linear.frozen_response(np.ones((2, 2)), np.ones((5, 2, 2)), b), 1 - b.sum())


def test_rotation_is_exact_for_quarter_turns_and_zero():
    f = np.random.default_rng(4).normal(size=(9, 9))
    assert (images.rotate(f, 0.0) == f).all()
    r = images.rotate(f, math.pi / 2)
    for i in range(2, 7):
        for j in range(2, 7):
            assert abs(r[i, j] - f[j, 8 - i]) < 1e-9


def test_incomplete_footprints_are_invalid():
    f = np.ones((9, 9))
    f[4, 4] = np.nan
    s = images.shift(f, 0.4, 0.0)
    assert np.isnan(s[4, 4]) and np.isnan(s[0, 4]) and abs(s[4, 7 - 1] - 1) < 1e-12 or np.isnan(s[4, 6])
    assert np.nanmax(np.abs(s - 1)) < 1e-12


@given(st.floats(0, 0.999))
@settings(max_examples=50, deadline=None)
def test_keys_weights_sum_to_one(t):
    assert abs(sum(images.keys(np.array(i - t)) for i in (-1, 0, 1, 2)) - 1) < 1e-12


def test_median_unsharp_ramp():
    ramp = np.arange(5)[:, None] + 5.0 * np.arange(5)[None, :]
    out = images.median_unsharp(ramp, 4)
    assert np.allclose(out[2, 2], 3) and out[0].sum() == 0


def test_masked_gauss_keeps_constants():
    f = np.full((9, 9), 5.0)
    f[3, 3] = np.nan
    assert np.allclose(images.masked_gauss(f, 2.0, 4.0), 5)


def test_contrast_search_finds_a_parabola():
    s = minimize.minimize_contrast(lambda c: (c - 0.37) ** 2 + 1, 0.0, 1.0)
    assert s.converged and s.agrees and abs(s.best[0] - 0.37) < 1e-3
    edge = minimize.minimize_contrast(lambda c: c, 0.0, 1.0)
    assert edge.best[0] < 1e-3 and not edge.converged


def test_contrast_search_takes_a_batch_and_remembers():
    calls = []
    s = minimize.minimize_contrast(lambda c: calls.append(c) or (c - 0.5) ** 2, 0.0, 1.0, 9, batch=lambda g: [(x - 0.5) ** 2 for x in g])
    assert len(calls) == len(set(calls)) and not set(calls) & {i / 8 for i in range(9)} and s.merit < 1e-6


def test_joint_search_converges_within_bounds():
    s = minimize.minimize_position(lambda r, c, k: (r - 0.2) ** 2 + (c + 0.3) ** 2 + (k - 0.5) ** 2, (0.0, 0.0, 0.4), 1.0, (0.0, 1.0), most=400)
    assert max(abs(a - b) for a, b in zip(s.best, (0.2, -0.3, 0.5), strict=True)) < 0.02
    with pytest.raises(ValueError):
        minimize.minimize_position(lambda *x: 0.0, (0, 0, 0), 1.0, (0, 1), most=10)


@given(st.floats(-1e3, 1e3), st.floats(-5, 5), st.floats(0.1, 9))
@settings(max_examples=80, deadline=None)
def test_reflect_stays_inside(v, low, span):
    assert low <= ex.reflect(v, low, low + span) <= low + span


def test_small_helpers():
    assert ex.mode_count(0.5, 9) == 4 and ex.mode_count(0.001, 9) == 1
    assert ex.degrees_of_freedom(10, 30, True) == 9
    assert ex.parity_crop(31, 10) == 11 and ex.parity_crop(30, 10) == 10
    assert ex.pixel_fit_bytes(621, 3704, 3, 0) > 8 * 621 * 3704
