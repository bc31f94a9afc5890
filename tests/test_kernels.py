"""Kernels against optimality conditions, brute force and known values."""

import math

import numpy as np
import pytest

from panelforge.functions import kernels, special


@pytest.mark.parametrize("seed", range(40))
def test_tv_meets_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 80))
    y, w, lam = rng.normal(size=n), rng.uniform(0.1, 3, n), rng.uniform(0, 2, n - 1)
    theta = kernels.tv_solve(y, w, lam)
    c = np.cumsum(w * (theta - y))
    assert abs(c[-1]) < 1e-8
    assert (np.abs(c[:-1]) <= lam + 1e-8).all()
    jump = np.flatnonzero(np.abs(np.diff(theta)) > 1e-9)
    assert np.allclose(c[jump], np.sign(np.diff(theta))[jump] * lam[jump], atol=1e-7)


def test_tv_limits_and_recovery():
    rng = np.random.default_rng(1)
    y = rng.normal(size=50)
    assert np.allclose(kernels.tv_solve(y, np.ones(50), np.full(49, 1e6)), y.mean(), atol=1e-3)
    assert np.allclose(kernels.tv_solve(y, np.ones(50), np.zeros(49)), y)
    truth = np.zeros(600)
    truth[150:230], truth[400:460] = 0.4, -0.35
    se = rng.uniform(0.05, 0.2, 600)
    noisy = truth + rng.normal(size=600) * se
    w = 1 / se**2
    theta = kernels.tv_denoise(noisy, w, kernels.penalty(np.sort(rng.uniform(0, 4e5, 600)), 1.0, 1000, w, floor=20.0))
    assert ((theta - truth) ** 2).mean() < 0.5 * ((noisy - truth) ** 2).mean()
    assert kernels.tv_denoise(np.array([2.0]), np.ones(1), np.empty(0)).tolist() == [2.0]


def test_zero_weights_are_tolerated():
    theta = kernels.tv_denoise(np.array([1.0, 5.0, 1.0, 1.0]), np.array([1.0, 0.0, 1.0, 1.0]), np.full(3, 0.01))
    assert np.isfinite(theta).all()


def brute_posterior(y, se, pos, m):
    import itertools

    n, total = len(y), 0.0
    g = np.zeros((n, 3))
    for path in itertools.product(range(3), repeat=n):
        p = m.pi[path[0]]
        for i, s in enumerate(path):
            v = m.sigma[s] ** 2 + se[i] ** 2
            p *= math.exp(-0.5 * (y[i] - m.mu[s]) ** 2 / v) / math.sqrt(2 * math.pi * v)
            if i:
                p *= kernels.transitions(pos[i] - pos[i - 1], m.pi, m.length_scale)[path[i - 1], s]
        total += p
        for i, s in enumerate(path):
            g[i, s] += p
    return g / total, math.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    m = kernels.BlockModel(np.array([-0.2, 0, 0.2]), np.array([0.1, 0.05, 0.1]), np.array([0.2, 0.6, 0.2]), 1000.0)
    y, se, pos = rng.normal(0, 0.2, 6), rng.uniform(0.02, 0.08, 6), np.cumsum(rng.uniform(10, 2000, 6))
    g, ll = kernels.forward_backward(y, se, pos, m)
    bg, bll = brute_posterior(y, se, pos, m)
    assert np.allclose(g, bg, atol=1e-10) and abs(ll - bll) < 1e-9
    one, _ = kernels.forward_backward(y[:1], se[:1], pos[:1], m)
    assert np.allclose(one.sum(), 1)


def test_state_labels_and_order():
    assert kernels.state_labels(1) == ["hypo", "neutral", "hyper"]
    assert kernels.state_labels(0) == ["neutral", "hyper_s1", "hyper_s2"]
    m, order = kernels.ordered_states(kernels.BlockModel(np.array([0.1, 0.0, 0.2]), np.ones(3), np.ones(3) / 3, 1.0))
    assert m.neutral == 0 and order.tolist() == [1, 0, 2]


def test_special_functions():
    assert abs(special.digamma(1) + 0.5772156649015329) < 1e-12
    assert abs(special.trigamma(1) - math.pi**2 / 6) < 1e-12
    for x in (0.3, 1.0, 5.0, 40.0):
        assert abs(special.trigamma_inverse(special.trigamma(x)) - x) < 1e-7 * x
    assert abs(special.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(special.binomial_tail(3, 10, 0.2) - 0.3222004736) < 1e-9
    assert abs(special.hypergeometric_two_sided(3, 1, 1, 3) - 0.4857142857) < 1e-9
    assert special.binomial_tail(0, 5, 0.1) == 1.0 and special.binomial_tail(3, 5, 0.0) == 0.0
