import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ladderlens.functions import numeric


def slow_iso(y, w):
    mean = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(0.1, 5)), min_size=1, max_size=12))
def test_pava_equals_the_max_min_formula(rows):
    y, w = (np.array(x) for x in zip(*rows, strict=True))
    assert np.allclose(numeric.pava(y, w), slow_iso(y, w))


def test_pava_by_hand():
    assert numeric.pava(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def test_curve_by_hand():
    out = numeric.curve(np.array([-3.0, -1, 1, 3]), 2.0, 5.0)
    assert out["G"].tolist() == [-3, -4, -3, 0] and out["r"].tolist() == [3, 4, 3]
    assert np.allclose(out["m"], 5 - np.array([0, 1 / 3, 7 / 12, 11 / 12]))
    left = np.exp(np.array([11 / 12, 7 / 12, 1 / 3, 0]))
    assert np.allclose(out["mce"], left / left.sum())
    assert np.allclose(numeric.curve(np.array([-3.0, -1, 1, 3]), np.full(4, 2.0), 5.0)["r"], out["r"])


@pytest.mark.parametrize("variant", ["uplift", "shift", "tail"])
def test_stationary_drifts_sum_to_zero(variant):
    g, ok = numeric.stationary(-0.5 * np.arange(1, 201) ** -0.7, variant, 20, 50)
    assert ok and abs(g.sum()) < 1e-7 and (np.cumsum(g)[:-1] < 0).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.floats(-3, 1), min_size=12, max_size=40), st.integers(1, 6), st.integers(1, 8))
def test_tail_variant_keeps_the_head_and_never_falls_after_it(g, m, protect):
    g = np.array(g)
    out, ok = numeric.stationary(g, "tail", m, protect)
    assert abs(out.sum()) < 1e-7 and (np.diff(out[protect:]) >= -1e-9).all()
    if (np.cumsum(g[:protect]) < -1e-9).all():
        assert ok and np.allclose(out[:protect], g[:protect])
        lifted = g.copy()
        lifted[-m:] -= g.sum() / m
        assert np.allclose(out[protect:], slow_iso(lifted[protect:], np.ones(len(g) - protect)), atol=1e-7)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(1, 9)), min_size=1, max_size=15), st.sampled_from([0.0, 0.1, 0.25, 0.4]))
def test_trimmed_mean_equals_that_of_repeated_values(rows, trim):
    x, w = (np.array(v, float) for v in zip(*rows, strict=True))
    many = np.sort(np.repeat(x, w.astype(int) * 20))  # the weight as copies, so that the cut falls between two
    cut = round(trim * len(many))
    assert math.isclose(numeric.trimmed_interp(x, w, trim), many[cut : len(many) - cut].mean(), abs_tol=1e-9)


def test_trimming_all_leaves_the_middle():
    assert numeric.trimmed_interp(np.array([3.0, 1, 2]), np.ones(3), 0.5) == 2


def test_infeasible_uplift():
    assert not numeric.stationary(np.ones(50), "uplift", 5)[1]


def test_distribution_functions():
    assert math.isclose(numeric.t_tail(2.0, 10), 0.07338803, abs_tol=1e-7)
    assert math.isclose(numeric.f_tail(4.0, 1, 10), numeric.t_tail(2.0, 10), abs_tol=1e-12)
    assert math.isclose(numeric.t_quantile(0.05, 10), 2.228139, abs_tol=1e-5)
    assert math.isclose(numeric.incomplete_beta(2, 3, 0.5), 0.6875, abs_tol=1e-12)


def test_tails_are_recovered():
    k = np.arange(1, 200)
    for family, shape in (("power", 0.7), ("log", 2.0)):
        g = -0.3 * numeric.TAILS[family](np.maximum(k, 20) / 1.0, 20, shape)
        name, a, s = numeric.choose_tail(k, g, np.ones(len(k)), 20)
        assert name == family and abs(a - 0.3) < 1e-6 and abs(s - shape) < 1e-3
    with pytest.raises(ValueError, match="negative"):
        numeric.fit_tail(k, np.ones(len(k)), np.ones(len(k)), 20, "power")


def test_robust_means():
    x = np.append(np.random.default_rng(1).normal(5, 1, 200), [1e6])
    assert abs(numeric.huber_mean(x) - 5) < 0.3
    assert abs(numeric.trimmed_interp(x, np.ones(len(x)), 0.1) - 5) < 0.3
    assert numeric.huber_mean(np.ones(5)) == 1


def test_kendall_equals_brute_force():
    r = np.random.default_rng(2)
    x, y = r.permutation(30), r.permutation(30)
    slow = sum(np.sign((x[i] - x[j]) * (y[i] - y[j])) for i in range(30) for j in range(i)) / (30 * 29 / 2)
    assert math.isclose(numeric.kendall(x, y), slow)


def test_variance_power_is_recovered():
    h = np.array([1.0, 2, 4, 8])
    a, beta, r2 = numeric.variance_power(h, 0.5 * h**0.8)
    assert abs(a - 0.5) < 1e-4 and abs(beta - 0.8) < 1e-4 and r2 > 0.999


def test_the_least_shift_by_bisection():
    r = np.random.default_rng(7)

    def falls(g, m, c):
        g = g - c
        g[len(g) - m :] -= g.sum() / m
        return np.cumsum(g)[:-1].max(initial=-1.0) <= 1e-12

    for _ in range(500):
        n = int(r.integers(2, 30))
        m, g = int(r.integers(1, n)), r.standard_normal(n) + r.choice([-1.0, 0.0, 0.5])
        low, high = 0.0, 0.0 if falls(g, m, 0.0) else 100.0
        for _ in range(60):
            low, high = (low, (low + high) / 2) if falls(g, m, (low + high) / 2) else ((low + high) / 2, high)
        assert abs(numeric.least_shift(g, m) - high) < 1e-7
        assert numeric.stationary(g, "shift", m)[1]
