import numpy as np

from ladderlens.functions.spline import System, smoothing_spline


def dense(x, y, w, strength):
    """Value, second derivatives and trace by full matrices."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = [1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    hat = np.linalg.inv(np.diag(w) + strength * q @ np.linalg.inv(r) @ q.T) @ np.diag(w)
    return hat @ y, np.linalg.solve(r, q.T @ (hat @ y)), np.trace(hat)


def test_fits_equal_full_matrices():
    r = np.random.default_rng(1)
    for n in (4, 5, 6, 9, 40):
        x, y, w = np.sort(r.random(n)) * 10 + np.arange(n) * 0.1, r.standard_normal(n), r.random(n) + 0.2
        system = System(x, w)
        for strength in (1e-4, 0.1, 30.0):
            c, off, rest = system.fit(y, np.array([strength, strength * 2]))
            value, second, trace = dense(x, y, w, strength)
            assert np.allclose(y - off[:, 0], value) and np.allclose(c[:, 0], second) and np.isclose(n - rest[0], trace)


def test_the_strength_has_the_least_cross_validation_error():
    r = np.random.default_rng(2)
    x = np.linspace(0, 6, 80)
    y = np.sin(x) + 0.2 * r.standard_normal(80)
    fit = smoothing_spline(x, y)

    def error(strength):
        value, _, trace = dense(x, y, np.ones(80), strength)
        return ((y - value) ** 2).mean() / (1 - trace / 80) ** 2

    assert all(error(fit.strength) <= error(fit.strength * f) + 1e-12 for f in (0.2, 0.7, 1.4, 5))
    assert np.abs(fit.value - np.sin(x)).max() < 0.2 and np.abs(fit.slope() - np.cos(x))[5:-5].max() < 0.4


def test_derivatives_are_exact():
    """A natural spline through its own values has its own derivatives; a line has no bend."""
    r = np.random.default_rng(3)
    x = np.cumsum(r.random(12) + 0.3)
    y = r.standard_normal(12)
    c, off, _ = System(x, np.ones(12)).fit(y, np.array([0.0]))
    from ladderlens.functions.spline import Spline

    own = Spline(x, y - off[:, 0], np.concatenate([[0], c[:, 0], [0]]), 0.0, 12.0)
    assert np.allclose(own.at(x), y)
    step = 1e-5
    for i in range(12):
        ahead, back = own.at(x[i] + step), own.at(x[i] - step)
        assert abs((ahead - back) / (2 * step) - own.slope()[i]) < 1e-5
        assert abs((ahead - 2 * own.at(x[i]) + back) / step**2 - own.second[i]) < 1e-3 * max(1, abs(own.second[i]))
    line = smoothing_spline(np.arange(30.0), 3 - 2 * np.arange(30.0))
    assert np.allclose(line.slope(), -2) and np.abs(line.second).max() < 1e-8


def test_degrees_of_freedom_and_short_vectors():
    r = np.random.default_rng(4)
    x = np.arange(1.0, 200)
    assert abs(smoothing_spline(x, r.standard_normal(199), freedom=12).freedom - 12) < 0.05
    assert smoothing_spline(np.array([1.0, 2, 3]), np.array([3.0, 1, 2])).value.tolist() == [3, 1, 2]
    assert np.allclose(smoothing_spline(x[:4], np.array([0.0, 1, 2, 3])).value, [0, 1, 2, 3])
