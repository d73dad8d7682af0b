"""Natural cubic smoothing splines, in time that grows with the number of knots."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Strengths are STEP ** (3 s - 1) times what balances roughness and data, for s in this span.
STEP, SPAN = 256.0, (-1.5, 1.5)


@dataclass
class Spline:
    """Value and second derivative at each knot; the latter is 0 at both ends."""

    x: np.ndarray
    value: np.ndarray
    second: np.ndarray
    strength: float
    freedom: float

    def slope(self) -> np.ndarray:
        """First derivative at the knots."""
        h, c = np.diff(self.x), self.second
        chord = np.diff(self.value) / h
        return np.append(chord - h * (2 * c[:-1] + c[1:]) / 6, chord[-1] + h[-1] * (c[-2] + 2 * c[-1]) / 6)

    def at(self, points: np.ndarray) -> np.ndarray:
        """Values anywhere; beyond the ends the spline is a line."""
        points = np.asarray(points, float)
        i = np.clip(np.searchsorted(self.x, points, side="right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        a, b = (self.x[i + 1] - points) / h, (points - self.x[i]) / h
        inside = a * self.value[i] + b * self.value[i + 1] + ((a**3 - a) * self.second[i] + (b**3 - b) * self.second[i + 1]) * h**2 / 6
        slope = self.slope()
        low, high = self.value[0] + (points - self.x[0]) * slope[0], self.value[-1] + (points - self.x[-1]) * slope[-1]
        return np.where(points < self.x[0], low, np.where(points > self.x[-1], high, inside))


class System:
    """The equations (R + strength P) c = Q'y for the second derivatives c at the inner knots, for several strengths at once.

    R and P have two and three diagonals.  P is Q' W^-1 Q, with Q the second
    divided differences; each row below has one column for each strength.
    """

    def __init__(self, x: np.ndarray, w: np.ndarray) -> None:
        h, m = np.diff(x), len(x) - 2
        self.n, self.w = len(x), w
        self.q = np.array([1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]])
        v = 1 / w
        q0, q1, q2 = self.q
        self.p = np.zeros((3, m))
        self.p[0] = q0**2 * v[:-2] + q1**2 * v[1:-1] + q2**2 * v[2:]
        self.p[1, : m - 1] = (q1[:-1] * q0[1:] * v[1:-2] + q2[:-1] * q1[1:] * v[2:-1])[: m - 1]
        self.p[2, : m - 2] = (q2[:-2] * q0[2:] * v[2:-2])[: max(m - 2, 0)]
        self.r = np.zeros((3, m))
        self.r[0], self.r[1, : m - 1] = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
        self.balance = float(self.r[0].sum() / self.p[0].sum())

    def factor(self, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """d, a and b of the factors L D L', where L has 1, a and b from the diagonal down."""
        bands = self.r[:, :, None] + strength * self.p[:, :, None]
        m, k = bands.shape[1:]
        d, a, b = np.zeros((m + 2, k)), np.zeros((m + 2, k)), np.zeros((m + 2, k))
        for j in range(m):
            d[j] = bands[0, j] - a[j - 1] ** 2 * d[j - 1] - b[j - 2] ** 2 * d[j - 2]  # rows -1 and -2 are 0 still
            a[j] = (bands[1, j] - b[j - 1] * d[j - 1] * a[j - 1]) / d[j]
            b[j] = bands[2, j] / d[j]
        return d[:m], a[:m], b[:m]

    def residual_freedom(self, strength: np.ndarray, factors: tuple) -> np.ndarray:
        """Knots less the degrees of freedom of the fits: from the three diagonals of the inverse that P meets."""
        d, a, b = factors
        m, k = d.shape
        s0, s1, s2 = np.zeros((m + 2, k)), np.zeros((m + 2, k)), np.zeros((m + 2, k))
        for j in range(m - 1, -1, -1):
            s2[j] = -a[j] * s1[j + 1] - b[j] * s0[j + 2]
            s1[j] = -a[j] * s0[j + 1] - b[j] * s1[j + 1]
            s0[j] = 1 / d[j] - a[j] * s1[j] - b[j] * s2[j]
        met = self.p[0] @ s0[:m] + 2 * (self.p[1] @ s1[:m]) + 2 * (self.p[2] @ s2[:m])
        return strength * met

    def fit(self, y: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Second derivatives at the inner knots, residuals and their degrees of freedom, a column for each strength."""
        factors = d, a, b = self.factor(strength)
        m, k = d.shape
        q0, q1, q2 = self.q
        c = np.zeros((m + 2, k))
        right = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]
        for j in range(m):
            c[j] = right[j] - (a[j - 1] * c[j - 1] if j else 0) - (b[j - 2] * c[j - 2] if j > 1 else 0)
        c[:m] /= d
        for j in range(m - 1, -1, -1):
            c[j] -= a[j] * c[j + 1] + b[j] * c[j + 2]
        c = c[:m]
        off = np.zeros((self.n, k))
        off[:-2] += q0[:, None] * c
        off[1:-1] += q1[:, None] * c
        off[2:] += q2[:, None] * c
        return c, strength * off / self.w[:, None], self.residual_freedom(strength, factors)


def smoothing_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, freedom: float | None = None) -> Spline:
    """The natural cubic spline f with the least sum w (y - f)^2 + strength * integral f''^2.

    x rises.  The strength is that of the least generalized cross-validation
    error, or that with the given degrees of freedom.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    w = np.ones(n) if w is None else np.asarray(w, float) / np.mean(w)
    if n < 4:
        return Spline(x, y.copy(), np.zeros(n), 0.0, float(n))
    system = System(x, w)

    def loss(s: np.ndarray) -> np.ndarray:
        _, off, rest = system.fit(y, system.balance * STEP ** (3 * s - 1))
        if freedom is not None:
            return np.abs(n - rest - freedom)
        return (w[:, None] * (off * n / rest) ** 2).mean(axis=0)

    low, high = SPAN
    for _ in range(6):  # each round looks closer around the best of a row of strengths
        row = np.linspace(low, high, 25)
        at = int(np.argmin(loss(row)))
        low, high = row[max(at - 1, 0)], row[min(at + 1, 24)]
    strength = system.balance * STEP ** (3 * row[at] - 1)
    c, off, rest = system.fit(y, np.array([strength]))
    return Spline(x, y - off[:, 0], np.concatenate([[0.0], c[:, 0], [0.0]]), float(strength), n - float(rest[0]))
