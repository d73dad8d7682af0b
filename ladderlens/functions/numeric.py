"""Small numerical helpers for vectors indexed by rank, in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: How far below 0, as a part of the largest drift, a prefix sum is pushed at each rank.
MARGIN = 1e-10


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that never decreases."""
    level: list[list[float]] = []  # mean, weight, length
    for value, weight in zip(np.asarray(y, float), np.asarray(w, float), strict=True):
        level.append([value, weight, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            total = a[1] + b[1]
            level.append([(a[0] * a[1] + b[0] * b[1]) / total if total else a[0], total, a[2] + b[2]])
    return np.repeat([x[0] for x in level], [int(x[2]) for x in level])


def huber_mean(x: np.ndarray, w: np.ndarray | None = None, k: float = 1.345, rounds: int = 50) -> float:
    """M-estimate of location by reweighting; the scale is the normalized median deviation."""
    x = np.asarray(x, float)
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    at = float(np.average(x, weights=w))
    for _ in range(rounds):
        scale = float(np.median(np.abs(x - at))) / 0.6745
        if scale == 0:
            return at
        u = w * np.minimum(1, k * scale / np.maximum(np.abs(x - at), 1e-300))
        new = float(np.average(x, weights=u))
        if abs(new - at) < 1e-10 * scale:
            return new
        at = new
    return at


def trimmed_interp(x: np.ndarray, w: np.ndarray, trim: float) -> float:
    """Weighted mean of what lies between the quantiles trim and 1 - trim.

    Sorted values lie side by side on the line from 0 to 1, each as wide as its
    share of the weight, and count by the part of that which is inside.  Where
    nothing is inside (trim 0.5 or more) it is the value at the middle.
    """
    order = np.argsort(x, kind="stable")
    x, w = np.asarray(x, float)[order], np.asarray(w, float)[order]
    edges = np.append(0.0, np.cumsum(w)) / w.sum()
    inside = np.diff(np.clip(edges, min(trim, 0.5), max(1 - trim, 0.5)))
    if inside.sum() <= 0:
        return float(x[min(np.searchsorted(edges[1:], 0.5), len(x) - 1)])
    return float(np.average(x, weights=inside))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper p-value of F."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of |t|: two-sided p-value p."""
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > p else (low, mid)
    return high


def golden(f: Callable[[float], float], low: float, high: float, rounds: int = 80) -> float:
    """Where f is least between low and high."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


#: Tail shapes by family: (k, k0, parameter).
TAILS: dict[str, Callable] = {"power": lambda k, k0, s: (k / k0) ** -s, "log": lambda k, k0, s: 1 / (1 + s * np.log(k / k0))}


def fit_tail(k: np.ndarray, g: np.ndarray, w: np.ndarray, k0: int, family: str, anchored: bool = True) -> tuple[float, float, float]:
    """(a, shape parameter, weighted SSE) of -a x shape(k) for ranks from k0 on.

    anchored: the curve meets g at k0; otherwise the best a for the shape is
    taken, as the curve is linear in it.  a must come out positive.
    """
    own = k >= k0
    k, g, w = k[own].astype(float), g[own], w[own]
    if not len(k):
        raise ValueError("no rank from k0 on")

    def scale(s: float) -> float:
        shape = TAILS[family](k, k0, s)
        return -float(g[0]) if anchored else -float((w * g * shape).sum() / (w * shape**2).sum())

    sse = lambda s: float((w * (g + scale(s) * TAILS[family](k, k0, s)) ** 2).sum())
    best = golden(sse, 1e-3, 2.0 if family == "power" else 50.0)
    if scale(best) <= 0:
        raise ValueError("the drift at k0 is not negative")
    return scale(best), best, sse(best)


def choose_tail(k: np.ndarray, g: np.ndarray, w: np.ndarray, k0: int, anchored: bool = True) -> tuple[str, float, float]:
    """(family, a, parameter) with the least weighted SSE; power wins ties."""
    fits = {family: fit_tail(k, g, w, k0, family, anchored) for family in TAILS}
    family = min(fits, key=lambda x: fits[x][2])
    return family, *fits[family][:2]


def held_out_loss(k: np.ndarray, g: np.ndarray, w: np.ndarray, k0: int, family: str, folds: int = 5, anchored: bool = False) -> float:
    """Weighted squared error on ranks from k0 on, each predicted by a fit that has not seen its block of ranks.

    Blocks are runs of neighbouring ranks, of five at least.  Where the fit is
    anchored, rank k0 is in every training set, as the anchor is.
    """
    own = k >= k0
    k, g, w = k[own], g[own], w[own]
    block = np.arange(len(k)) // max(5, -(-len(k) // folds))
    loss = 0.0
    for b in np.unique(block):
        test = (block == b) & ~((k == k0) & anchored)
        a, shape, _ = fit_tail(k[~test], g[~test], w[~test], k0, family, anchored)
        loss += float((w[test] * (g[test] + a * TAILS[family](k[test].astype(float), k0, shape)) ** 2).sum())
    return loss


def keep_head(g: np.ndarray, m: int, protect: int) -> np.ndarray:
    """Drifts with sum 0 and a tail that never decreases; the first ``protect`` keep their values if they can.

    What the sum lacks goes to the last m ranks.  Then the ranks after the head
    take their isotonic fit, which has the same sum, so the whole still sums to
    0.  A tail that never decreases has convex prefix sums: they start below 0
    where the head ends and reach 0 at the last rank, so they are below 0 in
    between, without any further shift.  Only the head can break that: one with
    a prefix sum of 0 or more is first lowered by the least constant that helps.
    """
    protect = min(protect, len(g) - 1)
    over = float((np.cumsum(g[:protect]) / np.arange(1, protect + 1)).max(initial=-math.inf))
    g = g - over - 1e-9 if over >= 0 else g.copy()
    m = min(m, len(g) - protect)
    g[len(g) - m :] -= g.sum() / m
    return np.append(g[:protect], pava(g[protect:], np.ones(len(g) - protect)))


def least_shift(g: np.ndarray, m: int) -> float:
    """The least c >= 0 by which all drifts must fall, so that prefix sums don't rise above 0 once the sum has gone to the last m.

    Before the last m ranks, a prefix of j ranks then sums to j (mean - c), so c
    is at least every such mean.  A prefix that ends among the last m is minus
    the sum of what follows: of j ranks with mean x that is
    j (x - c + (n c - S) / m), where S is the sum of all.  It is 0 or more if
    c (n - m) is at least S - m x, for the least such x.
    """
    n = len(g)
    need = float((np.cumsum(g[: n - m]) / np.arange(1, n - m + 1)).max(initial=0.0))
    if m > 1:
        after = float((np.cumsum(g[: n - m : -1]) / np.arange(1, m)).min())
        need = max(need, (float(g.sum()) - m * after) / (n - m))
    return need


def stationary(g: np.ndarray, variant: str, m: int, protect: int = 1000) -> tuple[np.ndarray, bool]:
    """Drifts shifted so that they sum to 0 with negative prefix sums, and whether that came out.

    variant ``uplift``: the sum goes to the last m ranks.  ``shift``: all are
    lowered first, by the least constant with which that gives negative prefix
    sums.  ``tail``: the head keeps its drifts (``keep_head``).
    """
    g, n = np.array(g, float), len(g)
    m = min(m, n - 1)
    if variant == "tail":
        g = keep_head(g, m, protect)
        return g, bool((np.cumsum(g)[:-1] < 0).all() and abs(g.sum()) <= 1e-7)
    if variant == "uplift" and g.sum() >= 0:
        return g, False
    if variant == "shift":
        g -= least_shift(g, m) + MARGIN * (1 + float(np.abs(g).max()))
    elif variant != "uplift":
        raise ValueError(variant)
    g[n - m :] -= g.sum() / m
    return g, bool((np.cumsum(g)[:-1] < 0).all() and abs(g.sum()) <= 1e-9)


def curve(g: np.ndarray, sigma2: np.ndarray | float, m1: float) -> dict[str, np.ndarray]:
    """Gap rates r, log curve m and weights of drifts g and variances sigma2 (a scalar, or one for each rank)."""
    s = np.broadcast_to(np.asarray(sigma2, float), len(g))
    prefix = np.cumsum(g)
    r = -4 * prefix[:-1] / (s[:-1] + s[1:])
    m = m1 - np.append(0, np.cumsum(1 / r))
    e = np.exp(m - m.max())
    return {"G": prefix, "r": r, "m": m, "mce": e / e.sum()}


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau of two vectors without ties in x, by counting inversions in a sort."""
    order = np.argsort(x, kind="stable")
    ranks = np.argsort(np.argsort(np.asarray(y)[order], kind="stable"), kind="stable").tolist()
    tree, inversions = [0] * (len(ranks) + 1), 0
    for seen, value in enumerate(ranks):
        i, below = value + 1, 0
        while i:
            below += tree[i]
            i &= i - 1
        inversions += seen - below
        i = value + 1
        while i <= len(ranks):
            tree[i] += 1
            i += i & -i
    n = len(ranks)
    return 1 - 4 * inversions / (n * (n - 1)) if n > 1 else math.nan


def variance_power(h: np.ndarray, v: np.ndarray) -> tuple[float, float, float]:
    """(A, beta, R2) of v = A h^beta by least squares; A is linear given beta."""
    scale = lambda b: float((v * h**b).sum() / (h ** (2 * b)).sum())
    sse = lambda b: float(((v - scale(b) * h**b) ** 2).sum())
    beta = golden(sse, -2.0, 3.0)
    total = float(((v - v.mean()) ** 2).sum())
    return scale(beta), beta, 1 - sse(beta) / total if total else math.nan
