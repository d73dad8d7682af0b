import math

import numpy as np

from ladderlens.functions import bandwidth
from ladderlens.operators import density


def test_pairs_are_counted():
    counts = np.array([2, 0, 3, 1])
    x = np.repeat(np.arange(4), counts)
    want = np.bincount([abs(a - b) for i, a in enumerate(x) for b in x[i + 1 :]], minlength=4)
    assert bandwidth.pair_counts(counts).tolist() == want.tolist()


def slow_equation(x, h):
    """What Sheather and Jones' equation is off by at h, from all pairs of values."""
    n, d = len(x), x[:, None] - x[None, :]
    phi = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    psi4 = lambda g: ((d / g) ** 4 - 6 * (d / g) ** 2 + 3) * phi(d / g)
    psi6 = lambda g: ((d / g) ** 6 - 15 * (d / g) ** 4 + 45 * (d / g) ** 2 - 15) * phi(d / g)
    spread = min(x.std(ddof=1), np.subtract(*np.percentile(x, [75, 25])) / 1.349)
    a, b = 1.24 * spread * n ** (-1 / 7), 1.23 * spread * n ** (-1 / 9)
    s, t = psi4(a).sum() / (n * (n - 1) * a**5), -psi6(b).sum() / (n * (n - 1) * b**7)
    g = 1.357 * (s / t) ** (1 / 7) * h ** (5 / 7)
    return (1 / (2 * math.sqrt(math.pi) * n * (psi4(g).sum() / (n * (n - 1) * g**5)))) ** 0.2 - h


def test_the_bandwidth_solves_its_equation():
    r = np.random.default_rng(1)
    for x in (r.standard_normal(300), np.concatenate([r.standard_normal(200), 6 + 0.5 * r.standard_normal(150)]), r.gamma(2, size=250)):
        width = np.ptp(x) / 4000
        counts = np.bincount(np.minimum(((x - x.min()) / width).astype(int), 3999), minlength=4000)
        h = bandwidth.sheather_jones(counts, width, x.std(ddof=1), float(np.subtract(*np.percentile(x, [75, 25]))))
        assert abs(slow_equation(x, h)) < 0.01 * h


def test_odd_values_have_the_rule_of_thumb():
    assert bandwidth.sheather_jones(np.array([5.0]), 1.0, 0.0, 0.0) == 0.0
    assert bandwidth.sheather_jones(np.array([1.0, 1.0]), 1.0, 0.7, 0.5) > 0


def test_densities_equal_sums_of_kernels(spark):
    r = np.random.default_rng(2)
    rows = [(h, k, float(x)) for h in (1, 2) for k in (1, 4) for x in r.standard_normal(150) * h + k]
    rows += [(3, 1, 5.0), (3, 1, 5.0), (1, 1, None), (1, 1, float("nan"))]
    df = spark.createDataFrame(rows, "horizon int, k int, g double")
    got = density.densities(df, "g", ["horizon"], ["k"]).toPandas()
    assert set(zip(got["horizon"], got["k"], strict=True)) == {(h, k) for h in (1, 2) for k in (1, 4)} and len(got) == 4 * density.POINTS
    for (h, k), part in got.groupby(["horizon", "k"]):
        x = np.array([v for a, b, v in rows if a == h and b == k and v == v and v is not None])
        all_ = np.array([v for a, _, v in rows if a == h and v is not None and v == v])
        bw = float(part["bw"].iloc[0])
        assert part["bw"].nunique() == 1 and abs(slow_equation(all_, bw)) < 0.03 * bw and (part["n"] == 150).all()
        want = np.exp(-0.5 * ((part["x"].to_numpy()[:, None] - x) / bw) ** 2).sum(axis=1) / (150 * bw * math.sqrt(2 * math.pi))
        assert np.abs(part["density"].to_numpy() - want).max() < 2e-3 * want.max()
        assert abs(np.trapezoid(part["density"], part["x"]) - 1) < 0.01
