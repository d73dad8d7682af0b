import numpy as np
import pytest

from ladderlens.functions import pooling
from ladderlens.operators import isotone


def some_vector(r):
    n = int(r.integers(1, 40))
    y = np.round(r.standard_normal(n) * 2 + np.linspace(0, r.random() * 3, n), int(r.integers(0, 4)))
    return y, r.integers(1, 6, n).astype(float) if r.random() < 0.5 else r.random(n) + 0.1


def blocks(y, w, penalty=0.0):
    linear = np.zeros(len(y))
    linear[0] -= penalty
    linear[-1] += penalty
    return [pooling.Block(i, i, y[i : i + 1], w[i : i + 1], float(linear[i])) for i in range(len(y))]


def levels(found):
    return np.repeat([b.level for b in found], [b.to - b.at + 1 for b in found])


def max_min(y, w):
    """Isotonic means as the largest over starts of the least over ends."""
    cw, cy = np.append(0, np.cumsum(w)), np.append(0, np.cumsum(w * y))
    n = len(y)
    return [max(min((cy[j + 1] - cy[i]) / (cw[j + 1] - cw[i]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_squares_equal_the_max_min_formula():
    r = np.random.default_rng(1)
    for _ in range(200):
        y, w = some_vector(r)
        assert np.allclose(levels(pooling.pool(blocks(y, w), pooling.Squares())), max_min(y, w))


def optimal(y, w, x, penalty, loss):
    """Whether no level of a block can move: subgradients of the loss, summed over the start of any block, are 0 or less, and 0 over all of it."""
    linear = np.zeros(len(y))
    linear[0] -= penalty
    linear[-1] += penalty
    width = loss.width if isinstance(loss, pooling.Huber) else np.inf
    slope = 2 * w * np.clip(x - y, -width, width) + linear
    if (np.diff(x) < -1e-12).any():
        return False
    edges = [0, *(np.flatnonzero(np.diff(x) > 1e-12) + 1).tolist(), len(x)]
    for a, b in zip(edges, edges[1:], strict=False):
        part = np.cumsum(slope[a:b])
        if abs(part[-1]) > 1e-7 or (part > 1e-7).any():
            return False
    return True


def test_robust_and_penalized_fits_are_optimal():
    r = np.random.default_rng(2)
    for _ in range(400):
        y, w = some_vector(r)
        penalty = float(r.choice([0.0, 0.1, 0.5])) * w.min()
        for loss in (pooling.Squares(), pooling.Huber(1.0), pooling.Huber(0.3)):
            if len(y) > 1 or not penalty:
                assert optimal(y, w, levels(pooling.pool(blocks(y, w, penalty), loss)), penalty, loss)


def test_pooling_slices_first_changes_nothing():
    r = np.random.default_rng(3)
    for _ in range(100):
        y, w = some_vector(r)
        for loss in (pooling.Squares(), pooling.Huber(0.5)):
            whole = levels(pooling.pool(blocks(y, w), loss))
            cut = int(r.integers(0, len(y) + 1))
            halves = pooling.pool(blocks(y, w)[:cut], loss) + pooling.pool(blocks(y, w)[cut:], loss)
            assert np.allclose(levels(pooling.pool(halves, loss)), whole)


def test_a_huge_penalty_leaves_one_level():
    y, w = np.array([1.0, 2, 3]), np.ones(3)
    for loss in (pooling.Squares(), pooling.Huber(1.0)):
        assert np.ptp(levels(pooling.pool(blocks(y, w, 100.0), loss))) == 0


def test_fused_fits_meet_their_conditions():
    """The running sum of the residuals stays within the penalty, and is at it where the fit steps."""
    r = np.random.default_rng(4)
    for _ in range(300):
        y, w = some_vector(r)
        penalty = float(r.choice([0, 0.02, 0.3, 1, 5]) * r.random())
        x = pooling.fused(y, w, penalty)
        u = np.cumsum(w * (y - x))
        assert abs(u[-1]) < 1e-8 and (np.abs(u) <= penalty + 1e-8).all()
        step = np.flatnonzero(np.abs(np.diff(x)) > 1e-9)
        assert np.allclose(u[step], -penalty * np.sign(np.diff(x)[step]), atol=1e-7)
        most = pooling.most_penalty(y, w)
        assert np.ptp(pooling.fused(y, w, most * (1 + 1e-9))) < 1e-9
        assert most < 1e-9 or np.ptp(pooling.fused(y, w, most * 0.99)) > 0


@pytest.mark.parametrize("loss", [pooling.Squares(), pooling.Huber(0.5)])
def test_slices_don_t_show(spark, loss):
    r = np.random.default_rng(5)
    shapes = {1: -np.arange(300.0), 2: np.arange(300.0), 3: r.standard_normal(300), 4: np.concatenate([np.arange(150.0), np.full(150, -5.0)]), 5: np.sin(np.arange(300) / 20) * 3, 6: np.array([2.0])}
    rows = [(c, int(3 * i + 1), float(v), float(1 + i % 4)) for c, y in shapes.items() for i, v in enumerate(y)]
    rows += [(3, 1000, None, 1.0), (3, 1001, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "candidate int, k int, y double, w double")
    got = {(x["candidate"], x["k"]): x["iso"] for x in isotone.monotone(df, "y", "w", penalty=0.5, loss=loss, slice_rows=64).collect()}
    assert len(got) == sum(map(len, shapes.values()))
    for c, y in shapes.items():
        want = levels(pooling.pool(blocks(y, np.array([1.0 + i % 4 for i in range(len(y))]), 0.5), loss))
        assert np.allclose([got[c, 3 * i + 1] for i in range(len(y))], want)


def test_fused_candidates(spark):
    r = np.random.default_rng(6)
    y, w = r.standard_normal(60), r.random(60) + 0.5
    df = spark.createDataFrame([(c, i + 1, float(y[i] * c), float(w[i])) for c in (1, 2) for i in range(60)], "candidate int, k int, y double, w double")
    got = isotone.fused(df, "y", "w", [0.1, 0.5, 3.0]).collect()
    assert len(got) == 360
    for x in got:
        penalty = min(x["part"], 1.0) * pooling.most_penalty(y * x["candidate"], w)
        assert abs(x["penalty"] - penalty) < 1e-9 and abs(x["smooth"] - pooling.fused(y * x["candidate"], w, penalty)[x["k"] - 1]) < 1e-9
