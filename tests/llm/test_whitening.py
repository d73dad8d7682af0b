import math
import random

import numpy as np

from ladderlens.llm import whitening as w
from ladderlens.llm.queries import op13_whitening


def test_symmetric_qr():
    r = np.random.default_rng(2)
    tried = [np.zeros((3, 3)), np.eye(5), np.diag([3.0, 3, 1, 0]), np.array([[2.0]]), np.ones((6, 6))]
    for n in (2, 3, 8, 40, 64):
        a = r.standard_normal((n + 5, n)) * 10.0 ** r.integers(-3, 4)
        tried.append(a.T @ a)
        tried.append(a.T @ a - 20 * np.eye(n))
    for a in tried:
        values, axes = w.symmetric_qr(a)
        scale = max(1e-300, float(np.abs(a).max())) * len(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * scale)
        assert np.abs(axes @ axes.T - np.eye(len(a))).max() < 1e-12
        assert np.abs(a @ axes.T - axes.T * values).max() < 1e-12 * scale


def test_moments_merge_in_any_cut():
    r = np.random.default_rng(3)
    x = np.floor(r.standard_normal((300, 7)) * 50) + 10**6
    want = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for _ in range(10):
        total = w.Moments(7)
        for part in np.split(x, sorted(r.integers(0, 301, 4))):
            own = w.Moments(7)
            for row in part:
                own.add(row)
            total.merge(own.n, own.mean, own.squares)
        assert total.n == 300 and np.allclose(total.mean, x.mean(axis=0)) and np.allclose(total.squares, want, rtol=1e-9)


def plain(vectors, components=4):
    """vec_id -> rows of the query, for vectors of one length."""
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in fine})
    n, dim = len(distinct), len(distinct[0])
    s = [sum(x[k] for x in distinct) for k in range(dim)]
    centred = np.array(distinct, float) - np.array([v / n for v in s])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes.T[::-1][:components]
    out = {}
    for i, x in fine:
        z = axes @ (np.array(x, float) - np.array([v / n for v in s])) / np.sqrt(values)
        out[i] = (n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), z, values)
    return out, centred


def test_rows_equal_numpy(spark, tmp_path):
    r = np.random.default_rng(7)
    mix = r.standard_normal((12, 12)) * np.linspace(3, 0.2, 12)
    vectors = [(i, [float(np.float32(c)) for c in r.standard_normal(12) @ mix]) for i in range(2000)]
    vectors += [(5000 + i, vectors[3][1]) for i in range(1500)]  # one vector in many rows
    vectors += [(8000 + i, [c + 1e-9 for c in vectors[4][1]]) for i in range(3)]  # may be equal once they are whole numbers
    vectors += [(9000, None), (9001, [float("nan")] * 12), (9002, [0.0] * 11 + [float("inf")]), (9003, [1.0] * 11 + [None]), (2**60 + 1, vectors[0][1])]
    random.Random(1).shuffle(vectors)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(9).selectExpr("*", "1 as component", "2 as x", "3 as `a``b`")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_whitening(spark, str(tmp_path)).collect()
    want, centred = plain([(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors])
    assert len(got) == 4 * len(want) and {x["vec_id"] for x in got} == set(want)
    signs = {}
    for x in got:
        n, deviation, z, values = want[x["vec_id"]]
        k = x["component"] - 1
        assert (x["n"], x["deviation"]) == (n, deviation)
        signs.setdefault(k, set()).add(np.sign(x["whitened"]) == np.sign(z[k]) or abs(z[k]) < 1e-9)
        assert abs(abs(x["whitened"]) - abs(z[k])) < 1e-9
        assert abs(x["explained"] - values[k] / np.trace(centred.T @ centred / n)) < 1e-10 and x["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (None, [3.0, 2.0]), (2, []), (3, [7.0]), (4, [7.0]), (5, [1e300, -1e300, 0.0]), (6, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = w.whiten(df, ["vec_id"]).collect()
    one = [x for x in got if x["vec_id"] in (3, 4)]
    assert len(one) == 2 and all((x["n"], x["deviation"], x["whitened"], x["explained"], x["identity_error"]) == (1, 0, None, None, None) for x in one)
    two = sorted((x["vec_id"] or 0, x["component"], x["n"], x["deviation"]) for x in got if x["vec_id"] in (None, 1))
    assert two == [(0, 1, 2, 512**2), (0, 1, 2, 512**2), (0, 2, 2, 512**2), (0, 2, 2, 512**2), (1, 1, 2, 512**2), (1, 2, 2, 512**2)]
    assert all(abs(abs(x["whitened"]) - 1) < 1e-12 and abs(x["explained"] - 1) < 1e-12 for x in got if x["vec_id"] in (None, 1) and x["component"] == 1)
    assert all(x["whitened"] is None for x in got if x["vec_id"] in (None, 1) and x["component"] == 2)
    huge = [x for x in got if x["vec_id"] == 5]
    assert len(huge) == 3 and all(x["deviation"] is None for x in huge) and not [x for x in got if x["vec_id"] == 2]
    assert w.whiten(df.limit(0), ["vec_id"]).count() == 0
