import datetime

import numpy as np
from pyspark.sql import functions as F

from ladderlens.functions import numeric
from ladderlens.operators import bootstrap

WEEKS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=7 * i) for i in range(30)]


def some_panel():
    r = np.random.default_rng(1)
    return [(w, k, float(0.3 * r.standard_normal() + 0.02 * (k - 6)), float(-1 - 0.4 * k + 0.1 * r.standard_normal())) for w in WEEKS for k in range(1, 13)]


def test_replicates_are_as_long_as_the_panel(spark):
    df = spark.createDataFrame([(w,) for w in WEEKS], "week date")
    got = bootstrap.drawn(df, "week", 40, 8, 42).groupBy("candidate").agg(F.sum("times").alias("t"), F.sum("pairs").alias("p"), F.max("times").alias("most")).collect()
    assert len(got) == 40 and {r["t"] for r in got} == {30} and {r["p"] for r in got} == {7 + 7 + 7 + 5} and max(r["most"] for r in got) > 1
    again = bootstrap.drawn(df.repartition(3), "week", 40, 8, 42)
    assert again.exceptAll(bootstrap.drawn(df, "week", 40, 8, 42)).count() == 0
    assert bootstrap.drawn(df.limit(3), "week", 2, 8, 1).agg(F.sum("times")).first()[0] == 6


def test_curves_equal_a_plain_refit_of_each_replicate(spark):
    rows = some_panel()
    df = spark.createDataFrame(rows, "week date, k int, g double, log_share double")
    draws = bootstrap.drawn(df, "week", 25, 8, 42).cache()
    fits = bootstrap.curves(df, df, draws, "week")
    got = {}
    for x in fits.collect():
        got.setdefault(x["candidate"], {})[x["k"]] = (x["m_k"], x["mce"])
    kept = 0
    for b in range(25):
        own = {r["week"]: r for r in draws.where(F.col("candidate") == b).collect()}
        g = np.array([[v for w, kk, v, _ in rows if kk == k for _ in range(own[w]["pairs"] if w in own else 0)] for k in range(1, 13)])
        n, mean, var = g.shape[1], g.mean(axis=1), g.var(axis=1, ddof=1)
        iso = numeric.pava(mean - mean.mean(), np.full(12, float(n)))
        m1 = np.mean([s for w, kk, _, s in rows if kk == 1 for _ in range(own[w]["times"] if w in own else 0)])
        drift, fine = numeric.stationary(iso, "shift", 1)
        kept += fine
        want = numeric.curve(drift, float(var.mean()), float(m1))
        assert np.allclose([got[b][k][0] for k in range(1, 13)], want["m"]) and np.allclose([got[b][k][1] for k in range(1, 13)], want["mce"])
    assert kept == len(got) == 25
    bands = {(r["series"], r["k"]): r for r in bootstrap.bands(fits, [3]).collect()}
    tops = [sum(own[k][1] for k in (1, 2, 3)) for own in got.values()]
    assert abs(bands["top_share", 3]["p50"] - np.median(tops)) < 1e-12 and bands["m", 5]["replicates"] == kept


def test_a_replicate_without_variance_has_a_flat_curve(spark):
    start = datetime.date(2024, 1, 1)
    rows = [(start + datetime.timedelta(days=7 * w), k, -0.01 / k if w < 2 else None, -float(k)) for w in range(3) for k in range(1, 13)]
    df = spark.createDataFrame(rows, "week date, k int, g double, log_share double")
    draws = bootstrap.drawn(df, "week", 4, 8, 42)
    got = bootstrap.curves(df, df, draws, "week").collect()
    assert len(got) == 4 * 12 and all(abs(r["m_k"] + 1) < 1e-9 and abs(r["mce"] - 1 / 12) < 1e-9 for r in got)
    assert {r["replicates"] for r in bootstrap.bands(bootstrap.curves(df, df, draws, "week"), [3]).collect()} == {4}
