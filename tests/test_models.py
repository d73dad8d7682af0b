"""Queries over models that have no SQL."""

import os

import pytest

from ladderlens import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bootstrap_has_all_replicates_and_the_share_of_the_top(spark):
    rows = catalog.QUERIES["m39_block_bootstrap"](spark, SF).collect()
    assert max(r["replicates"] for r in rows) == 200
    assert all(r["p10"] <= r["p50"] <= r["p90"] for r in rows)
    (top,) = [r for r in rows if r["series"] == "top_share"]
    assert top["replicates"] == 200 and 0 < top["p10"] <= top["p90"] <= 1 + 1e-9


def test_simulation_has_all_first_day_ranks_paths_and_days(spark):
    from pyspark.sql import functions as F

    from ladderlens.plans.inputs import user_days

    got = catalog.QUERIES["m37_simulation"](spark, SF)
    n = user_days(spark, SF).orderBy("date").groupBy("date").count().orderBy("date").first()["count"]
    assert got.count() == 100 * 365 * n
    assert got.groupBy("path", "day").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_shifted_schedules_equal_the_vector_form(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from ladderlens.functions import numeric
    from ladderlens.operators import model

    r = np.random.default_rng(3)
    vectors = {(c, n): np.sort(r.standard_normal(n) - 0.3) if c else r.standard_normal(n) for c in (0, 1) for n in (2, 9, 40)}
    rows = [(c, n, k + 1, float(x)) for (c, n), g in vectors.items() for k, x in enumerate(g)]
    df = spark.createDataFrame(rows, "candidate int, n int, k int, g double")
    got = {(x["candidate"], x["n"], x["k"]): x for x in model.shifted(df, F.lit(4)).collect()}
    assert len(got) == len(rows)
    for (c, n), g in vectors.items():
        want, fine = numeric.stationary(g, "shift", 4)
        assert fine and all(got[c, n, k + 1]["feasible"] for k in range(n))
        assert np.allclose([got[c, n, k + 1]["g"] for k in range(n)], want) and np.allclose([got[c, n, k + 1]["big_g"] for k in range(n)], np.cumsum(want), atol=1e-9)
