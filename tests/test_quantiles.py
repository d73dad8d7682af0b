import random

from pyspark.sql import functions as F

from ladderlens.operators.quantiles import quantiles


def test_equal_to_percentile(spark):
    r = random.Random(1)
    rows = [("wide", r.choice([-1, 1]) * 10 ** r.uniform(-300, 300)) for _ in range(500)]
    rows += [("tied", float(r.randrange(3))) for _ in range(400)] + [("one", 4.5)] + [(None, r.gauss(0, 1)) for _ in range(301)]
    rows += [("hot", 7.0)] * 600 + [("hot", 8.0), ("huge", 1e308), ("huge", -1e308), ("none", None), ("wide", float("nan")), ("wide", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    parts = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    want = df.where("abs(x) < double('inf')").groupBy("g").agg(F.percentile("x", parts).alias("q")).select("g", F.posexplode("q").alias("i", "q")).collect()
    want = {(x["g"], parts[x["i"]]): x["q"] for x in want}
    for slices, most in ((4, 10), (1024, 100_000)):
        got = {(x["g"], x["p"]): x["q"] for x in quantiles(df, "x", parts, ["g"], slices, most).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-12 * max(abs(want[k]), 1e-300) or k[0] == "huge" for k in want)
        assert got["huge", 0.0] == -1e308 and got["huge", 1.0] == 1e308
    whole = quantiles(df.where("g = 'tied'"), "x", [0.5], (), 2, 5).collect()
    assert len(whole) == 1 and whole[0]["q"] == want["tied", 0.5]
    assert quantiles(df.limit(0), "x", [0.5]).count() == 0
