"""Curves refitted on blocks of periods drawn with replacement: every replicate is a candidate of one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.operators import isotone, model
from ladderlens.tables import keep


def drawn(periods: DataFrame, period: str, replicates: int, block: int, seed: int) -> DataFrame:
    """(candidate, period, times, pairs): how often each replicate has a period, and has it with the one after it.

    A replicate is as many periods long as the panel, in blocks of neighbours
    whose starts a hash of the seed draws; the last block is cut.  Two periods
    are a pair where they follow each other within a block.
    """
    order = Window.orderBy(period)  # a row for each period
    own = periods.select(period).distinct().select(period, F.row_number().over(order).alias("_at"))
    span = own.agg(F.count("*").alias("_n"))
    blocks = periods.sparkSession.range(replicates).select(F.col("id").cast("int").alias("candidate")).crossJoin(F.broadcast(span))
    blocks = blocks.withColumn("_j", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block) - 1)))
    start = F.pmod(F.xxhash64("candidate", "_j", F.lit(seed)), F.greatest(F.col("_n") - block + 1, F.lit(1))) + 1
    places = blocks.withColumn("_start", start).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("_j") * block + F.col("_o") < F.col("_n"))
    pair = (F.col("_o") < block - 1) & (F.col("_j") * block + F.col("_o") + 1 < F.col("_n"))
    times = places.groupBy("candidate", (F.col("_start") + F.col("_o")).alias("_at")).agg(F.count("*").alias("times"), F.count_if(pair).alias("pairs"))
    return times.join(own, "_at").select("candidate", period, "times", "pairs")


def curves(growth: DataFrame, shares: DataFrame, draws: DataFrame, period: str) -> DataFrame:
    """(candidate, k, r, m_k, mce) of every replicate that can be fitted.

    growth: (period, k, g) to the period after, a row for each period and rank;
    shares: (period, k, log_share).  A replicate's mean growth by rank, less the
    market's, is made monotone, and stationary by the least shift with a tenth
    of the ranks; its prefix sums and the pooled variance give gaps, and these
    the curve, from the mean log share of rank 1.  Periods that are drawn more
    than once count as often.
    """
    draws = keep(draws, "draws")
    few = F.broadcast(draws.select("candidate", period, "times", "pairs"))  # replicates x periods rows
    x, w = F.col("g"), F.col("pairs")
    ranks = growth.where("g is not null").join(few, period).where("pairs > 0").groupBy("candidate", "k").agg(F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("mean"), F.sum(w * x * x).alias("_q"))
    ranks = ranks.withColumn("v", F.greatest(F.col("_q") - F.col("n") * F.col("mean") ** 2, F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0)))
    pooled = ranks.groupBy("candidate").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("gamma"), (F.sum(F.col("n") * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("sigma2"))
    first = shares.where("k = 1").join(few, period).groupBy("candidate").agg((F.sum(F.col("times") * F.col("log_share")) / F.sum("times")).alias("m1"))
    ranks = keep(ranks.join(pooled, "candidate").select("candidate", "k", "n", (F.col("mean") - F.col("gamma")).alias("y")), "replicates")
    iso = isotone.monotone(ranks, "y", "n")
    order = Window.partitionBy("candidate").orderBy("k")
    whole = Window.partitionBy("candidate")
    steps = iso.select("candidate", F.count("*").over(whole).cast("int").alias("n"), F.row_number().over(order).alias("k"), F.col("iso").alias("g")).where("n > 1")
    steps = model.shifted(steps, F.greatest(F.lit(1), F.floor(F.col("n") / 10).cast("int"))).where("feasible")
    return model.curves(steps.join(pooled, "candidate").join(first, "candidate"), F.col("sigma2"), F.col("m1")).select("candidate", "k", "r", "m_k", "mce")


def bands(fits: DataFrame, tops: list[int]) -> DataFrame:
    """(series, k, p10, p50, p90, replicates) of the log curve at each rank, and of the modelled share of the top ranks."""
    own = fits.select("candidate", F.lit("m").alias("series"), "k", F.col("m_k").alias("x"))
    sums = fits.groupBy("candidate").agg(*[F.sum(F.when(F.col("k") <= k, F.col("mce"))).alias(str(k)) for k in tops])
    share = sums.select("candidate", F.lit("top_share").alias("series"), F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("x")) for k in tops])))
    both = own.unionByName(share)
    return both.groupBy("series", "k").agg(*[F.percentile("x", p / 100).alias(f"p{p}") for p in (10, 50, 90)], F.count("*").alias("replicates"))  # a value a replicate
