"""Capital distribution curves: drift schedules, gap rates and candidate models, as windows over ranks.

Every window is partitioned by candidate, so candidates run in parallel and a
task holds the ranks of one (some 200 000 at most, whatever the panel's size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drift_from_gaps(head: DataFrame, sigma2: Column) -> DataFrame:
    """head with r (gap rate), big_g (prefix sum of drifts) and g, from mean log gaps ``delta``.

    A missing gap counts as the median gap.
    """
    order = Window.partitionBy("candidate").orderBy("k")
    middle = F.median("delta").over(Window.partitionBy("candidate"))
    out = head.withColumn("r", 1 / F.greatest(F.coalesce("delta", middle), F.lit(2.220446049250313e-16))).withColumn("big_g", -sigma2 / 2 * F.col("r"))
    return out.withColumn("g", F.col("big_g") - F.coalesce(F.lag("big_g").over(order), F.lit(0.0)))


def running_max(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """value made monotone: the largest so far."""
    return df.withColumn(value, F.max(value).over(Window.partitionBy(*group).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))


def schedule(head: DataFrame, sizes: Sequence[int], k0: int, alpha: float) -> DataFrame:
    """(candidate, n, k, g) for k up to n: the head's drift below k0, a power tail from there on, made monotone.

    Ranks that the head lacks take the drift of the one before.
    """
    ranks = head.select("candidate").distinct().withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
    order = Window.partitionBy("candidate", "n").orderBy("k")
    out = ranks.join(head.select("candidate", "k", F.col("g").alias("_head")), ["candidate", "k"], "left")
    out = out.withColumn("_head", F.last("_head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_anchor", F.max(F.when(F.col("k") == k0, F.col("_head"))).over(Window.partitionBy("candidate", "n")))
    tail = F.col("_anchor") * F.pow(F.col("k") / F.lit(float(k0)), F.lit(-alpha))
    return running_max(out.withColumn("g", F.when(F.col("k") < k0, F.col("_head")).otherwise(tail)), "g", ["candidate", "n"]).select("candidate", "n", "k", "g")


def held(head: DataFrame, n: int) -> DataFrame:
    """(candidate, n, k, g) for k up to n: ranks that the head lacks take the drift of the one before."""
    ranks = head.select("candidate").distinct().withColumn("n", F.lit(n)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    order = Window.partitionBy("candidate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ranks.join(head.select("candidate", "k", "g"), ["candidate", "k"], "left").withColumn("g", F.last("g", ignorenulls=True).over(order)).select("candidate", "n", "k", "g")


def uplift_sizes(n: Column, fixed: Sequence[int], least: int) -> Column:
    """The uplifts m for a size n: a fixed list, a twentieth and a tenth of n (``least`` at least), and all ranks but one."""
    own = [F.greatest(F.lit(least), F.floor(n / parts).cast("int")) for parts in (20, 10)]
    return F.array_distinct(F.array(*map(F.lit, fixed), *own, n.cast("int") - 1))


def uplifted(schedules: DataFrame, uplifts: Column) -> DataFrame:
    """Each schedule with each uplift m < n: its sum, spread over the last m ranks, is taken off; and prefix sums.

    uplifts is an array.  feasible: the sum was negative, and every prefix sum
    but the whole is.
    """
    own = schedules.withColumn("m", F.explode(uplifts)).where("m < n")
    whole = Window.partitionBy("candidate", "n", "m")
    total = F.sum("g").over(whole)
    own = own.withColumn("_s", total).withColumn("g", F.col("g") - F.when(F.col("k") > F.col("n") - F.col("m"), F.col("_s") / F.col("m")).otherwise(0.0))
    own = own.withColumn("big_g", F.sum("g").over(whole.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return own.withColumn("feasible", (F.col("_s") < 0) & (F.max(F.when(F.col("k") < F.col("n"), F.col("big_g"))).over(whole) < 0)).drop("_s")


def shifted(schedules: DataFrame, m: Column, margin: float = 1e-10) -> DataFrame:
    """Schedules lowered by the least constant with which prefix sums stay below 0 once the sum has gone to the last m ranks; and prefix sums.

    The constant is the largest mean of a prefix before those ranks, or what
    the least mean of the ranks after any of them asks for
    (``numeric.least_shift``).  k runs from 1 to n without gaps.
    """
    whole = Window.partitionBy("candidate", "n")
    order = whole.orderBy("k")
    k, n = F.col("k"), F.col("n")
    own = schedules.withColumn("m", F.least(m, n - 1)).withColumn("_s", F.sum("g").over(whole)).withColumn("_most", F.max(F.abs("g")).over(whole))
    before = F.sum("g").over(order.rowsBetween(Window.unboundedPreceding, 0)) / k
    after = F.sum("g").over(order.rowsBetween(1, Window.unboundedFollowing)) / (n - k)
    own = own.withColumn("_before", F.when(k <= n - F.col("m"), before)).withColumn("_after", F.when((k > n - F.col("m")) & (k < n), after))
    tail = (F.col("_s") - F.col("m") * F.min("_after").over(whole)) / (n - F.col("m"))
    need = F.greatest(F.lit(0.0), F.max("_before").over(whole), tail) + margin * (1 + F.col("_most"))
    own = own.withColumn("_c", need)
    lift = F.when(k > n - F.col("m"), (F.col("_s") - n * F.col("_c")) / F.col("m")).otherwise(0.0)
    own = own.withColumn("g", F.col("g") - F.col("_c") - lift)
    own = own.withColumn("big_g", F.sum("g").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    feasible = (F.max(F.when(k < n, F.col("big_g"))).over(whole) < 0) & (F.abs(F.sum("g").over(whole)) <= 1e-9)
    return own.withColumn("feasible", feasible).drop("_s", "_most", "_before", "_after", "_c")


def first_feasible(candidates: DataFrame) -> DataFrame:
    """The rows of each (candidate, n) with its least feasible m."""
    least = F.min(F.when(F.col("feasible"), F.col("m"))).over(Window.partitionBy("candidate", "n"))
    return candidates.withColumn("_m", least).where("m = _m").drop("_m")


def curves(candidates: DataFrame, sigma2: Column, m1: Column) -> DataFrame:
    """Candidates with gap rates r, the log curve m_k and the weights mce, which sum to 1.

    Without variance (sigma2 is 0) the rates are infinite and the curve is flat.
    """
    group = Window.partitionBy("candidate", "n", "m")
    order = group.orderBy("k")
    rate = F.when(sigma2 == 0, F.signum(-F.col("big_g")) * float("inf")).otherwise(F.try_divide(-2 * F.col("big_g"), sigma2))
    out = candidates.withColumn("r", F.when(F.col("k") < F.col("n"), rate)).withColumn("rho", F.try_divide(F.lit(1.0), "r"))
    out = out.withColumn("m_k", m1 - F.coalesce(F.sum("rho").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("_e", F.exp(F.col("m_k") - F.max("m_k").over(group)))
    return out.withColumn("mce", F.col("_e") / F.sum("_e").over(group)).drop("_e")


def scores(models: DataFrame, head: DataFrame, top_share: DataFrame, k_head: int, weight: float = 1.0) -> DataFrame:
    """(candidate, n, m): how far the curve is from the mean log shares, and its top share from the one observed."""
    met = models.where(F.col("k") <= k_head).join(head.select("candidate", "k", "mhat"), ["candidate", "k"])
    fit = met.groupBy("candidate", "n", "m").agg(F.sqrt(F.avg((F.col("m_k") - F.col("mhat")) ** 2)).alias("rmse"), F.sum("mce").alias("modelled_share"))
    out = fit.crossJoin(F.broadcast(top_share)).withColumn("share_gap", F.abs(F.col("modelled_share") - F.col("top_share")))
    return out.withColumn("score", F.col("rmse") + weight * F.col("share_gap"))
