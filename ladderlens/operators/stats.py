"""Statistics by rank, and regressions as weighted sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.operators import pairs
from ladderlens.operators.quantiles import quantiles
from ladderlens.tables import keep


def rank_summary(df: DataFrame, rank: str, value: str, least: int = 1) -> DataFrame:
    """(k, mean, middle, variance, n) of value for each rank with at least so many rows."""
    out = df.groupBy(F.col(rank).alias("k")).agg(F.avg(value).alias("mean"), F.median(value).alias("middle"), F.var_samp(value).alias("variance"), F.count(value).alias("n"))
    return out.where(F.col("n") >= least)


def rank_table(panel: DataFrame, period: str, value: str, rank: str, rows: str, k_max: int, days: int) -> DataFrame:
    """A row for each rank k up to k_max, from one pass over a panel with unique ranks, as a written table.

    bar_g, v, n: mean, variance and number of growths to ``days`` later; delta:
    mean log gap to the next rank; mhat: mean log value; value_sum and periods:
    the sum of the values, and how many there are.  rows is the panel's column
    with the number of rows of a period: a period lacks a gap only at its last
    rank, so sums of logs by rank, with those of last ranks apart, give all gaps.
    """
    own = pairs.growth_pairs(panel, period, value, rank, [1], days, "left").where(F.col(rank) <= k_max + 1)
    log, last = F.ln(value), F.col(rank) == F.col(rows)
    sums = own.groupBy(F.col(rank).alias("k")).agg(
        F.avg("g").alias("bar_g"),
        F.var_samp("g").alias("v"),
        F.nullif(F.count("g"), F.lit(0)).alias("n"),
        F.avg(log).alias("mhat"),
        F.sum(value).alias("value_sum"),
        F.count("*").alias("periods"),
        F.coalesce(F.sum(F.when(~last, log)), F.lit(0.0)).alias("_before"),
    )
    sums = keep(sums, "ranks")  # a row a rank: what starts from here is small
    after = sums.select((F.col("k") - 1).alias("k"), F.col("periods").alias("_gaps"), (F.col("mhat") * F.col("periods")).alias("_after"))
    out = sums.where(F.col("k") <= k_max).join(after, "k", "left").withColumn("delta", (F.col("_before") - F.col("_after")) / F.col("_gaps"))
    return out.select("k", "bar_g", "v", "n", "delta", "mhat", "value_sum", "periods")


def share_of_top(ranks: DataFrame, k: int) -> DataFrame:
    """One row: the mean over periods of the share of the top k, from a rank table of shares; every period has a rank 1."""
    top = F.sum(F.when(F.col("k") <= k, F.col("value_sum")))
    return ranks.agg((top / F.max(F.when(F.col("k") == 1, F.col("periods")))).alias("top_share"))


def top_share(weekly: DataFrame, k: int) -> DataFrame:
    """One row: the mean over weeks of the share of the top k."""
    return weekly.groupBy("week_start").agg(F.sum(F.when(F.col("rank_w") <= k, F.col("weekly_share"))).alias("s")).agg(F.avg("s").alias("top_share"))


def order_weights(df: DataFrame, value: str, weight: str, group: Sequence[str]) -> DataFrame:
    """df with cw: the share of the group's weight up to a row, in the order of value (then k)."""
    order = Window.partitionBy(*group).orderBy(value, "k").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cw", F.sum(weight).over(order) / F.sum(weight).over(Window.partitionBy(*group)))


def trimmed_mean(df: DataFrame, value: str, weight: str, trim: float, group: Sequence[str]) -> DataFrame:
    """Weighted mean of the rows whose cumulative weight is within [trim, 1 - trim]; of all if there is none."""
    cut = order_weights(df, value, weight, group)
    keep = F.col("cw").between(trim, 1 - trim)
    mean = lambda ok: F.sum(F.when(ok, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(ok, F.col(weight))), F.lit(0))
    return cut.groupBy(*group).agg(F.coalesce(mean(keep), mean(F.lit(True))).alias("trimmed"))


def weighted_median(df: DataFrame, value: str, weight: str, group: Sequence[str]) -> DataFrame:
    """The least value at which half of the weight is reached."""
    return order_weights(df, value, weight, group).where("cw >= 0.5").groupBy(*group).agg(F.min(value).alias("weighted_median"))


def brown_forsythe(df: DataFrame, group: Column, value: str) -> DataFrame:
    """One row: F of the groups' spread around their medians, with its degrees of freedom; there are few groups, of any size."""
    own = df.select(group.alias("_g"), F.col(value).alias("_x"))
    mid = quantiles(own, "_x", [0.5], ["_g"]).select("_g", F.col("q").alias("_mid"))
    z = own.join(F.broadcast(mid), "_g").select("_g", F.abs(F.col("_x") - F.col("_mid")).alias("z"))
    by = z.groupBy("_g").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.sum(F.col("z") * F.col("z")).alias("squares"))
    whole = by.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("total"), F.sum(F.col("n") * F.col("mean") ** 2).alias("between"), F.sum("squares").alias("squares"))
    between = F.col("between") - F.col("total") ** 2 / F.col("n")
    within = F.col("squares") - F.col("between")
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    return whole.select(F.try_divide(between / F.nullif(d1, F.lit(0)), within / F.nullif(d2, F.lit(0))).alias("f"), d1.alias("d1"), d2.alias("d2"))


def weighted_line(df: DataFrame, x: Column, y: Column, w: Column, group: Sequence[str] = ()) -> DataFrame:
    """Weighted regression of y on x and on a constant: coefficients, R2, AIC and BIC of both."""
    own = df.select(*group, x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w")).where("x is not null and y is not null and w > 0")
    s = own.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(F.ln("w")).alias("lw"), F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.expr(e)).alias(a) for a, e in (("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("sxy", "x * y"), ("syy", "y * y"))]
    )
    s = s.withColumn("slope", F.expr("(sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0D)")).withColumn("intercept", F.expr("(sy - slope * sx) / sw"))
    s = s.withColumn("rss", F.expr("syy - intercept * sy - slope * sxy")).withColumn("rss0", F.expr("syy - sy * sy / sw"))
    log_lik = "0.5D * (lw - n * (ln(2 * pi()) + 1 - ln(n) + ln({})))"
    s = s.withColumn("ll", F.expr(log_lik.format("rss"))).withColumn("ll0", F.expr(log_lik.format("rss0")))
    return s.select(
        *group, "n", "slope", "intercept", F.expr("1 - rss / rss0").alias("r2"), *[F.expr(e).alias(a) for a, e in (("aic", "6 - 2 * ll"), ("bic", "3 * ln(n) - 2 * ll"), ("aic_constant", "4 - 2 * ll0"), ("bic_constant", "2 * ln(n) - 2 * ll0"))]
    )


def power_law(df: DataFrame, rank: str, value: str, segments: Sequence[tuple[int, int]], group: Sequence[str] = ()) -> DataFrame:
    """(group, low, high): slope of ln(value) on ln(rank) in each segment, its standard error, R2 and n."""
    own = df.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in segments])))
    own = own.where(F.col(rank).between(F.col("_s.low"), F.col("_s.high")) & (F.col(value) > 0)).select(*group, "_s.low", "_s.high", F.ln(rank).alias("x"), F.ln(value).alias("y"))
    out = own.groupBy(*group, "low", "high").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"), F.regr_sxx("y", "x").alias("_xx"), F.regr_syy("y", "x").alias("_yy"))
    error = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r2")) * F.col("_yy") / F.nullif((F.col("n") - 2) * F.col("_xx"), F.lit(0.0)))
    return out.select(*group, "low", "high", (-F.col("slope")).alias("alpha"), error.alias("std_error"), "intercept", "r2", "n")
