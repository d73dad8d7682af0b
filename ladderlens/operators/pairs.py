"""Pairs of a panel's rows at two times, and growth between them.

What "the next time" means is always explicit: an exact number of days
(``growth_pairs``), the next kept period (``ordinal_pairs``), or the next row
of the endpoint (``lead_pairs``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_horizons(panel: DataFrame, period: str, horizons: Sequence[int], days: int = 1) -> DataFrame:
    """Each row once for each horizon, with the period (``_next``) that lies horizon x days ahead."""
    out = panel.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return out.withColumn("_next", F.date_add(period, F.col("horizon") * days))


def growth_pairs(panel: DataFrame, period: str, value: str, rank: str, horizons: Sequence[int], days: int = 1, how: str = "inner") -> DataFrame:
    """Rows of the panel with value_next and rank_next of the same endpoint at each horizon, and g, the growth of the log.

    (period, endpoint) is unique in a panel, so what lies exactly horizon x
    days ahead is a range frame of one row: all horizons share one exchange by
    endpoint, and nothing is joined.  how="left" keeps rows whose endpoint is
    gone by then; their g is null.
    """
    order = Window.partitionBy("endpoint_id").orderBy(F.unix_date(period))
    ahead = {f"_{c}{h}": F.first(name).over(order.rangeBetween(h * days, h * days)) for h in horizons for c, name in (("v", value), ("r", rank))}
    met = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_v{h}").alias("value_next"), F.col(f"_r{h}").alias("rank_next")) for h in horizons])
    if how == "inner":
        met = F.filter(met, lambda x: x["value_next"].isNotNull())
    pairs = panel.withColumns(ahead).select(*panel.columns, F.inline(met))
    return pairs.withColumn("g", F.ln("value_next") - F.ln(value))


def observed_starts(panel: DataFrame, period: str, horizons: Sequence[int], days: int = 1) -> DataFrame:
    """(period, horizon) for which the panel has both ends."""
    own = panel.select(period).distinct()
    return at_horizons(own, period, horizons, days).join(own.select(F.col(period).alias("_next")), "_next", "left_semi").select(period, "horizon")


def ordinal_pairs(panel: DataFrame, period: str, value: str, step: int = 1) -> DataFrame:
    """Growth to the step-th next period that the panel has, however long that is."""
    order = panel.select(period).distinct().select(period, F.row_number().over(Window.orderBy(period)).alias("_at"))  # a row for each period
    own = panel.join(F.broadcast(order), period)
    after = own.select((F.col("_at") - step).alias("_at"), "endpoint_id", F.col(value).alias("value_next"), F.col(period).alias(f"{period}_next"))
    return own.join(after, ["_at", "endpoint_id"]).withColumn("g", F.ln("value_next") - F.ln(value)).drop("_at")


def centered_growth(panel: DataFrame, period: str, value: str, days: int = 7) -> DataFrame:
    """Half the growth from ``days`` before to ``days`` after."""
    before = panel.select(F.date_add(period, days).alias(period), "endpoint_id", F.col(value).alias("_before"))
    after = panel.select(F.date_sub(period, days).alias(period), "endpoint_id", F.col(value).alias("_after"))
    return panel.join(before, [period, "endpoint_id"]).join(after, [period, "endpoint_id"]).withColumn("g", (F.ln("_after") - F.ln("_before")) / 2).drop("_before", "_after")


def lead_pairs(panel: DataFrame, period: str, value: str, gap_days: int | None = None, log: Column | None = None) -> DataFrame:
    """Growth to the endpoint's next row; gap_days keeps only those exactly so far ahead."""
    order = Window.partitionBy("endpoint_id").orderBy(period)
    log = F.ln(value) if log is None else log
    out = panel.withColumn("_log", log).withColumn("g", F.lead("_log").over(order) - F.col("_log")).withColumn("_gap", F.datediff(F.lead(period).over(order), period))
    out = out.where(F.col("g").isNotNull() if gap_days is None else F.col("_gap") == gap_days)
    return out.drop("_log", "_gap")


def lag_pairs(panel: DataFrame, period: str, value: str, rank: str, rows: int) -> DataFrame:
    """Growth from ``rows`` rows back, where those are exactly as many days; prev_rank is the rank then."""
    order = Window.partitionBy("endpoint_id").orderBy(period)
    out = panel.withColumn("_then", F.lag(period, rows).over(order)).withColumn("_old", F.lag(value, rows).over(order)).withColumn("prev_rank", F.lag(rank, rows).over(order))
    return out.where(F.datediff(period, "_then") == rows).withColumn("g", F.ln(value) - F.ln("_old")).drop("_then", "_old")


def standardized(g: Column, rank: Column) -> Column:
    """g over the square root of the log of the rank; null at rank 1."""
    return F.when(rank > 1, g / F.sqrt(F.ln(rank)))


def rank_gaps(panel: DataFrame, period: str, value: str, rank: str, block: int = 4096) -> DataFrame:
    """Log gap to the next rank of the same period.

    Periods are cut into blocks of ranks; a block's first rank is copied to the
    block before, so that each task holds a block and every rank meets its next.
    """
    at = F.floor(F.col(rank) / block)
    cut = panel.withColumn("_block", F.explode(F.array_distinct(F.array(at, F.floor((F.col(rank) - 1) / block)))))
    order = Window.partitionBy(period, "_block").orderBy(rank)
    nxt = F.when(F.lead(rank).over(order) == F.col(rank) + 1, F.lead(value).over(order))
    out = cut.withColumn("gap", F.ln(value) - F.ln(nxt)).where(F.col("gap").isNotNull() & (F.col("_block") == at))
    return out.drop("_block")


def leakage(panel: DataFrame, period: str, value: str, rank: str, horizons: Sequence[int], days: int = 1) -> DataFrame:
    """(rank, horizon): mean over periods of the share of endpoints that are gone by then, and the number of periods."""
    return leakage_of(growth_pairs(panel, period, value, rank, horizons, days, "left"), observed_starts(panel, period, horizons, days), period, rank)


def leakage_of(pairs: DataFrame, starts: DataFrame, period: str, rank: str, unique: bool = False) -> DataFrame:
    """The same from pairs that keep rows without a later end, where their growth is used too.

    unique: each period has a rank once, so the mean of its rows is the row's
    own, and only ranks are grouped.
    """
    pairs = pairs.join(F.broadcast(starts), [period, "horizon"], "left_semi")  # a row for each period and horizon
    leaked = F.col("value_next").isNull().cast("double")
    by_period = pairs.select(rank, "horizon", leaked.alias("_leaked")) if unique else pairs.groupBy(period, rank, "horizon").agg(F.avg(leaked).alias("_leaked"))
    return by_period.groupBy(rank, "horizon").agg(F.avg("_leaked").alias("leakage"), F.count("*").alias("n_periods"))


def pair_portion(panel: DataFrame, period: str, value: str, rank: str, band: Column, horizons: Sequence[int], days: int = 1) -> DataFrame:
    """(band, horizon): how many rows could have a pair, how many have one, and their ratio."""
    pairs = growth_pairs(panel, period, value, rank, horizons, days, "left").join(observed_starts(panel, period, horizons, days), [period, "horizon"], "left_semi")
    out = pairs.groupBy(band.alias("band"), "horizon").agg(F.count("*").alias("n_candidates"), F.count("value_next").alias("n_observed"))
    return out.withColumn("portion", F.col("n_observed") / F.col("n_candidates"))


def continuity_loss(panel: DataFrame, period: str, horizons: Sequence[int]) -> DataFrame:
    """(horizon): row-lag pairs, and how many of them are exactly so many days apart."""
    order = Window.partitionBy("endpoint_id").orderBy(period)
    gaps = panel.select(*[F.datediff(period, F.lag(period, h).over(order)).alias(f"_{h}") for h in horizons])
    sums = gaps.agg(*[F.count(f"_{h}").alias(f"n{h}") for h in horizons], *[F.count_if(F.col(f"_{h}") == h).alias(f"k{h}") for h in horizons])
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"n{h}").alias("n_pairs"), F.col(f"k{h}").alias("n_kept")) for h in horizons]))
    return sums.select(rows.alias("r")).select("r.*")


def kth_highest(pairs: DataFrame, keys: Sequence[str], value: str, ks: Sequence[int]) -> DataFrame:
    """The k-th highest value of each key, for all ks; null where there are fewer."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    cut = pairs.where(F.col(value).isNotNull()).withColumn("k", F.row_number().over(order)).where(F.col("k").isin(*ks))
    grid = pairs.select(*keys).distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return grid.join(cut.select(*keys, "k", value), [*keys, "k"], "left")


def quantile_at(values: Column, p: Column) -> Column:
    """Type-7 quantile of a sorted array at a fraction that may differ from row to row."""
    h = (F.size(values) - 1) * p
    low = F.floor(h).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (h - low) * (b - a)


def lee_bounds(pairs: DataFrame, keys: Sequence[str], value: str, leak: DataFrame, taus: Sequence[float], least: int = 10) -> DataFrame:
    """Quantiles of the stayers' growth, with bounds for the leavers' share (Lee).

    leak has keys and ``leakage``; a missing one counts as 0.  Where all left
    (leakage 1) the bounds are null.  Groups of fewer than ``least`` are left out.
    """
    sorted_ = pairs.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_x")).where(F.size("_x") >= least)
    out = sorted_.join(leak.select(*keys, "leakage"), [*keys], "left").withColumn("leakage", F.coalesce("leakage", F.lit(0.0)))
    out = out.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    stay = F.nullif(1 - F.col("leakage"), F.lit(0.0))
    low, high = F.greatest(F.lit(0.0), (F.col("tau") - F.col("leakage")) / stay), F.least(F.lit(1.0), F.col("tau") / stay)
    x = F.col("_x")
    bounded = lambda p: F.when(stay.isNotNull(), quantile_at(x, p))
    return out.select(*keys, "tau", "leakage", F.size("_x").alias("n"), bounded(low).alias("q_lb"), quantile_at(x, F.col("tau")).alias("q_obs"), bounded(high).alias("q_ub"))
