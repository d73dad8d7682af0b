"""Ranked activity panels: sums by period, shares, ranks and hygiene filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderlens.operators.quantiles import quantiles


def week_of(date: Column | str) -> Column:
    """The Monday of a date's week."""
    return F.trunc(F.to_date(date), "week")


def interactions(df: DataFrame, columns: Sequence[str]) -> Column:
    """Sum of the columns; nulls and absent columns count as 0."""
    have = set(df.columns)
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) if c in have else F.lit(0) for c in columns])


#: Sums are exact up to 2**37 where their terms are cut at 2**-16: a term's larger part has 53 bits at most, and so has the sum of what is cut off.
CUT = 2.0**16


def parts(df: DataFrame, metric: Column | str) -> list[Column]:
    """metric, a column of df, as numbers that add up to it, and whose sums are exact in any order: a double is cut in two."""
    x = F.col(metric) if isinstance(metric, str) else metric
    if not isinstance(df.select(x).schema[0].dataType, T.DoubleType | T.FloatType):
        return [x]
    x = x.cast("double")
    near = F.abs(x) < 2.0**37  # larger ones have no part below; infinities and NaN stay as they are
    head = F.when(near, F.rint(x * CUT) / CUT).otherwise(x)
    return [head, F.coalesce(F.when(near, x - head), F.lit(0.0))]


def rounded_parts(sums: Sequence[Column], decimals: int) -> Column:
    """The sum whose parts were summed, rounded as SQL's round(sum(x), decimals) does."""
    if len(sums) == 1:
        return F.round(sums[0], decimals)
    return F.round((sums[0] + sums[1]) * 10.0**decimals) / 10.0**decimals


def rounded_sum(df: DataFrame, metric: Column | str, decimals: int = 2) -> Column:
    """The sum of metric, a column of df, rounded as SQL's round(sum(x), decimals) does: half away from zero, on the sum times 10^decimals.

    A sum of doubles depends on the order of the rows, and half a cent is
    rounded up or down by the last bit of it.  So each double is cut in two
    parts, whose sums are exact in any order: a sum that is computed twice is
    the same twice.
    """
    return rounded_parts([F.sum(x) for x in parts(df, metric)], decimals)


def rounded(x: Column | str, decimals: int) -> Column:
    """A double, rounded as SQL's round(x, decimals) does: half away from zero, on x times 10^decimals, and with the sign of x.

    What is rounded to nothing from below is -0.0 in SQL; Spark's own round
    gives 0.0, which has other text and another hash.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = 10.0**decimals
    return F.when(F.abs(x) < 1e290, F.signum(x) * F.round(F.abs(x) * scale) / scale).otherwise(x)


def activity(df: DataFrame, period: Column, endpoint: Column, metric: Column, names: tuple[str, str, str], decimals: int = 2) -> DataFrame:
    """(period, endpoint_id, metric): the metric's sum; a null endpoint is one of its own.

    Sums are rounded, and don't depend on the order of the rows.
    """
    sums = df.groupBy(period.alias(names[0]), endpoint.alias(names[1])).agg(rounded_sum(df, metric, decimals).alias(names[2]))
    return sums.withColumn(names[1], F.col(names[1]).cast("string"))


def positive(df: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a finite metric above 0 and no null key."""
    ok = (F.col(metric) > 0) & ~F.isnan(F.col(metric).cast("double")) & (F.col(metric) < float("inf"))
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], ok))


def shares(df: DataFrame, period: str, metric: str, total: str, share: str, decimals: int = 2) -> DataFrame:
    """df with the period's total and each row's share of it.

    Totals are summed before the shuffle and joined back, so that no task holds a period.
    """
    totals = df.groupBy(period).agg(rounded_sum(df, metric, decimals).alias(total))
    return df.join(totals, period).withColumn(share, F.try_divide(metric, total))


#: Slices of a metric for each doubling of it.
SLICES = 16


def sliced(df: DataFrame, metric: str, tie: Column | None = None) -> DataFrame:
    """df with _slice and _part, which cut the values of metric into ranges that larger values come first in, and _near.

    A whole number up to 4096, as counts often are, is a part of its own.  As
    all its rows are ties, _near cuts those further, by the first characters of
    the tie-breaking text.
    """
    x = F.col(metric).cast("double")
    size = F.floor(F.log2(F.abs(x)) * SLICES)
    at = F.when(x.isNull(), -2_000_000_000).when(F.isnan(x), 2_000_000_000).when(x == 0, -100_000).when(x > 0, size).otherwise(-200_000 - size)
    small = F.abs(x) <= 4096
    beyond = F.when(x > 0, 2 * 4096 + 1).otherwise(-2 * 4096 - 1)  # 4096 shares a slice with larger values
    part = F.when(small, 2 * F.floor(x) + (x > F.floor(x)).cast("int")).otherwise(beyond).cast("int")
    near = F.lit("") if tie is None else F.when(small & (x == F.floor(x)), F.substring(tie.cast("string"), 1, 2)).otherwise("")
    return df.select("*", at.cast("int").alias("_slice"), part.alias("_part"), F.coalesce(near, F.lit("")).alias("_near"))


def ranked(df: DataFrame, period: str, metric: str, name: str, kind: str = "row_number", ties: Sequence[Column] = (), split: bool = True) -> DataFrame:
    """df with a rank in each period, largest first; no task holds a whole period.

    kind: ``row_number`` (unique; ties by the columns in ties), ``rank`` or
    ``dense_rank``.  A period is cut into slices of the metric; rows are
    numbered within a slice, and each slice starts where the larger ones end:
    their counts are a small table.  split: ties are cut by the text of the
    first of ties too, which must be in the order of that text.  The other two
    kinds number the distinct values, which the rows then look up.
    """
    if kind != "row_number":
        return _ranked_values(df, period, metric, name, kind)
    cut = sliced(df, metric, ties[0] if ties and split else None)
    keys = [period, "_slice", "_part", "_near"]
    edges = cut.groupBy(*keys).agg(F.count("*").alias("_count"))
    edges = edges.select(*keys, F.coalesce(F.sum("_count").over(larger(period)), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(F.desc(metric), *ties)
    numbered = cut.withColumn("_n", F.row_number().over(within)).join(edges, keys)
    return numbered.withColumn(name, (F.col("_start") + F.col("_n")).cast("int")).select(*df.columns, name)


def larger(period: str) -> Window:
    """The slices of a period before a slice."""
    return Window.partitionBy(period).orderBy(F.desc("_slice"), F.desc("_part"), "_near").rowsBetween(Window.unboundedPreceding, -1)


def _ranked_values(df: DataFrame, period: str, metric: str, name: str, kind: str) -> DataFrame:
    values = sliced(df.groupBy(F.col(period).alias("_period"), F.col(metric).alias("_value")).agg(F.count("*").alias("_rows")), "_value")
    step = F.col("_rows") if kind == "rank" else F.lit(1)
    keys = ["_period", "_slice", "_part", "_near"]
    edges = values.groupBy(*keys).agg(F.sum(step).alias("_count")).select(*keys, F.coalesce(F.sum("_count").over(larger("_period")), F.lit(0)).alias("_start"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_value")).rowsBetween(Window.unboundedPreceding, -1)
    numbered = values.withColumn("_n", F.coalesce(F.sum(step).over(before), F.lit(0)) + 1).join(edges, keys)
    numbered = numbered.select("_period", "_value", (F.col("_start") + F.col("_n")).cast("int").alias(name))
    return df.join(numbered, (F.col(period) == F.col("_period")) & F.col(metric).eqNullSafe(F.col("_value"))).select(*df.columns, name)


def top_n(df: DataFrame, period: str, metric: str, n: int, ties: Sequence[Column], salts: int = 64, kind: str = "dense_rank", name: str = "rank") -> DataFrame:
    """The n largest rows of each period; within ties the first by ties.  Their rank is dense, or unique (``row_number``).

    The n largest of each of some parts of a period come first, so that the
    last cut reads salts x n rows a period at most.
    """
    order = [F.desc(metric), *ties]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = salted.withColumn("_n", F.row_number().over(Window.partitionBy(period, "_salt").orderBy(*order))).where(F.col("_n") <= n).drop("_n", "_salt")
    cut = first.withColumn("_n", F.row_number().over(Window.partitionBy(period).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    rank = F.row_number().over(Window.partitionBy(period).orderBy(*order)) if kind == "row_number" else F.dense_rank().over(Window.partitionBy(period).orderBy(F.desc(metric)))
    return cut.withColumn(name, rank)


def previous_rank(df: DataFrame, period: str, metric: str, name: str, days: int = 7) -> DataFrame:
    """Unique rank whose ties go to the endpoint that ranked higher ``days`` before, then by id."""
    first = ranked(df, period, metric, "_rank", ties=[F.col("endpoint_id")])
    before = first.select(F.date_add(period, days).alias(period), "endpoint_id", F.col("_rank").alias("_before"))
    return ranked(df.join(before, [period, "endpoint_id"], "left"), period, metric, name, ties=[F.asc_nulls_last("_before"), F.col("endpoint_id")], split=False).drop("_before")


def panel(own: DataFrame, names: tuple[str, str, str, str, str], decimals: int = 2, rows: str | None = None) -> DataFrame:
    """own (period, endpoint_id, metric) with the period's total, each row's share and its unique rank; ties by id.

    names are those of the period, metric, total, share and rank; rows, if
    given, that of the number of rows of the period.  Counts and
    sums of slices of the metric, which Spark adds up before the shuffle, give
    both the totals, exact in any order, and where each slice's ranks start.
    """
    period, metric, total, share, rank = names
    cut = sliced(own, metric, F.col("endpoint_id"))
    keys = [period, "_slice", "_part", "_near"]
    sums = {f"_sum{i}": x for i, x in enumerate(parts(own, metric))}
    edges = cut.groupBy(*keys).agg(F.count("*").alias("_count"), *[F.sum(x).alias(n) for n, x in sums.items()])
    start = F.coalesce(F.sum("_count").over(larger(period)), F.lit(0))
    whole = larger(period).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(*keys, start.alias("_start"), rounded_parts([F.sum(n).over(whole) for n in sums], decimals).alias(total), *([F.sum("_count").over(whole).alias(rows)] if rows else []))
    within = Window.partitionBy(*keys).orderBy(F.desc(metric), "endpoint_id")
    out = cut.select("*", F.row_number().over(within).alias("_n")).join(edges, keys)
    return out.select(*own.columns, total, F.try_divide(metric, total).alias(share), (F.col("_start") + F.col("_n")).cast("int").alias(rank), *([rows] if rows else []))


def thinned_starts(df: DataFrame, period: str, n: int = 12) -> DataFrame:
    """(period, i): n periods, evenly spaced, with their ordinals; all if there are fewer."""
    order = Window.orderBy(period)  # a row for each period
    numbered = df.select(period).distinct().select(period, F.row_number().over(order).cast("long").alias("i"), F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(1 + j * (F.col("_all") - 1) / float(n - 1)))
    return numbered.where(F.array_contains(picks, F.col("i"))).select(period, "i")


def daily_sums(df: DataFrame, date: Column, endpoint: Column, metric: Column) -> DataFrame:
    """date, endpoint_id, metric_value of positive rows."""
    return positive(activity(df, F.to_date(date), endpoint, metric, ("date", "endpoint_id", "metric_value")), "metric_value", ["date", "endpoint_id"])


def weekly_sums(df: DataFrame, date: Column, endpoint: Column, metric: Column) -> DataFrame:
    """week_start, endpoint_id, weekly_metric of positive rows."""
    return positive(activity(df, week_of(date), endpoint, metric, ("week_start", "endpoint_id", "weekly_metric")), "weekly_metric", ["week_start", "endpoint_id"])


def daily_panel(df: DataFrame, date: Column, endpoint: Column, metric: Column) -> DataFrame:
    """date, endpoint_id, metric_value, total_metric, share, rank of positive rows."""
    own = daily_sums(df, date, endpoint, metric)
    return panel(own, ("date", "metric_value", "total_metric", "share", "rank"))


def weekly_panel(df: DataFrame, date: Column, endpoint: Column, metric: Column, rows: str | None = None) -> DataFrame:
    """week_start, endpoint_id, weekly_metric, weekly_total, weekly_share, rank_w (and the week's number of rows) of positive rows."""
    own = weekly_sums(df, date, endpoint, metric)
    return panel(own, ("week_start", "weekly_metric", "weekly_total", "weekly_share", "rank_w"), rows=rows)


def weekly_of_daily(daily: DataFrame) -> DataFrame:
    """A weekly panel whose totals are the sums of the distinct daily totals, not of the listed endpoints."""
    week = daily.withColumn("week_start", week_of("date"))
    totals = week.select("date", "week_start", "total_metric").distinct().groupBy("week_start").agg(rounded_sum(week, "total_metric").alias("weekly_total"))
    sums = week.groupBy("week_start", "endpoint_id").agg(rounded_sum(week, "metric_value").alias("weekly_metric"))
    out = sums.join(totals, "week_start").withColumn("weekly_share", F.try_divide("weekly_metric", "weekly_total"))
    return ranked(out, "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")])


def sparse_periods(df: DataFrame, period: str, least: int) -> DataFrame:
    """Periods with fewer than ``least`` rows."""
    return df.groupBy(period).agg(F.count("*").alias("n")).where(F.col("n") < least)


def drop_periods(df: DataFrame, period: str, bad: DataFrame) -> DataFrame:
    return df.join(bad.select(period).distinct(), period, "left_anti")


def full_head_periods(df: DataFrame, period: str, rank: str, k: int) -> DataFrame:
    """Periods that hold every rank from 1 to k."""
    head = df.where(F.col(rank).between(1, k)).groupBy(period).agg(F.countDistinct(rank).alias("n"))
    return head.where(F.col("n") == k).select(period)


def winsorize(df: DataFrame, value: str, q: float) -> DataFrame:
    """value cut at its global q-quantile, which is found by counts of slices; they read df some times, so it should be a table."""
    cut = quantiles(df, value, [q]).agg(F.max("q").alias("_cut"))  # one row
    return df.crossJoin(F.broadcast(cut)).withColumn(value, F.least(value, "_cut")).drop("_cut")


def winsorize_by(df: DataFrame, key: str, value: str, q: float, two_sided: bool = False) -> DataFrame:
    """value cut, for each key, at +/- the q-quantile of its size; two_sided: at its own (1 - q)- and q-quantiles."""
    x = F.col(value)
    low, high = (F.percentile(x, 1 - q), F.percentile(x, q)) if two_sided else (-F.percentile(F.abs(x), q), F.percentile(F.abs(x), q))
    cuts = df.groupBy(key).agg(low.alias("_low"), high.alias("_high"))
    return df.join(cuts, key).withColumn(value, F.greatest(F.least(value, "_high"), "_low")).drop("_low", "_high")


def rank_band(rank: Column | str) -> Column:
    """1, 2-3, 4-7 and so on, as text."""
    low = F.pow(F.lit(2), F.floor(F.log2(rank))).cast("int")
    return F.when(low == 1, "1").otherwise(F.concat_ws("-", low.cast("string"), (2 * low - 1).cast("string")))


def missing_dates(df: DataFrame, date: str) -> DataFrame:
    """Calendar dates between the first and the last that have no row."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias(date)).join(df.select(date).distinct(), date, "left_anti")


def likes_share(weekly: DataFrame, amounts: Sequence[float]) -> DataFrame:
    """(amount, share): what an amount is of a week's total, on average over weeks."""
    totals = weekly.select("week_start", "weekly_total").distinct()
    return totals.select(F.explode(F.array(*map(F.lit, amounts))).alias("amount"), "weekly_total").groupBy("amount").agg(F.avg(F.try_divide("amount", "weekly_total")).alias("share"))


def smooth_edges(df: DataFrame, key: str, value: str, size: int, group: str) -> DataFrame:
    """Moving average of an odd number of rows; beyond the ends the end's value repeats.  group keeps tasks apart."""
    half = size // 2
    order = Window.partitionBy(group).orderBy(key)
    near, all_ = order.rowsBetween(-half, half), Window.partitionBy(group)
    at, n = F.row_number().over(order), F.count("*").over(all_)
    first, last = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left, right = F.greatest(half - at + 1, F.lit(0)), F.greatest(half - (n - at), F.lit(0))
    return df.withColumn("smooth", (F.sum(value).over(near) + left * first + right * last) / size)


def filled(df: DataFrame, key: str, value: str, block: int = 4096) -> DataFrame:
    """df with nulls of value filled from the last row before that has one, in the order of key (a whole number), else from the first that has one.

    Keys are cut into blocks: no task holds more than a block of rows, or a row
    for each block.  df is read twice, so it should be a table.
    """
    at, known = F.floor(F.col(key) / block), F.when(F.col(value).isNotNull(), F.col(key))
    order = Window.orderBy("_block")  # a row for each block
    ends = df.groupBy(at.alias("_block")).agg(F.min_by(value, known).alias("_first"), F.max_by(value, known).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("_block", before.alias("_before"), first.alias("_start"))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    cut = df.withColumn("_block", at).withColumn(value, own)
    return cut.join(F.broadcast(ends), "_block").withColumn(value, F.coalesce(value, "_before", "_start")).select(df.columns)
