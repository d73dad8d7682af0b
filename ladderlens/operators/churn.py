"""Who stays on a ranked list: new and returning endpoints, transitions, captures and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OFF_LIST = 2001


def numbered_periods(panel: DataFrame, period: str, name: str) -> DataFrame:
    """(period, ordinal from 1): a row for each period, so one task orders few rows."""
    return panel.select(period).distinct().select(period, F.row_number().over(Window.orderBy(period)).alias(name))


def new_and_returning(panel: DataFrame, period: str, gaps: tuple[int, int] = (4, 12), skip: int = 4) -> DataFrame:
    """For each period: endpoints, those never seen before, and those back after at least so many periods."""
    weeks = numbered_periods(panel, period, "week_idx")
    seen = panel.select("endpoint_id", period).distinct().join(F.broadcast(weeks), period)
    gap = F.col("week_idx") - F.lag("week_idx").over(Window.partitionBy("endpoint_id").orderBy("week_idx"))
    marked = seen.withColumn("_gap", gap)
    out = marked.groupBy(period, "week_idx").agg(
        F.count("*").alias("n"), F.count_if(F.col("_gap").isNull()).alias("new_ever"), *[F.count_if(F.col("_gap") >= g).alias(f"back_{g}") for g in gaps]
    )
    return out.where(F.col("week_idx") > skip)


def transitions(panel: DataFrame, period: str, rank: str, days: int, states: int, off_list: int = OFF_LIST) -> DataFrame:
    """(weekday, from_rank, to_rank, n, p): moves over ``days``; ranks beyond states, and absence, are off_list.

    Sparse: rows exist only for moves that occur, and endpoints off the list at
    both ends don't count.  Range frames of one row look both ways over one
    exchange by endpoint: each row is the start of its own move, and the end of
    one from off the list if its endpoint was not there before.
    """
    own = panel.where(F.col(rank) <= states).select(F.col(period).alias("_to"), "endpoint_id", F.col(rank).alias("_rank"))
    order = Window.partitionBy("endpoint_id").orderBy(F.unix_date("_to"))
    seen = own.select(
        "_to", "_rank", F.first("_rank").over(order.rangeBetween(days, days)).alias("_next"), F.first("_rank").over(order.rangeBetween(-days, -days)).alias("_before")
    )
    off = F.lit(off_list)
    move = F.struct(F.col("_to").alias("at"), F.col("_rank").alias("from_rank"), F.coalesce("_next", off).alias("to_rank"))
    entry = F.when(F.col("_before").isNull(), F.struct(F.date_sub("_to", days).alias("at"), off.alias("from_rank"), F.col("_rank").alias("to_rank")))
    moves = seen.select(F.inline(F.array_compact(F.array(move, entry))))
    dates = panel.select(F.col(period).alias("at")).distinct()
    both = dates.join(dates.select(F.date_sub("at", days).alias("at")), "at", "left_semi")  # a row for each date
    n = moves.join(F.broadcast(both), "at", "left_semi").groupBy(F.date_format("at", "EEEE").alias("weekday"), "from_rank", "to_rank").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("weekday", "from_rank")))


def captures(weekly: DataFrame, sizes: Sequence[int], windows: Sequence[int]) -> DataFrame:
    """(k, r, start_idx): what the top k of a week gather over r weeks from it, of the total.

    An interval join: the list of a week meets its endpoints' rows of the next
    r - 1 weeks.  Only windows that lie within the panel count.
    """
    weeks = numbered_periods(weekly, "week_start", "idx")
    rows = weekly.join(F.broadcast(weeks), "week_start")
    last = weeks.agg(F.max("idx").alias("last"))
    lists = rows.where(F.col("rank_w") <= max(sizes)).select("endpoint_id", F.col("idx").alias("start_idx"), F.col("rank_w").alias("list_rank"))
    far = max(windows)
    # each list row goes to blocks of ``far`` weeks that its window can touch, so that the join has equal keys of bounded size
    lists = lists.withColumn("_block", F.explode(F.array(F.floor(F.col("start_idx") / far), F.floor(F.col("start_idx") / far) + 1)))
    points = rows.select("endpoint_id", "idx", "weekly_metric", F.floor(F.col("idx") / far).alias("_block"))
    within = (F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("start_idx") + far)
    met = lists.join(points, ["endpoint_id", "_block"]).where(within).groupBy("start_idx", (F.col("idx") - F.col("start_idx")).alias("ahead"), "list_rank").agg(F.sum("weekly_metric").alias("m"))
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k in sizes for r in windows]))
    got = met.withColumn("g", grid).where((F.col("list_rank") <= F.col("g.k")) & (F.col("ahead") < F.col("g.r"))).groupBy(F.col("g.k").alias("k"), F.col("g.r").alias("r"), "start_idx").agg(F.round(F.sum("m"), 2).alias("captured"))
    totals = rows.select("idx", "weekly_total").distinct()
    order = Window.orderBy("idx")  # a row for each week
    rolled = totals.select(F.col("idx").alias("start_idx"), *[F.round(F.sum("weekly_total").over(order.rowsBetween(0, r - 1)), 2).alias(f"_{r}") for r in windows])
    total = F.coalesce(*[F.when(F.col("r") == r, F.col(f"_{r}")) for r in windows])
    out = got.join(F.broadcast(rolled), "start_idx").crossJoin(F.broadcast(last)).where(F.col("start_idx") + F.col("r") - 1 <= F.col("last"))
    return out.select("k", "r", "start_idx", "captured", total.alias("total")).withColumn("ratio", F.when(F.col("total") > 0, F.col("captured") / F.col("total")))


def coverage(weekly: DataFrame, starts: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(k, start_week, week_start): share of the list of start_week in each later week, and how many of it are there."""
    lists = weekly.join(F.broadcast(starts.select("week_start")), "week_start", "left_semi").where(F.col("rank_w") <= max(sizes))
    lists = lists.select("endpoint_id", F.col("week_start").alias("start_week"), F.col("rank_w").alias("list_rank"))
    met = lists.join(weekly.select("endpoint_id", "week_start", "weekly_share"), "endpoint_id").where("week_start >= start_week")
    out = met.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("list_rank") <= F.col("k"))
    return out.groupBy("k", "start_week", "week_start").agg(F.sum("weekly_share").alias("coverage"), F.count("*").alias("n_present"))
