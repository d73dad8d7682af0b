"""Queries about who stays on the list."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderlens.config import SMALL
from ladderlens.operators import churn, panels
from ladderlens.plans.inputs import DAYS_SQL, PARTS, SUPPLIERS, part_sums, part_weeks, rounded, supplier_weeks, user_days
from ladderlens.registry import query
from ladderlens.tables import keep


@query(
    "w9_new_and_returning",
    f"""WITH {PARTS}, o AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS week_idx FROM (SELECT DISTINCT week_start FROM weekly)),
    g AS (SELECT week_start, week_idx, week_idx - lag(week_idx) OVER (PARTITION BY endpoint_id ORDER BY week_idx) AS gap FROM weekly JOIN o USING (week_start))
    SELECT week_start, CAST(week_idx AS INTEGER) AS week_idx, count(*) AS n, count(*) FILTER (gap IS NULL) AS new_ever, count(*) FILTER (gap >= 4) AS back_4, count(*) FILTER (gap >= 12) AS back_12 FROM g WHERE week_idx > 4 GROUP BY 1, 2""",
)
def w9(spark, d):
    return churn.new_and_returning(part_sums(spark, d), "week_start")


@query(
    "m36_transitions",
    f"""WITH {DAYS_SQL}, s AS (SELECT date, endpoint_id, rank FROM daily WHERE rank <= 2000), b AS (SELECT DISTINCT date FROM daily WHERE date + 7 IN (SELECT date FROM daily)),
    m AS (SELECT coalesce(x.date, y.date - 7) AS date, coalesce(x.rank, 2001) AS from_rank, coalesce(y.rank, 2001) AS to_rank FROM s x FULL JOIN s y ON y.endpoint_id = x.endpoint_id AND y.date = x.date + 7),
    n AS (SELECT strftime(date, '%A') AS weekday, from_rank, to_rank, count(*) AS n FROM m WHERE date IN (SELECT date FROM b) GROUP BY 1, 2, 3)
    SELECT weekday, from_rank, to_rank, n, round(n / sum(n) OVER (PARTITION BY weekday, from_rank), 6) AS p FROM n""",
)
def m36(spark, d):
    """Moves between ranks over seven days, by weekday; 2001 is off the list."""
    return churn.transitions(user_days(spark, d), "date", "rank", 7, churn.OFF_LIST - 1).select("weekday", "from_rank", "to_rank", "n", *rounded("p"))


def kept_weeks(spark, d):
    """The panel as a written table, for what reads it several times."""
    return keep(supplier_weeks(spark, d), "panel")


CAPTURE_SQL = f"""{SUPPLIERS},
o AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS idx FROM (SELECT DISTINCT week_start FROM weekly)),
r AS (SELECT * FROM weekly JOIN o USING (week_start)),
grid AS (SELECT k, r AS rr FROM (SELECT unnest([10, 20, 50]) AS k), (SELECT unnest([4, 13, 26]) AS r)),
t AS (SELECT DISTINCT idx, weekly_total FROM r),
tot AS (SELECT g.rr, a.idx AS start_idx, round(sum(b.weekly_total), 2) AS total FROM (SELECT DISTINCT rr FROM grid) g, t a JOIN t b ON b.idx BETWEEN a.idx AND a.idx + g.rr - 1 GROUP BY 1, 2),
cap AS (
  SELECT g.k, g.rr, m.idx AS start_idx, round(sum(w.weekly_metric), 2) AS captured
  FROM grid g JOIN r m ON m.rank_w <= g.k JOIN r w ON w.endpoint_id = m.endpoint_id AND w.idx BETWEEN m.idx AND m.idx + g.rr - 1
  WHERE m.idx + g.rr - 1 <= (SELECT max(idx) FROM o) GROUP BY 1, 2, 3),
ratios AS (SELECT k, rr, start_idx, captured, total, captured / total AS ratio FROM cap JOIN tot USING (rr, start_idx))"""


@query("j15_interval_join_captures", f"WITH {CAPTURE_SQL} SELECT k, rr AS r, CAST(start_idx AS INTEGER) AS start_idx, captured, total, round(ratio, 6) AS ratio FROM ratios")
def j15(spark, d):
    """What each week's top list gathers over the weeks that follow."""
    return churn.captures(kept_weeks(spark, d), SMALL.capture_sizes, SMALL.capture_windows).withColumns({"ratio": F.round("ratio", 6)})


@query("m42_capture_summary", f"WITH {CAPTURE_SQL} SELECT k, rr AS r, count(*) AS n, round(avg(ratio), 6) AS mean, round(quantile_cont(ratio, 0.05), 6) AS p05, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(ratio, 0.95), 6) AS p95 FROM ratios GROUP BY 1, 2")
def m42(spark, d):
    """Capture ratios by list size and window: mean and quantiles."""
    q = {f"p{p:02d}": F.round(F.percentile("ratio", p / 100), 6) for p in (5, 50, 95)}
    return churn.captures(kept_weeks(spark, d), SMALL.capture_sizes, SMALL.capture_windows).groupBy("k", "r").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean"), *[v.alias(k) for k, v in q.items()])


@query("w16_rolling_totals", f"WITH {SUPPLIERS}, t AS (SELECT DISTINCT week_start, weekly_total FROM weekly), w AS (SELECT week_start, sum(weekly_total) OVER x AS total, count(*) OVER x AS n FROM t WINDOW x AS (ORDER BY week_start ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) SELECT week_start, round(total, 2) AS total FROM w WHERE n = 13")
def w16(spark, d):
    """Totals of 13 weeks from each week on; windows that are cut short are left out."""
    totals = supplier_weeks(spark, d).select("week_start", "weekly_total").distinct()
    order = Window.orderBy("week_start").rowsBetween(0, 12)  # a row for each week
    return totals.select("week_start", F.round(F.sum("weekly_total").over(order), 2).alias("total"), F.count("*").over(order).alias("n")).where("n = 13").drop("n")


@query(
    "j16_right_join_totals",
    f"WITH {SUPPLIERS}, c AS (SELECT week_start, round(sum(weekly_metric), 2) AS captured FROM weekly WHERE endpoint_id IN (SELECT endpoint_id FROM weekly WHERE week_start = (SELECT min(week_start) FROM weekly) AND rank_w <= 3) GROUP BY 1) SELECT t.week_start, captured, weekly_total FROM c RIGHT JOIN (SELECT DISTINCT week_start, weekly_total FROM weekly) t USING (week_start)",
)
def j16(spark, d):
    """The first week's top three in every week; weeks without them have null."""
    weekly = supplier_weeks(spark, d)
    first = weekly.agg(F.min("week_start").alias("week_start"))
    ids = weekly.join(F.broadcast(first), "week_start", "left_semi").where("rank_w <= 3").select("endpoint_id")
    got = weekly.join(ids, "endpoint_id", "left_semi").groupBy("week_start").agg(F.round(F.sum("weekly_metric"), 2).alias("captured"))
    return got.join(weekly.select("week_start", "weekly_total").distinct(), "week_start", "right").select("week_start", "captured", "weekly_total")


COVER_SQL = f"""{SUPPLIERS},
s AS (SELECT week_start FROM (SELECT week_start, row_number() OVER (ORDER BY week_start) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week_start FROM weekly)) WHERE list_contains(list_transform(range(12), lambda j: CAST(floor(1 + j * (n - 1) / 11.0) AS BIGINT)), i)),
c AS (
  SELECT k, m.week_start AS start_week, w.week_start, sum(w.weekly_share) AS coverage, count(*) AS n_present
  FROM (SELECT unnest([10, 20, 50]) AS k) g JOIN weekly m ON m.rank_w <= g.k AND m.week_start IN (SELECT week_start FROM s) JOIN weekly w ON w.endpoint_id = m.endpoint_id AND w.week_start >= m.week_start GROUP BY 1, 2, 3)"""


def covered(spark, d):
    weekly = kept_weeks(spark, d)
    return churn.coverage(weekly, panels.thinned_starts(weekly, "week_start"), SMALL.capture_sizes)


@query("j17_follow_fixed_lists", f"WITH {COVER_SQL} SELECT k, start_week, week_start, round(coverage, 6) AS coverage, n_present FROM c")
def j17(spark, d):
    return covered(spark, d).select("k", "start_week", "week_start", *rounded("coverage"), "n_present")


@query("m43_coverage_by_age", f"WITH {COVER_SQL} SELECT k, CAST((week_start - start_week) / 7 AS BIGINT) AS age, round(avg(coverage), 6) AS coverage, count(*) AS n FROM c GROUP BY 1, 2")
def m43(spark, d):
    """Mean coverage of fixed lists by their age in weeks."""
    return covered(spark, d).groupBy("k", (F.datediff("week_start", "start_week") / 7).cast("long").alias("age")).agg(F.round(F.avg("coverage"), 6).alias("coverage"), F.count("*").alias("n"))


@query("j13_previous_week_rank", f"WITH {SUPPLIERS} SELECT a.week_start, a.endpoint_id, a.rank_w, b.rank_w AS prev_rank FROM weekly a LEFT JOIN weekly b ON b.endpoint_id = a.endpoint_id AND b.week_start = a.week_start - 7")
def j13(spark, d):
    weekly = supplier_weeks(spark, d).select("week_start", "endpoint_id", "rank_w")
    before = weekly.select(F.date_add("week_start", 7).alias("week_start"), "endpoint_id", F.col("rank_w").alias("prev_rank"))
    return weekly.join(before, ["week_start", "endpoint_id"], "left").select("week_start", "endpoint_id", "rank_w", "prev_rank")


@query("j19_last_seen_probe", f"WITH {PARTS} SELECT week_start, endpoint_id, CAST((week_start - lag(week_start) OVER (PARTITION BY endpoint_id ORDER BY week_start)) / 7 AS BIGINT) AS weeks_since FROM weekly")
def j19(spark, d):
    """Weeks since each endpoint was last seen."""
    order = Window.partitionBy("endpoint_id").orderBy("week_start")
    return part_sums(spark, d).select("week_start", "endpoint_id", (F.datediff("week_start", F.lag("week_start").over(order)) / 7).cast("long").alias("weeks_since"))


@query(
    "w18_fill_forward_back",
    f"""WITH {PARTS}, s AS (SELECT rank_w AS k, median(weekly_share) AS y, count(*) AS n FROM weekly GROUP BY 1), h AS (SELECT k, CASE WHEN n >= 5 THEN y END AS y FROM s)
    SELECT k, round(coalesce(last_value(y IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS y FROM h""",
)
def w18(spark, d):
    """Median shares by rank; a rank that fewer than five weeks have takes that of the rank before, or else of the next one."""
    s = part_weeks(spark, d).groupBy(F.col("rank_w").alias("k")).agg(F.when(F.count("*") >= 5, F.median("weekly_share")).alias("y"))
    return panels.filled(keep(s, "medians"), "k", "y").select("k", *rounded("y", digits=9))
