"""Queries over pairs of rows: growth, leakage, continuity and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.config import SMALL
from ladderlens.operators import pairs, panels
from ladderlens.plans.inputs import DAYS_SQL, PARTS, SUPPLIERS, part_sums, part_weeks, rounded, supplier_weeks, user_days, user_sums
from ladderlens.registry import query

PAIR_SQL = """
h AS (SELECT unnest([1, 7, 28]) AS horizon),
pairs AS (
  SELECT a.date, a.endpoint_id, a.rank, h.horizon, b.rank AS rank_next, ln(b.metric_value) - ln(a.metric_value) AS g
  FROM daily a, h JOIN daily b ON b.endpoint_id = a.endpoint_id AND b.date = a.date + CAST(h.horizon AS INTEGER))"""

WEEK_PAIR_SQL = """
h AS (SELECT unnest([1, 2, 4]) AS horizon),
pairs AS (
  SELECT a.week_start, a.endpoint_id, a.rank_w, h.horizon, b.rank_w AS rank_next, ln(b.weekly_share) - ln(a.weekly_share) AS g
  FROM weekly a, h JOIN weekly b ON b.endpoint_id = a.endpoint_id AND b.week_start = a.week_start + CAST(7 * h.horizon AS INTEGER))"""


def day_pairs(spark, d, how="inner"):
    return pairs.growth_pairs(user_days(spark, d), "date", "metric_value", "rank", SMALL.daily_horizons, how=how)


def week_pairs(spark, d, how="inner"):
    return pairs.growth_pairs(supplier_weeks(spark, d), "week_start", "weekly_share", "rank_w", SMALL.weekly_horizons, 7, how)


@query("flagship_growth_by_rank", f"WITH {SUPPLIERS}, {WEEK_PAIR_SQL} SELECT rank_w, round(avg(g), 6) AS mean_g, round(median(g), 6) AS median_g, round(var_samp(g), 6) AS var_g, count(*) AS n FROM pairs WHERE horizon = 1 GROUP BY 1")
def flagship(spark, d):
    """Weekly growth of shares by rank: mean, median, variance and count."""
    one = pairs.growth_pairs(supplier_weeks(spark, d), "week_start", "weekly_share", "rank_w", [1], 7)
    return one.groupBy("rank_w").agg(panels.rounded(F.avg("g"), 6).alias("mean_g"), panels.rounded(F.median("g"), 6).alias("median_g"), panels.rounded(F.var_samp("g"), 6).alias("var_g"), F.count("*").alias("n"))


@query("j1_metric_pairs", f"WITH {DAYS_SQL}, {PAIR_SQL} SELECT date, endpoint_id, rank, CAST(horizon AS INTEGER) AS horizon, round(g, 6) AS g FROM pairs WHERE rank IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)")
def j1(spark, d):
    """Growth over 1, 7 and 28 days from the kept ranks."""
    return day_pairs(spark, d).where(F.col("rank").isin(*SMALL.ranks_keep)).select("date", "endpoint_id", "rank", "horizon", *rounded("g"))


@query("j2_weekly_pairs", f"WITH {SUPPLIERS}, {WEEK_PAIR_SQL} SELECT week_start, endpoint_id, rank_w, rank_next, CAST(horizon AS INTEGER) AS horizon, round(g, 6) AS g FROM pairs WHERE rank_w <= 20")
def j2(spark, d):
    return week_pairs(spark, d).where(F.col("rank_w") <= SMALL.weekly_pair_ranks).select("week_start", "endpoint_id", "rank_w", "rank_next", "horizon", *rounded("g"))


@query("j3_daily_growth", f"WITH {DAYS_SQL}, {PAIR_SQL} SELECT date, endpoint_id, rank, rank_next, round(g, 6) AS g FROM pairs WHERE horizon = 7 AND rank <= 90")
def j3(spark, d):
    one = pairs.growth_pairs(user_days(spark, d), "date", "metric_value", "rank", [7])
    return one.where(F.col("rank") <= SMALL.daily_pair_ranks).select("date", "endpoint_id", "rank", "rank_next", *rounded("g"))


@query(
    "j4_standardized_growth",
    f"WITH {DAYS_SQL}, {PAIR_SQL} SELECT rank, CAST(horizon AS INTEGER) AS horizon, round(avg(g), 6) AS raw, round(avg(g / sqrt(ln(rank))), 6) AS standardized, count(*) AS n FROM pairs WHERE rank > 1 GROUP BY 1, 2",
)
def j4(spark, d):
    """Raw growth, and growth over sqrt(ln(rank))."""
    own = day_pairs(spark, d).where("rank > 1").withColumn("s", pairs.standardized(F.col("g"), F.col("rank")))
    return own.groupBy("rank", "horizon").agg(panels.rounded(F.avg("g"), 6).alias("raw"), panels.rounded(F.avg("s"), 6).alias("standardized"), F.count("*").alias("n"))


DAY_LEAK_SQL = f"""{DAYS_SQL},
h AS (SELECT unnest([1, 7, 28]) AS horizon),
starts AS (SELECT a.date, horizon FROM (SELECT DISTINCT date FROM daily) a, h WHERE a.date + CAST(horizon AS INTEGER) IN (SELECT date FROM daily)),
cand AS (
  SELECT a.date, a.endpoint_id, a.rank, s.horizon, b.endpoint_id IS NULL AS gone
  FROM daily a JOIN starts s ON a.date = s.date LEFT JOIN daily b ON b.endpoint_id = a.endpoint_id AND b.date = a.date + CAST(s.horizon AS INTEGER)),
leak AS (SELECT rank, horizon, avg(m) AS leakage, count(*) AS n_periods FROM (SELECT date, rank, horizon, avg(CAST(gone AS INTEGER)) AS m FROM cand GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("j5_leakage", f"WITH {DAY_LEAK_SQL} SELECT rank, CAST(horizon AS INTEGER) AS horizon, round(leakage, 6) AS leakage, n_periods FROM leak")
def j5(spark, d):
    own = pairs.growth_pairs(user_days(spark, d), "date", "metric_value", "rank", SMALL.daily_horizons, how="left")
    return pairs.leakage_of(own, pairs.observed_starts(user_sums(spark, d), "date", SMALL.daily_horizons), "date", "rank", unique=True).select("rank", "horizon", *rounded("leakage"), "n_periods")


@query(
    "j6_weekly_leakage",
    f"""WITH {PARTS}, h AS (SELECT unnest([1, 2, 4]) AS horizon),
    starts AS (SELECT a.week_start, horizon FROM (SELECT DISTINCT week_start FROM weekly) a, h WHERE a.week_start + CAST(7 * horizon AS INTEGER) IN (SELECT week_start FROM weekly)),
    m AS (SELECT a.week_start, a.rank_w, s.horizon, avg(CAST(b.endpoint_id IS NULL AS INTEGER)) AS m FROM weekly a JOIN starts s USING (week_start) LEFT JOIN weekly b ON b.endpoint_id = a.endpoint_id AND b.week_start = a.week_start + CAST(7 * s.horizon AS INTEGER) GROUP BY 1, 2, 3)
    SELECT rank_w, CAST(horizon AS INTEGER) AS horizon, round(avg(m), 6) AS leakage, count(*) AS n_periods FROM m GROUP BY 1, 2""",
)
def j6(spark, d):
    weekly = part_weeks(spark, d).select("week_start", "endpoint_id", "rank_w")  # only who is still there counts, so no value is carried
    own = pairs.growth_pairs(weekly, "week_start", "rank_w", "rank_w", SMALL.weekly_horizons, 7, "left")
    starts = pairs.observed_starts(part_sums(spark, d), "week_start", SMALL.weekly_horizons, 7)
    return pairs.leakage_of(own, starts, "week_start", "rank_w", unique=True).select("rank_w", "horizon", *rounded("leakage"), "n_periods")


BAND_SQL = "CASE WHEN rank = 1 THEN '1' ELSE CAST(power(2, floor(log2(rank))) AS INTEGER) || '-' || CAST(power(2, floor(log2(rank)) + 1) - 1 AS INTEGER) END"


@query("j7_pair_portion", f"WITH {DAY_LEAK_SQL} SELECT {BAND_SQL} AS band, CAST(horizon AS INTEGER) AS horizon, count(*) AS n_candidates, count(*) FILTER (NOT gone) AS n_observed, round(count(*) FILTER (NOT gone) / count(*), 6) AS portion FROM cand GROUP BY 1, 2")
def j7(spark, d):
    out = pairs.pair_portion(user_days(spark, d), "date", "metric_value", "rank", panels.rank_band("rank"), SMALL.daily_horizons)
    return out.select("band", "horizon", "n_candidates", "n_observed", *rounded("portion"))


@query("j8_semi_join_head_weeks", f"WITH {SUPPLIERS}, v AS (SELECT week_start FROM weekly WHERE rank_w <= 50 GROUP BY 1 HAVING count(*) = 50) SELECT week_start, endpoint_id, rank_w FROM weekly WHERE week_start IN (SELECT week_start FROM v) AND rank_w <= 50")
def j8(spark, d):
    weekly = supplier_weeks(spark, d)
    return weekly.join(panels.full_head_periods(weekly, "week_start", "rank_w", SMALL.k_head), "week_start", "left_semi").where(F.col("rank_w") <= SMALL.k_head).select("week_start", "endpoint_id", "rank_w")


@query("j9_anti_join_thin_weeks", f"WITH {SUPPLIERS}, v AS (SELECT week_start FROM weekly GROUP BY 1 HAVING count(*) < 75) SELECT week_start, count(*) AS n FROM weekly WHERE week_start NOT IN (SELECT week_start FROM v) GROUP BY 1")
def j9(spark, d):
    weekly = supplier_weeks(spark, d)
    return panels.drop_periods(weekly, "week_start", panels.sparse_periods(weekly, "week_start", SMALL.min_rows_per_week)).groupBy("week_start").agg(F.count("*").alias("n"))


@query("j10_observed_starts", f"WITH {DAY_LEAK_SQL} SELECT date, CAST(horizon AS INTEGER) AS horizon FROM starts")
def j10(spark, d):
    return pairs.observed_starts(user_days(spark, d), "date", SMALL.daily_horizons)


@query(
    "j11_next_kept_week",
    f"""WITH {PARTS}, kept AS (SELECT * FROM weekly WHERE week_start NOT IN (SELECT week_start FROM weekly GROUP BY 1 HAVING count(*) < 160)),
    o AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS i FROM (SELECT DISTINCT week_start FROM kept)), k AS (SELECT * FROM kept JOIN o USING (week_start))
    SELECT a.week_start, b.week_start AS week_start_next, a.endpoint_id, a.rank_w, round(ln(b.weekly_share) - ln(a.weekly_share), 6) AS g FROM k a JOIN k b ON b.endpoint_id = a.endpoint_id AND b.i = a.i + 1""",
)
def j11(spark, d):
    """Growth to the next kept week, thin weeks left out."""
    weekly = part_weeks(spark, d)
    kept = panels.drop_periods(weekly, "week_start", panels.sparse_periods(weekly, "week_start", 160))
    return pairs.ordinal_pairs(kept, "week_start", "weekly_share").select("week_start", "week_start_next", "endpoint_id", "rank_w", *rounded("g"))


@query(
    "j12_centered_growth",
    f"WITH {SUPPLIERS} SELECT a.week_start, a.endpoint_id, a.rank_w, round((ln(c.weekly_share) - ln(b.weekly_share)) / 2, 6) AS g FROM weekly a JOIN weekly b ON b.endpoint_id = a.endpoint_id AND b.week_start = a.week_start - 7 JOIN weekly c ON c.endpoint_id = a.endpoint_id AND c.week_start = a.week_start + 7",
)
def j12(spark, d):
    return pairs.centered_growth(supplier_weeks(spark, d), "week_start", "weekly_share").select("week_start", "endpoint_id", "rank_w", *rounded("g"))


@query("j14_lookup_join", f"WITH {SUPPLIERS}, s AS (SELECT rank_w, median(weekly_share) AS mid FROM weekly GROUP BY 1) SELECT w.rank_w, count(*) AS n_above FROM weekly w JOIN s USING (rank_w) WHERE w.weekly_share > s.mid * 1.01 GROUP BY 1")
def j14(spark, d):
    """Rows against a table of statistics by rank."""
    weekly = supplier_weeks(spark, d)
    mid = weekly.groupBy("rank_w").agg(F.median("weekly_share").alias("mid"))
    return weekly.join(mid, "rank_w", "left").where("weekly_share > mid * 1.01D").groupBy("rank_w").agg(F.count("*").alias("n_above"))


@query("j18_cross_grid", f"WITH {SUPPLIERS} SELECT rank_w, k FROM (SELECT DISTINCT rank_w FROM weekly), (SELECT unnest([10, 25, 40]) AS k)")
def j18(spark, d):
    """Every rank with every k of a short list."""
    return supplier_weeks(spark, d).select("rank_w").distinct().select("rank_w", F.explode(F.array(F.lit(10), F.lit(25), F.lit(40))).alias("k"))


@query("w6_lead_exact_week", f"WITH {PARTS}, l AS (SELECT *, lead(week_start) OVER w AS nx, lead(ln(weekly_share)) OVER w - ln(weekly_share) AS g FROM weekly WINDOW w AS (PARTITION BY endpoint_id ORDER BY week_start)) SELECT week_start, endpoint_id, rank_w, round(g, 6) AS g FROM l WHERE nx - week_start = 7")
def w6(spark, d):
    """Growth to the endpoint's next row where that is one week ahead."""
    return pairs.lead_pairs(part_weeks(spark, d), "week_start", "weekly_share", 7).select("week_start", "endpoint_id", "rank_w", *rounded("g"))


@query("w7_lead_any_gap", f"WITH {PARTS}, l AS (SELECT *, lead(ln(greatest(weekly_share, 1e-12))) OVER (PARTITION BY endpoint_id ORDER BY week_start) - ln(greatest(weekly_share, 1e-12)) AS g FROM weekly) SELECT week_start, endpoint_id, rank_w, round(g, 6) AS g FROM l WHERE g IS NOT NULL")
def w7(spark, d):
    """Growth to the endpoint's next row however far ahead, with a floor under the log."""
    floor = F.ln(F.greatest("weekly_share", F.lit(1e-12)))
    return pairs.lead_pairs(part_weeks(spark, d), "week_start", "weekly_share", log=floor).select("week_start", "endpoint_id", "rank_w", *rounded("g"))


@query(
    "w8_lag_rows",
    f"WITH {DAYS_SQL}, l AS (SELECT *, lag(date, 7) OVER w AS then_, lag(metric_value, 7) OVER w AS old, lag(rank, 7) OVER w AS prev_rank FROM daily WINDOW w AS (PARTITION BY endpoint_id ORDER BY date)) SELECT date, endpoint_id, prev_rank, round(ln(metric_value) - ln(old), 6) AS g FROM l WHERE date - then_ = 7",
)
def w8(spark, d):
    """Growth over seven rows that are seven days."""
    return pairs.lag_pairs(user_days(spark, d), "date", "metric_value", "rank", 7).select("date", "endpoint_id", "prev_rank", *rounded("g"))


@query("w10_rank_gaps", f"WITH {SUPPLIERS}, l AS (SELECT *, lead(rank_w) OVER w AS nx, ln(weekly_share) - ln(lead(weekly_share) OVER w) AS gap FROM weekly WINDOW w AS (PARTITION BY week_start ORDER BY rank_w)) SELECT week_start, rank_w, round(gap, 6) AS gap FROM l WHERE nx = rank_w + 1")
def w10(spark, d):
    return pairs.rank_gaps(supplier_weeks(spark, d), "week_start", "weekly_share", "rank_w").select("week_start", "rank_w", *rounded("gap"))


@query(
    "w19_densified_difference",
    f"""WITH {DAYS_SQL}, g AS (SELECT a.date, b.endpoint_id FROM (SELECT DISTINCT date FROM daily) a, (SELECT DISTINCT endpoint_id FROM daily) b), f AS (SELECT g.*, ln(coalesce(share, 0) + 1e-12) AS y FROM g LEFT JOIN daily USING (date, endpoint_id)),
    l AS (SELECT *, y - lag(y, 7) OVER (PARTITION BY endpoint_id ORDER BY date) AS g7 FROM f) SELECT date, endpoint_id, round(g7, 6) AS g FROM l WHERE g7 IS NOT NULL""",
)
def w19(spark, d):
    """Seven-step differences of log shares on the full grid of dates and endpoints."""
    from pyspark.sql import Window

    daily = user_days(spark, d)
    dates = daily.agg(F.sort_array(F.collect_set("date")).alias("dates"))
    grid = daily.select("endpoint_id").distinct().crossJoin(F.broadcast(dates)).select("endpoint_id", F.explode("dates").alias("date")).join(daily, ["date", "endpoint_id"], "left")
    y = F.ln(F.coalesce("share", F.lit(0.0)) + 1e-12)
    out = grid.withColumn("g", y - F.lag(y, 7).over(Window.partitionBy("endpoint_id").orderBy("date")))
    return out.where("g is not null").select("date", "endpoint_id", *rounded("g"))


@query("a10_pair_counts_pivot", f"WITH {DAYS_SQL}, {PAIR_SQL} SELECT rank, count(*) FILTER (horizon = 1) AS h1, count(*) FILTER (horizon = 7) AS h7, count(*) FILTER (horizon = 28) AS h28 FROM pairs GROUP BY 1")
def a10(spark, d):
    """Pairs by rank, a column for each horizon."""
    wide = day_pairs(spark, d).groupBy("rank").pivot("horizon", list(SMALL.daily_horizons)).agg(F.count("g"))
    return wide.select("rank", *[F.coalesce(str(h), F.lit(0)).alias(f"h{h}") for h in SMALL.daily_horizons])


@query(
    "a15_continuity_loss",
    f"WITH {DAYS_SQL}, l AS (SELECT date - lag(date, 1) OVER w AS g1, date - lag(date, 7) OVER w AS g7, date - lag(date, 28) OVER w AS g28 FROM daily WINDOW w AS (PARTITION BY endpoint_id ORDER BY date)) SELECT 1 AS horizon, count(g1) AS n_pairs, count(*) FILTER (g1 = 1) AS n_kept FROM l UNION ALL SELECT 7, count(g7), count(*) FILTER (g7 = 7) FROM l UNION ALL SELECT 28, count(g28), count(*) FILTER (g28 = 28) FROM l",
)
def a15(spark, d):
    return pairs.continuity_loss(user_days(spark, d), "date", SMALL.daily_horizons)


KTH_SQL = f"{SUPPLIERS}, {WEEK_PAIR_SQL}, k AS (SELECT rank_w, g, row_number() OVER (PARTITION BY rank_w ORDER BY g DESC) AS k FROM pairs WHERE horizon = 1), grid AS (SELECT rank_w, k FROM (SELECT DISTINCT rank_w FROM pairs WHERE horizon = 1), (SELECT unnest([10, 25, 40]) AS k))"


@query("t3_kth_highest_growth", f"WITH {KTH_SQL} SELECT grid.rank_w, grid.k, round(g, 6) AS g FROM grid LEFT JOIN k USING (rank_w, k)")
def t3(spark, d):
    one = pairs.growth_pairs(supplier_weeks(spark, d), "week_start", "weekly_share", "rank_w", [1], 7)
    return pairs.kth_highest(one, ["rank_w"], "g", [10, 25, 40]).select("rank_w", "k", *rounded("g"))


@query("a16_sorted_element", f"WITH {KTH_SQL} SELECT rank_w, round(g, 6) AS g FROM k WHERE k = 10")
def a16(spark, d):
    """The tenth highest growth, as an element of the sorted list."""
    one = pairs.growth_pairs(supplier_weeks(spark, d), "week_start", "weekly_share", "rank_w", [1], 7)
    lists = one.groupBy("rank_w").agg(F.sort_array(F.collect_list("g"), asc=False).alias("x"))
    return lists.select("rank_w", panels.rounded(F.try_element_at("x", F.lit(10)), 6).alias("g")).where("g is not null")


@query(
    "m31_lee_bounds",
    f"""WITH {DAY_LEAK_SQL}, pairs AS (SELECT a.rank, ln(b.metric_value) - ln(a.metric_value) AS g FROM daily a JOIN daily b ON b.endpoint_id = a.endpoint_id AND b.date = a.date + 7),
    x AS (SELECT rank, list_sort(list(g)) AS x, count(*) AS n FROM pairs GROUP BY 1 HAVING count(*) >= 10),
    t AS (SELECT x.rank, x, n, coalesce(leakage, 0) AS l, tau FROM x LEFT JOIN (SELECT * FROM leak WHERE horizon = 7) k USING (rank), (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS tau)),
    p AS (SELECT *, greatest(0, (tau - l) / nullif(1 - l, 0)) AS a, least(1, tau / nullif(1 - l, 0)) AS b FROM t),
    hh AS (SELECT *, (n - 1) * a AS ha, (n - 1) * tau AS ht, (n - 1) * b AS hb FROM p)
    SELECT rank, tau, round(l, 6) AS leakage, CAST(n AS INTEGER) AS n,
      CASE WHEN l < 1 THEN round(x[CAST(floor(ha) AS BIGINT) + 1] + (ha - floor(ha)) * (x[least(CAST(floor(ha) AS BIGINT) + 2, n)] - x[CAST(floor(ha) AS BIGINT) + 1]), 6) END AS q_lb,
      round(x[CAST(floor(ht) AS BIGINT) + 1] + (ht - floor(ht)) * (x[least(CAST(floor(ht) AS BIGINT) + 2, n)] - x[CAST(floor(ht) AS BIGINT) + 1]), 6) AS q_obs,
      CASE WHEN l < 1 THEN round(x[CAST(floor(hb) AS BIGINT) + 1] + (hb - floor(hb)) * (x[least(CAST(floor(hb) AS BIGINT) + 2, n)] - x[CAST(floor(hb) AS BIGINT) + 1]), 6) END AS q_ub FROM hh""",
)
def m31(spark, d):
    """Quantiles of weekly growth by rank, with bounds for those who left."""
    daily = user_days(spark, d)
    own = pairs.growth_pairs(daily, "date", "metric_value", "rank", [7], how="left")
    leak = pairs.leakage_of(own, pairs.observed_starts(user_sums(spark, d), "date", [7]), "date", "rank", unique=True)
    return pairs.lee_bounds(own, ["rank"], "g", leak, SMALL.quantiles).select("rank", "tau", "n", *rounded("leakage", "q_lb", "q_obs", "q_ub"))
