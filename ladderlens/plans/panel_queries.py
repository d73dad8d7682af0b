"""Queries over panels: sums, ranks, filters, set operations and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.config import SMALL
from ladderlens.operators import panels
from ladderlens.operators.quantiles import quantiles
from ladderlens.plans.inputs import CUSTOMERS, DAYS_SQL, PARTS, SUPPLIERS, customer_weeks, part_sums, part_weeks, rounded, supplier_weeks, user_days, user_sums
from ladderlens.registry import query
from ladderlens.session import table
from ladderlens.tables import keep


@query("p1_interactions", "SELECT l_suppkey, CAST(sum(coalesce(CAST(l_quantity AS BIGINT), 0) + coalesce(CAST(l_linenumber AS BIGINT), 0)) AS BIGINT) AS interactions FROM lineitem GROUP BY 1")
def p1(spark, d):
    """Sum of reaction columns; one is absent and counts as 0."""
    items = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("likes.count"), F.col("l_linenumber").cast("long").alias("shares.count"))
    return items.groupBy("l_suppkey").agg(F.sum(panels.interactions(items, ["likes.count", "shares.count", "thanks.count"])).cast("long").alias("interactions"))


@query("p2_coerce_weekly", f"WITH {SUPPLIERS} SELECT week_start, endpoint_id, CAST(rank_w AS BIGINT) AS rank_w, round(weekly_metric, 2) AS weekly_metric FROM weekly")
def p2(spark, d):
    """Types of a weekly panel that came as text."""
    text = supplier_weeks(spark, d).select(*[F.col(c).cast("string").alias(c) for c in ("week_start", "endpoint_id", "rank_w", "weekly_metric")])
    return text.select(F.col("week_start").try_cast("date").alias("week_start"), "endpoint_id", F.col("rank_w").try_cast("long").alias("rank_w"), F.round(F.col("weekly_metric").try_cast("double"), 2).alias("weekly_metric"))


@query("p3_positive", "SELECT user_id, count(*) AS n FROM events WHERE value > 0 AND value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1")
def p3(spark, d):
    return panels.positive(table(spark, d, "events"), "value", ["user_id", "ts"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("p4_winsorize_global", f"WITH {DAYS_SQL}, cut AS (SELECT quantile_cont(metric_value, 0.999) AS c FROM daily) SELECT date, endpoint_id, round(least(metric_value, c), 6) AS metric_value FROM daily, cut")
def p4(spark, d):
    own = panels.activity(table(spark, d, "events"), F.to_date("ts"), F.col("user_id"), F.col("value"), ("date", "endpoint_id", "metric_value"))
    own = keep(panels.positive(own, "metric_value", ["date", "endpoint_id"]), "activity")
    return panels.winsorize(own, "metric_value", 0.999).select("date", "endpoint_id", *rounded("metric_value"))


GROWTH_SQL = """
growth AS (
  SELECT a.week_start, a.endpoint_id, a.rank_w, ln(b.weekly_share) - ln(a.weekly_share) AS g
  FROM weekly a JOIN weekly b ON a.endpoint_id = b.endpoint_id AND b.week_start = a.week_start + INTERVAL 7 DAY)"""


def growth(weekly):
    after = weekly.select(F.date_sub("week_start", 7).alias("week_start"), "endpoint_id", F.ln("weekly_share").alias("_after"))
    return weekly.join(after, ["week_start", "endpoint_id"]).select("week_start", "endpoint_id", "rank_w", (F.col("_after") - F.ln("weekly_share")).alias("g"))


@query("p5_winsorize_by_rank", f"WITH {SUPPLIERS}, {GROWTH_SQL}, cut AS (SELECT rank_w, quantile_cont(abs(g), 0.99) AS c FROM growth GROUP BY 1) SELECT week_start, endpoint_id, rank_w, round(greatest(least(g, c), -c), 6) AS g FROM growth JOIN cut USING (rank_w)")
def p5(spark, d):
    return panels.winsorize_by(growth(supplier_weeks(spark, d)), "rank_w", "g", 0.99).select("week_start", "endpoint_id", "rank_w", *rounded("g"))


@query(
    "p6_winsorize_two_sided",
    f"WITH {SUPPLIERS}, {GROWTH_SQL}, cut AS (SELECT rank_w, quantile_cont(g, 0.05) AS lo, quantile_cont(g, 0.95) AS hi FROM growth GROUP BY 1) SELECT week_start, endpoint_id, rank_w, round(greatest(least(g, hi), lo), 6) AS g FROM growth JOIN cut USING (rank_w)",
)
def p6(spark, d):
    return panels.winsorize_by(growth(supplier_weeks(spark, d)), "rank_w", "g", 0.95, two_sided=True).select("week_start", "endpoint_id", "rank_w", *rounded("g"))


@query("p7_filter_sparse_dates", f"WITH {DAYS_SQL}, bad AS (SELECT date FROM daily GROUP BY 1 HAVING count(*) < 135) SELECT date, endpoint_id, metric_value, rank FROM daily WHERE date NOT IN (SELECT date FROM bad)")
def p7(spark, d):
    daily = user_days(spark, d)
    return panels.drop_periods(daily, "date", panels.sparse_periods(daily, "date", SMALL.min_rows_per_day)).select("date", "endpoint_id", "metric_value", "rank")


@query("p7_removed_dates", f"WITH {DAYS_SQL} SELECT date, count(*) AS n FROM daily GROUP BY 1 HAVING count(*) < 135")
def p7_removed(spark, d):
    return panels.sparse_periods(user_days(spark, d), "date", SMALL.min_rows_per_day)


@query(
    "p8_weeks_with_bad_days",
    f"WITH {DAYS_SQL}, bad AS (SELECT DISTINCT CAST(date_trunc('week', date) AS DATE) AS week_start FROM (SELECT date FROM daily GROUP BY 1 HAVING count(*) < 130)) SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, count(*) AS n FROM daily WHERE CAST(date_trunc('week', date) AS DATE) NOT IN (SELECT week_start FROM bad) GROUP BY 1",
)
def p8(spark, d):
    """Weeks left when any with a thin day goes."""
    daily = user_days(spark, d).withColumn("week_start", panels.week_of("date"))
    bad = panels.sparse_periods(daily, "date", SMALL.min_rows_bad_day).select(panels.week_of("date").alias("week_start"))
    return panels.drop_periods(daily, "week_start", bad).groupBy("week_start").agg(F.count("*").alias("n"))


@query("p9_drop_thin_weeks", f"WITH {CUSTOMERS}, thin AS (SELECT week_start FROM weekly GROUP BY 1 HAVING count(*) < 30) SELECT week_start, endpoint_id, rank_w FROM weekly WHERE week_start NOT IN (SELECT week_start FROM thin)")
def p9(spark, d):
    weekly = customer_weeks(spark, d)
    return panels.drop_periods(weekly, "week_start", panels.sparse_periods(weekly, "week_start", 30)).select("week_start", "endpoint_id", "rank_w")


@query("p10_full_head_weeks", f"WITH {SUPPLIERS} SELECT week_start FROM weekly WHERE rank_w <= 50 GROUP BY 1 HAVING count(DISTINCT rank_w) = 50 AND min(rank_w) = 1 AND max(rank_w) = 50")
def p10(spark, d):
    return panels.full_head_periods(supplier_weeks(spark, d), "week_start", "rank_w", SMALL.k_head)


@query("p11_micro_shares", f"WITH {SUPPLIERS} SELECT count(*) AS n FROM weekly WHERE weekly_share > 1e-8")
def p11(spark, d):
    return supplier_weeks(spark, d).where(F.col("weekly_share") > SMALL.micro_share).agg(F.count("*").alias("n"))


@query("p12_low_share_outliers", f"WITH {SUPPLIERS} SELECT week_start, endpoint_id, round(weekly_share, 9) AS weekly_share FROM weekly WHERE weekly_share < 0.0003")
def p12(spark, d):
    return supplier_weeks(spark, d).where("weekly_share < 0.0003D").select("week_start", "endpoint_id", *rounded("weekly_share", digits=9))


@query("p13_ranks_keep", f"WITH {SUPPLIERS} SELECT week_start, endpoint_id, rank_w FROM weekly WHERE rank_w IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)")
def p13(spark, d):
    return supplier_weeks(spark, d).where(F.col("rank_w").isin(*SMALL.ranks_keep)).select("week_start", "endpoint_id", "rank_w")


@query(
    "p14_rank_bands",
    f"WITH {SUPPLIERS}, b AS (SELECT CAST(power(2, floor(log2(rank_w))) AS INTEGER) AS low FROM weekly) SELECT CASE WHEN low = 1 THEN '1' ELSE low || '-' || (2 * low - 1) END AS band, count(*) AS n FROM b GROUP BY 1",
)
def p14(spark, d):
    return supplier_weeks(spark, d).groupBy(panels.rank_band("rank_w").alias("band")).agg(F.count("*").alias("n"))


@query("p15_anchor_days", f"WITH {DAYS_SQL} SELECT date, endpoint_id, rank FROM daily WHERE day(date) IN (1, 8, 15, 22) AND rank <= 20")
def p15(spark, d):
    """The largest endpoints on the anchor days."""
    return user_days(spark, d).where(F.dayofmonth("date").isin(*SMALL.anchor_days) & (F.col("rank") <= 20)).select("date", "endpoint_id", "rank")


@query("p16_amount_shares", f"WITH {SUPPLIERS}, t AS (SELECT DISTINCT week_start, weekly_total FROM weekly) SELECT a AS amount, round(avg(a / weekly_total), 12) AS share FROM t, (VALUES (10.0::DOUBLE), (100.0::DOUBLE)) v(a) GROUP BY 1")
def p16(spark, d):
    return panels.likes_share(supplier_weeks(spark, d), [10.0, 100.0]).select("amount", F.round("share", 12).alias("share"))


@query(
    "p17_smooth_means",
    f"""WITH {SUPPLIERS}, s AS (SELECT rank_w, avg(weekly_share) AS y FROM weekly WHERE rank_w <= 50 GROUP BY 1),
    e AS (SELECT max(rank_w) AS n FROM s), i AS (SELECT s.rank_w, least(greatest(s.rank_w + o, 1), n) AS j FROM s, e, (VALUES (-2), (-1), (0), (1), (2)) v(o))
    SELECT i.rank_w AS rank_w, round(sum(s.y) / 5, 9) AS smooth FROM i JOIN s ON s.rank_w = i.j GROUP BY 1""",
)
def p17(spark, d):
    """Moving average of five mean shares, ends repeated."""
    means = supplier_weeks(spark, d).where(F.col("rank_w") <= 50).groupBy("rank_w").agg(F.avg("weekly_share").alias("y"))
    return panels.smooth_edges(means.withColumn("g", F.lit(0)), "rank_w", "y", 5, "g").select("rank_w", *rounded("smooth", digits=9))


@query(
    "p18_share_floor",
    f"WITH {PARTS}, e AS (SELECT greatest(1e-12, quantile_cont(weekly_share, 0.001) / 10) AS eps FROM weekly WHERE weekly_share > 0) SELECT count(*) AS n, round(min(ln(greatest(weekly_share, eps))), 6) AS least_log, round(max(eps), 12) AS eps FROM weekly, e",
)
def p18(spark, d):
    """Logs of shares with a floor of a tenth of their 0.001-quantile."""
    weekly = keep(part_weeks(spark, d).select("weekly_share"), "shares")
    eps = quantiles(weekly.where("weekly_share > 0"), "weekly_share", [0.001]).select(F.greatest(F.lit(1e-12), F.col("q") / 10).alias("eps"))
    return weekly.crossJoin(F.broadcast(eps)).agg(F.count("*").alias("n"), F.round(F.min(F.ln(F.greatest("weekly_share", "eps"))), 6).alias("least_log"), F.round(F.max("eps"), 12).alias("eps"))


@query("a1_daily_sums", "SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS endpoint_id, round(sum(value), 2) AS metric_value FROM events GROUP BY 1, 2")
def a1(spark, d):
    return panels.activity(table(spark, d, "events"), F.to_date("ts"), F.col("user_id"), F.col("value"), ("date", "endpoint_id", "metric_value"))


@query("a2_weekly_panel", f"WITH {SUPPLIERS} SELECT week_start, endpoint_id, weekly_metric, weekly_total, round(weekly_share, 9) AS weekly_share, rank_w FROM weekly")
def a2(spark, d):
    return supplier_weeks(spark, d).withColumns({"weekly_share": panels.rounded("weekly_share", 9)})


@query(
    "a3_weekly_platform_total",
    f"""WITH {DAYS_SQL}, w AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week_start FROM daily WHERE rank <= 100),
    t AS (SELECT week_start, round(sum(total_metric), 2) AS weekly_total FROM (SELECT DISTINCT date, week_start, total_metric FROM w) GROUP BY 1),
    s AS (SELECT week_start, endpoint_id, round(sum(metric_value), 2) AS weekly_metric FROM w GROUP BY 1, 2)
    SELECT week_start, endpoint_id, weekly_metric, weekly_total, round(weekly_metric / weekly_total, 9) AS weekly_share, CAST(row_number() OVER (PARTITION BY week_start ORDER BY weekly_metric DESC, endpoint_id) AS INTEGER) AS rank_w FROM s JOIN t USING (week_start)""",
)
def a3(spark, d):
    """Weekly shares of the platform's total, from the 100 largest of each day."""
    out = panels.weekly_of_daily(keep(user_days(spark, d).where(F.col("rank") <= 100), "days")).withColumns({"weekly_share": panels.rounded("weekly_share", 9)})
    return out.select("week_start", "endpoint_id", "weekly_metric", "weekly_total", "weekly_share", "rank_w")


@query("a4_collapse_duplicates", "SELECT CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) AS week_start, CAST(o_custkey AS VARCHAR) AS endpoint_id, round(sum(o_totalprice), 2) AS weekly_metric FROM orders GROUP BY 1, 2")
def a4(spark, d):
    return panels.activity(table(spark, d, "orders"), panels.week_of("o_orderdate"), F.col("o_custkey"), F.col("o_totalprice"), ("week_start", "endpoint_id", "weekly_metric"))


@query(
    "a9_diagnostics",
    f"""WITH {DAYS_SQL}, n AS (SELECT count(*) AS c FROM daily GROUP BY date), u AS (SELECT count(*) AS c FROM daily GROUP BY date, endpoint_id HAVING count(*) > 1)
    SELECT (SELECT count(*) FROM daily) AS n_rows, (SELECT count(DISTINCT date) FROM daily) AS n_days, (SELECT count(DISTINCT endpoint_id) FROM daily) AS n_ids, min(c) AS least, round(median(c), 6) AS middle, max(c) AS most, (SELECT count(*) FROM u) AS n_repeated FROM n""",
)
def a9(spark, d):
    """Rows, days, endpoints, rows in a day, and repeated (date, id) pairs."""
    pairs = user_days(spark, d).groupBy("date", "endpoint_id").agg(F.count("*").alias("c"))
    days = pairs.groupBy("date").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 1).alias("repeated"))
    ids = pairs.agg(F.countDistinct("endpoint_id").alias("n_ids"))
    one = days.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_days"), F.min("c").alias("least"), F.round(F.median("c"), 6).alias("middle"), F.max("c").alias("most"), F.sum("repeated").alias("n_repeated"))
    return one.crossJoin(ids).select("n_rows", "n_days", "n_ids", "least", "middle", "most", "n_repeated")


@query("a11_rows_per_day", f"WITH {DAYS_SQL}, n AS (SELECT date, count(*) AS n FROM daily GROUP BY 1) SELECT date, n, round((SELECT median(n) FROM n), 6) AS middle FROM n")
def a11(spark, d):
    n = user_days(spark, d).groupBy("date").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.round(F.median("n"), 6).alias("middle"))))


@query("a13_unique_per_week", f"WITH {PARTS} SELECT week_start, count(*) AS n, count(DISTINCT endpoint_id) AS n_ids FROM weekly GROUP BY 1")
def a13(spark, d):
    return part_weeks(spark, d).groupBy("week_start").agg(F.count("*").alias("n"), F.countDistinct("endpoint_id").alias("n_ids"))


@query("a17_ties", f"WITH {PARTS} SELECT week_start, weekly_metric, count(*) AS n FROM weekly GROUP BY 1, 2 HAVING count(*) > 1")
def a17(spark, d):
    return part_weeks(spark, d).groupBy("week_start", "weekly_metric").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "a18_panel_depth",
    f"WITH {SUPPLIERS}, n AS (SELECT count(*) AS c FROM weekly GROUP BY week_start) SELECT CAST(floor(median(c)) AS BIGINT) AS k_full, round(quantile_cont(c, 0.1), 6) AS p10, round(quantile_cont(c, 0.9), 6) AS p90, min(c) AS least, max(c) AS most FROM n",
)
def a18(spark, d):
    """Rows of a week: middle, spread and extremes."""
    n = supplier_weeks(spark, d).groupBy("week_start").agg(F.count("*").alias("c"))
    return n.agg(F.floor(F.median("c")).cast("long").alias("k_full"), F.round(F.percentile("c", 0.1), 6).alias("p10"), F.round(F.percentile("c", 0.9), 6).alias("p90"), F.min("c").alias("least"), F.max("c").alias("most"))


@query("w1_dense_rank", f"WITH {PARTS} SELECT week_start, endpoint_id, CAST(dense_rank() OVER (PARTITION BY week_start ORDER BY weekly_metric DESC) AS INTEGER) AS rank FROM weekly")
def w1(spark, d):
    return panels.ranked(part_sums(spark, d), "week_start", "weekly_metric", "rank", "dense_rank").select("week_start", "endpoint_id", "rank")


@query("w2_row_number_cut", f"WITH {PARTS} SELECT week_start, endpoint_id, rank_w FROM weekly WHERE rank_w <= 25")
def w2(spark, d):
    """The 25 largest rows of each week with their unique ranks; all others go before the last shuffle."""
    return panels.top_n(part_sums(spark, d), "week_start", "weekly_metric", 25, [F.col("endpoint_id")], kind="row_number", name="rank_w").select("week_start", "endpoint_id", "rank_w")


@query("w3_min_rank", f"WITH {PARTS} SELECT week_start, endpoint_id, CAST(rank() OVER (PARTITION BY week_start ORDER BY weekly_metric DESC) AS INTEGER) AS rank FROM weekly")
def w3(spark, d):
    return panels.ranked(part_sums(spark, d), "week_start", "weekly_metric", "rank", "rank").select("week_start", "endpoint_id", "rank")


@query("w4_unique_rank_sliced", f"WITH {PARTS} SELECT week_start, endpoint_id, rank_w FROM weekly")
def w4(spark, d):
    """Unique ranks of periods that no task holds as a whole."""
    own = part_sums(spark, d)
    return panels.ranked(own, "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")]).select("week_start", "endpoint_id", "rank_w")


@query(
    "w4_rank_by_previous",
    f"""WITH {PARTS} SELECT a.week_start, a.endpoint_id, CAST(row_number() OVER (PARTITION BY a.week_start ORDER BY a.weekly_metric DESC, b.rank_w ASC NULLS LAST, a.endpoint_id) AS INTEGER) AS rank_w
    FROM weekly a LEFT JOIN weekly b ON a.endpoint_id = b.endpoint_id AND a.week_start = b.week_start + INTERVAL 7 DAY""",
)
def w4_previous(spark, d):
    """Ties go to who ranked higher the week before."""
    return panels.previous_rank(part_sums(spark, d), "week_start", "weekly_metric", "rank_w").select("week_start", "endpoint_id", "rank_w")


@query("w5_shares", f"WITH {DAYS_SQL} SELECT date, endpoint_id, total_metric, round(share, 9) AS share FROM daily")
def w5(spark, d):
    return user_days(spark, d).select("date", "endpoint_id", "total_metric", *rounded("share", digits=9))


@query("w17_top_per_anchor", f"WITH {DAYS_SQL} SELECT date, endpoint_id, rank FROM daily WHERE rank <= 10")
def w17(spark, d):
    return panels.top_n(user_sums(spark, d), "date", "metric_value", 10, [F.col("endpoint_id")], kind="row_number").select("date", "endpoint_id", "rank")


@query(
    "t1_top_daily",
    f"WITH {DAYS_SQL} SELECT date, endpoint_id, metric_value, rank FROM (SELECT date, endpoint_id, metric_value, CAST(dense_rank() OVER (PARTITION BY date ORDER BY metric_value DESC) AS INTEGER) AS rank, row_number() OVER (PARTITION BY date ORDER BY metric_value DESC, endpoint_id) AS n FROM daily) WHERE n <= 20",
)
def t1(spark, d):
    """The 20 largest of each day, with dense ranks."""
    return panels.top_n(user_sums(spark, d), "date", "metric_value", 20, [F.col("endpoint_id")])


@query(
    "t2_top_weekly",
    f"WITH {PARTS} SELECT week_start, endpoint_id, weekly_metric, rank FROM (SELECT week_start, endpoint_id, weekly_metric, rank_w, CAST(dense_rank() OVER (PARTITION BY week_start ORDER BY weekly_metric DESC) AS INTEGER) AS rank FROM weekly) WHERE rank_w <= 100",
)
def t2(spark, d):
    return panels.top_n(part_sums(spark, d), "week_start", "weekly_metric", 100, [F.col("endpoint_id")])


@query(
    "t6_thinned_starts",
    f"WITH {SUPPLIERS}, w AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week_start FROM weekly)) SELECT week_start, i FROM w WHERE list_contains(list_transform(range(12), lambda j: CAST(floor(1 + j * (n - 1) / 11.0) AS BIGINT)), i)",
)
def t6(spark, d):
    """Twelve start weeks, evenly spaced."""
    return panels.thinned_starts(supplier_weeks(spark, d), "week_start")


@query(
    "u1_union_horizons",
    f"WITH {SUPPLIERS} SELECT 'top 10' AS list, count(*) AS n, NULL::BIGINT AS k FROM weekly WHERE rank_w <= 10 UNION ALL SELECT 'top 50', count(*), 50 FROM weekly WHERE rank_w <= 50",
)
def u1(spark, d):
    """Rows of two tables, one of which lacks a column."""
    weekly = supplier_weeks(spark, d)
    a = weekly.where("rank_w <= 10").agg(F.count("*").alias("n")).select(F.lit("top 10").alias("list"), "n")
    b = weekly.where("rank_w <= 50").agg(F.count("*").alias("n")).select(F.lit("top 50").alias("list"), "n", F.lit(50).cast("long").alias("k"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_distinct_weeks", f"WITH {PARTS} SELECT DISTINCT week_start FROM weekly")
def u2(spark, d):
    return part_weeks(spark, d).select("week_start").distinct()


@query(
    "u3_missing_dates",
    "WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), s AS (SELECT min(date) AS a, max(date) AS b FROM o) SELECT CAST(t.d AS DATE) AS date FROM s, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS t(d) WHERE CAST(t.d AS DATE) NOT IN (SELECT date FROM o)",
)
def u3(spark, d):
    """Calendar dates without an order."""
    return panels.missing_dates(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), "date")


@query("u5_unpivot", f"WITH {SUPPLIERS}, s AS (SELECT rank_w AS k, round(avg(weekly_share), 9) AS mean, round(median(weekly_share), 9) AS middle FROM weekly GROUP BY 1) UNPIVOT s ON mean, middle INTO NAME type VALUE value")
def u5(spark, d):
    s = supplier_weeks(spark, d).groupBy(F.col("rank_w").alias("k")).agg(F.round(F.avg("weekly_share"), 9).alias("mean"), F.round(F.median("weekly_share"), 9).alias("middle"))
    return s.unpivot("k", ["mean", "middle"], "type", "value")


@query(
    "u6_densify",
    f"WITH {DAYS_SQL}, g AS (SELECT a.date, b.endpoint_id FROM (SELECT DISTINCT date FROM daily) a, (SELECT DISTINCT endpoint_id FROM daily) b) SELECT g.date, g.endpoint_id, coalesce(rank, 2001) AS rank, round(coalesce(share, 0), 9) AS share FROM g LEFT JOIN daily USING (date, endpoint_id)",
)
def u6(spark, d):
    """The full grid of dates and endpoints; an absent one has rank 2001 and share 0.

    Each endpoint's dates come from an array of all dates, which a calendar bounds.
    """
    daily = user_days(spark, d)
    dates = daily.agg(F.sort_array(F.collect_set("date")).alias("dates"))
    grid = daily.select("endpoint_id").distinct().crossJoin(F.broadcast(dates)).select("endpoint_id", F.explode("dates").alias("date"))
    full = grid.join(daily, ["date", "endpoint_id"], "left")
    return full.select("date", "endpoint_id", F.coalesce("rank", F.lit(2001)).alias("rank"), panels.rounded(F.coalesce("share", F.lit(0.0)), 9).alias("share"))


@query("u7_unnest_members", f"WITH {SUPPLIERS} SELECT week_start, endpoint_id FROM weekly WHERE rank_w <= 5")
def u7(spark, d):
    """Members of a list column, a row each."""
    lists = supplier_weeks(spark, d).where("rank_w <= 5").groupBy("week_start").agg(F.collect_list("endpoint_id").alias("members"))
    return lists.select("week_start", F.explode("members").alias("endpoint_id"))


@query("r1_sample_with_jitter")
def r1(spark, d):
    """A tenth of the rows with a fixed seed, ranks moved by up to half a place."""
    return user_days(spark, d).sample(0.1, SMALL.seed).withColumn("x", F.col("rank") + F.rand(SMALL.seed) - 0.5)


@query(
    "f1_scalar_functions",
    f"WITH {DAYS_SQL} SELECT date, strftime(date, '%A') AS day_name, CAST(date_trunc('week', date) AS DATE) AS monday, CAST(ceil(count(*) / 10.0) AS BIGINT) AS bin, round(ln(max(metric_value)), 6) AS log_top, lower('N-' || count(*)) AS label FROM daily GROUP BY date",
)
def f1(spark, d):
    """Day names, Mondays, right-closed bins, logs and labels."""
    n = F.count("*")
    return user_days(spark, d).groupBy("date").agg(F.ceil(n / 10.0).cast("long").alias("bin"), F.round(F.ln(F.max("metric_value")), 6).alias("log_top"), F.lower(F.concat(F.lit("N-"), n.cast("string"))).alias("label")).select("date", F.date_format("date", "EEEE").alias("day_name"), panels.week_of("date").alias("monday"), "bin", "log_top", "label")
