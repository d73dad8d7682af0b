"""Queries over statistics by rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderlens.config import SMALL, EngineConfig
from ladderlens.functions import numeric
from ladderlens.operators import churn, pairs, panels, stats
from ladderlens.operators.density import densities
from ladderlens.plans.inputs import DAYS_SQL, SUPPLIERS, rounded, supplier_weeks, user_days
from ladderlens.registry import query
from ladderlens.tables import keep

GROWTH_SQL = f"""{SUPPLIERS},
growth AS (SELECT a.week_start, a.endpoint_id, a.rank_w, ln(b.weekly_share) - ln(a.weekly_share) AS g FROM weekly a JOIN weekly b ON b.endpoint_id = a.endpoint_id AND b.week_start = a.week_start + 7),
gaps AS (SELECT * FROM (SELECT week_start, rank_w, lead(rank_w) OVER w AS nx, ln(weekly_share) - ln(lead(weekly_share) OVER w) AS gap FROM weekly WINDOW w AS (PARTITION BY week_start ORDER BY rank_w)) WHERE nx = rank_w + 1),
rank_stats AS (SELECT rank_w AS k, avg(g) AS bar_g, median(g) AS tilde_g, var_samp(g) AS v, count(*) AS n FROM growth GROUP BY 1),
delta AS (SELECT rank_w AS k, avg(gap) AS delta FROM gaps GROUP BY 1),
mhat AS (SELECT rank_w AS k, avg(ln(weekly_share)) AS mhat FROM weekly GROUP BY 1),
head AS (SELECT k, bar_g, v, n, delta, mhat FROM mhat LEFT JOIN rank_stats USING (k) LEFT JOIN delta USING (k) WHERE k <= 50)"""


def week_growth(weekly):
    return pairs.growth_pairs(weekly, "week_start", "weekly_share", "rank_w", [1], 7)


def head(spark, d, k_max=50):
    """The rank table of the weekly panel; it is written, so that models start from its few rows."""
    return stats.rank_table(supplier_weeks(spark, d, "week_rows"), "week_start", "weekly_share", "rank_w", "week_rows", k_max, 7)


@query("a5_rank_summary", f"WITH {GROWTH_SQL} SELECT k, round(bar_g, 6) AS mean, round(tilde_g, 6) AS middle, round(v, 6) AS variance, n FROM rank_stats WHERE n >= 30")
def a5(spark, d):
    return stats.rank_summary(week_growth(supplier_weeks(spark, d)), "rank_w", "g", 30).select("k", *rounded("mean", "middle", "variance"), "n")


@query("a6_share_by_rank", f"WITH {SUPPLIERS} SELECT rank_w AS k, round(avg(weekly_share), 9) AS mean, round(median(weekly_share), 9) AS middle, count(*) AS n FROM weekly GROUP BY 1")
def a6(spark, d):
    return stats.rank_summary(supplier_weeks(spark, d), "rank_w", "weekly_share").select("k", *rounded("mean", "middle", digits=9), "n")


@query("a7_head_gaps", f"WITH {GROWTH_SQL} SELECT k, round(bar_g, 6) AS bar_g, round(v, 6) AS v, n, round(delta, 6) AS delta, round(mhat, 6) AS mhat FROM head")
def a7(spark, d):
    """Mean growth, its variance, mean log gap and mean log share of the head's ranks."""
    return head(spark, d).select("k", *rounded("bar_g", "v"), "n", *rounded("delta", "mhat"))


@query("a8_top_share", f"WITH {SUPPLIERS} SELECT round(avg(s), 9) AS top_share FROM (SELECT sum(weekly_share) FILTER (rank_w <= 50) AS s FROM weekly GROUP BY week_start)")
def a8(spark, d):
    return stats.top_share(supplier_weeks(spark, d), SMALL.k_head).select(*rounded("top_share", digits=9))


@query(
    "a12_variance_by_previous_rank",
    f"WITH {GROWTH_SQL} SELECT k AS prev_rank, round(v, 6) AS variance, greatest(n - 1, 1) AS weight FROM rank_stats WHERE v IS NOT NULL",
)
def a12(spark, d):
    own = stats.rank_summary(week_growth(supplier_weeks(spark, d)), "rank_w", "g").where("variance is not null")
    return own.select(F.col("k").alias("prev_rank"), *rounded("variance"), F.greatest(F.col("n") - 1, F.lit(1)).alias("weight"))


@query("a14_quantile_bands", f"WITH {SUPPLIERS} SELECT rank_w AS k, round(quantile_cont(ln(weekly_share), 0.1), 6) AS p10, round(quantile_cont(ln(weekly_share), 0.5), 6) AS p50, round(quantile_cont(ln(weekly_share), 0.9), 6) AS p90 FROM weekly GROUP BY 1")
def a14(spark, d):
    own = supplier_weeks(spark, d).withColumn("y", F.ln("weekly_share"))
    return own.groupBy(F.col("rank_w").alias("k")).agg(*[panels.rounded(F.percentile("y", p / 100), 6).alias(f"p{p}") for p in (10, 50, 90)])


@query("a20_average_total", f"WITH {SUPPLIERS}, t AS (SELECT DISTINCT week_start, weekly_total FROM weekly), c AS (SELECT k, round(sum(mid), 9) AS captured FROM (SELECT unnest([10, 20, 50]) AS k) g JOIN (SELECT rank_w, avg(weekly_share) AS mid FROM weekly GROUP BY 1) s ON s.rank_w <= k GROUP BY 1) SELECT k, captured, (SELECT round(avg(weekly_total), 2) FROM t) AS average_total FROM c")
def a20(spark, d):
    """What mean shares of the top k add up to, and the average weekly total."""
    weekly = supplier_weeks(spark, d)
    total = weekly.select("week_start", "weekly_total").distinct().agg(F.round(F.avg("weekly_total"), 2).alias("average_total"))
    mean = weekly.groupBy("rank_w").agg(F.avg("weekly_share").alias("mid")).withColumn("k", F.explode(F.array(*map(F.lit, SMALL.capture_sizes)))).where("rank_w <= k")
    return mean.groupBy("k").agg(F.round(F.sum("mid"), 9).alias("captured")).crossJoin(F.broadcast(total))


@query("a21_unknown_total", f"WITH {SUPPLIERS}, t AS (SELECT week_start, max(weekly_total) AS known, sum(weekly_metric) FILTER (rank_w <= 50) AS head, sum(weekly_share) FILTER (rank_w <= 50) AS s FROM weekly GROUP BY 1), m AS (SELECT avg(s) AS s FROM t) SELECT week_start, round(head / m.s, 2) AS estimate, round(head / m.s - known, 2) AS gap FROM t, m")
def a21(spark, d):
    """Weekly totals estimated from the head's sum and its mean share, and how far off they are."""
    own = supplier_weeks(spark, d).groupBy("week_start").agg(F.max("weekly_total").alias("known"), F.sum(F.when(F.col("rank_w") <= 50, F.col("weekly_metric"))).alias("head"), F.sum(F.when(F.col("rank_w") <= 50, F.col("weekly_share"))).alias("s"))
    mean = own.agg(F.avg("s").alias("mean_s"))
    return own.crossJoin(F.broadcast(mean)).select("week_start", panels.rounded(F.col("head") / F.col("mean_s"), 2).alias("estimate"), panels.rounded(F.col("head") / F.col("mean_s") - F.col("known"), 2).alias("gap"))


@query("a22_decile_variance", f"WITH {GROWTH_SQL} SELECT CAST(ceil(rank_w / 5.0) AS BIGINT) AS decile, round(var_samp(g), 6) AS variance, count(*) AS n FROM growth WHERE rank_w <= 50 GROUP BY 1")
def a22(spark, d):
    own = week_growth(supplier_weeks(spark, d)).where("rank_w <= 50")
    return own.groupBy(F.ceil(F.col("rank_w") / 5.0).cast("long").alias("decile")).agg(F.round(F.var_samp("g"), 6).alias("variance"), F.count("*").alias("n"))


TRIM_SQL = f"{GROWTH_SQL}, o AS (SELECT k, v, n, sum(n) OVER (ORDER BY v, k ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cw FROM head WHERE v IS NOT NULL)"


@query("m7_trimmed_variance", f"WITH {TRIM_SQL} SELECT round(coalesce(sum(v * n) FILTER (cw BETWEEN 0.1 AND 0.9) / sum(n) FILTER (cw BETWEEN 0.1 AND 0.9), sum(v * n) / sum(n)), 6) AS sigma2 FROM o")
def m7(spark, d):
    own = head(spark, d).where("v is not null").withColumn("candidate", F.lit(0))
    return stats.trimmed_mean(own, "v", "n", SMALL.trim, ["candidate"]).select(F.round("trimmed", 6).alias("sigma2"))


@query("m8_weighted_median", f"WITH {TRIM_SQL} SELECT round(min(v), 6) AS weighted_median FROM o WHERE cw >= 0.5")
def m8(spark, d):
    own = head(spark, d).where("v is not null").withColumn("candidate", F.lit(0))
    return stats.weighted_median(own, "v", "n", ["candidate"]).select(*rounded("weighted_median"))


@query("w20_weight_mass", f"WITH {TRIM_SQL} SELECT k, round(cw, 6) AS cw FROM o")
def w20(spark, d):
    own = head(spark, d).where("v is not null").withColumn("candidate", F.lit(0))
    return stats.order_weights(own, "v", "n", ["candidate"]).select("k", *rounded("cw"))


@query("m7_variance_variants")
def m7_variants(spark, d):
    """Pooled variance by four estimators, for heads of several sizes, from tables with a row for each rank."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        v, n = pdf["v"].to_numpy(float), pdf["n"].to_numpy(float)
        cut = int(0.1 * len(v))
        plain = float(np.sort(v)[cut : len(v) - cut].mean()) if len(v) > 2 * cut else float(np.median(v))
        rows = {"huber": numeric.huber_mean(v, n), "interpolated": numeric.trimmed_interp(v, n, 0.1), "plain": plain, "mean": float(np.average(v, weights=n))}
        return pd.DataFrame({"k_max": int(pdf["k_max"].iloc[0]), "variant": list(rows), "sigma2": list(rows.values())})

    sizes = (30, 50, 80)
    own = head(spark, d, max(sizes)).where("v is not null").select("k", "v", "n", F.explode(F.array(*map(F.lit, sizes))).alias("k_max")).where("k <= k_max")
    return own.groupBy("k_max").applyInPandas(fit, "k_max int, variant string, sigma2 double")


BF_SQL = f"""{GROWTH_SQL},
z AS (SELECT b, abs(g - median(g) OVER (PARTITION BY b)) AS z FROM (SELECT CAST(ceil(rank_w / 5.0) AS BIGINT) AS b, g FROM growth WHERE rank_w <= 50)),
by_b AS (SELECT b, count(*) AS n, avg(z) AS m, sum(z * z) AS q FROM z GROUP BY 1),
f AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb, sum(q) - sum(n * m * m) AS ssw FROM by_b)"""


@query("m9_brown_forsythe", f"WITH {BF_SQL} SELECT round((ssb / (groups - 1)) / (ssw / (n - groups)), 4) AS f, groups - 1 AS d1, CAST(n - groups AS BIGINT) AS d2 FROM f")
def m9(spark, d):
    """F of the spread of growth over ten bins of ranks."""
    own = keep(week_growth(supplier_weeks(spark, d)).where("rank_w <= 50").select("rank_w", "g"), "growth")
    return stats.brown_forsythe(own, F.ceil(F.col("rank_w") / 5.0), "g").select(F.round("f", 4).alias("f"), "d1", "d2")


@query("m10_window_pick")
def m10(spark, d):
    """The first lower bound from which variances look equal, else the one with the largest p-value."""
    high = SMALL.window_high
    own = keep(week_growth(supplier_weeks(spark, d)).where(F.col("rank_w") <= high).select("rank_w", "g"), "growth")
    tests = None
    for low in SMALL.window_lows:  # fixed list of candidates, one aggregate each
        one = stats.brown_forsythe(own.where(F.col("rank_w").between(low + 1, high)), F.ceil((F.col("rank_w") - low) / ((high - low) / 10)), "g").withColumn("low", F.lit(low))
        tests = one if tests is None else tests.unionByName(one)

    def value(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(p=[numeric.f_tail(f, a, b) if f == f and f is not None else None for f, a, b in zip(frame["f"], frame["d1"], frame["d2"], strict=True)])

    tests = tests.mapInPandas(value, "f double, d1 long, d2 long, low int, p double")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("p") >= 0.01), F.when(F.col("p") >= 0.01, F.col("low")).otherwise(0), F.desc("p"))  # three rows
    return tests.withColumn("chosen", F.row_number().over(order) == 1)


SEGMENTS = [(1, 10), (11, 50), (51, 1000)]


def share_curves(spark, d):
    """(curve, rank_w, y): mean and median share by rank."""
    own = supplier_weeks(spark, d).groupBy("rank_w").agg(F.avg("weekly_share").alias("mean"), F.median("weekly_share").alias("median"))
    return own.unpivot("rank_w", ["mean", "median"], "curve", "y")


@query(
    "m27_power_law",
    f"""WITH {SUPPLIERS}, s AS (SELECT rank_w, avg(weekly_share) AS mean, median(weekly_share) AS median FROM weekly GROUP BY 1), c AS (UNPIVOT s ON mean, median INTO NAME curve VALUE y),
    p AS (SELECT curve, low, high, ln(rank_w) AS x, ln(y) AS y FROM c JOIN (VALUES (1, 10), (11, 50), (51, 1000)) v(low, high) ON rank_w BETWEEN low AND high)
    SELECT curve, low, high, round(-regr_slope(y, x), 6) AS alpha, round(sqrt(greatest(0, 1 - regr_r2(y, x)) * regr_syy(y, x) / ((count(*) - 2) * regr_sxx(y, x))), 6) AS std_error, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM p GROUP BY 1, 2, 3 HAVING count(*) > 2""",
)
def m27(spark, d):
    """Slopes of log share on log rank in three segments, of the mean and of the median curve."""
    return stats.power_law(share_curves(spark, d), "rank_w", "y", SEGMENTS, ["curve"]).where("n > 2").select("curve", "low", "high", *rounded("alpha", "std_error", "intercept", "r2"), "n")


@query("m27_confidence")
def m27_confidence(spark, d):
    """95 % intervals of those slopes."""
    fits = stats.power_law(share_curves(spark, d), "rank_w", "y", SEGMENTS, ["curve"]).where("n > 2").select("curve", "low", "high", "alpha", "std_error", "n")

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            t = np.array([numeric.t_quantile(0.05, n - 2) for n in frame["n"]])
            yield frame.assign(ci_low=frame["alpha"] - t * frame["std_error"], ci_high=frame["alpha"] + t * frame["std_error"])

    return fits.mapInPandas(bounds, "curve string, low int, high int, alpha double, std_error double, n long, ci_low double, ci_high double")


WLS = """
p AS (SELECT {span} AS span, {x} AS x, {y} AS y, {w} AS w FROM {source}),
s AS (SELECT span, count(*) AS n, sum(ln(w)) AS lw, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM p GROUP BY 1),
l AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope FROM s), i AS (SELECT *, (sy - slope * sx) / sw AS intercept FROM l),
r AS (SELECT *, syy - intercept * sy - slope * sxy AS rss, syy - sy * sy / sw AS rss0 FROM i),
k AS (SELECT *, 0.5 * (lw - n * (ln(2 * pi()) + 1 - ln(n) + ln(rss))) AS ll, 0.5 * (lw - n * (ln(2 * pi()) + 1 - ln(n) + ln(rss0))) AS ll0 FROM r)"""


@query(
    "m28_variance_funnel",
    f"WITH {GROWTH_SQL}, {WLS.format(span='v.span', x='ln(k)', y='v', w='greatest(n - 1, 1)', source='rank_stats JOIN (VALUES (0, 1, 1000000000), (1, 1, 50), (2, 2, 50)) v(span, a, b) ON k BETWEEN a AND b WHERE v IS NOT NULL').replace('SELECT v.span AS span', 'SELECT span')} SELECT CASE span WHEN 0 THEN 'all' WHEN 1 THEN 'head' ELSE 'from 2' END AS span, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(1 - rss / rss0, 5) AS r2, round(6 - 2 * ll, 4) AS aic, round(3 * ln(n) - 2 * ll, 4) AS bic, round(4 - 2 * ll0, 4) AS aic_constant, round(2 * ln(n) - 2 * ll0, 4) AS bic_constant FROM k",
)
def m28(spark, d):
    """Variance of growth on log rank, against a constant: over all ranks, those of the head, and those from 2 on."""
    own = stats.rank_summary(week_growth(supplier_weeks(spark, d)), "rank_w", "g")
    k, spans = F.col("k"), {"all": F.lit(True), "head": F.col("k") <= SMALL.k_head, "from 2": F.col("k").between(2, SMALL.k_head)}
    own = own.withColumn("span", F.explode(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in spans.items()]))))
    fit = stats.weighted_line(own, F.ln(k), F.col("variance"), F.greatest(F.col("n") - 1, F.lit(1)), ["span"])
    return fit.select("span", "n", *rounded("slope", "intercept"), *rounded("r2", digits=5), *rounded("aic", "bic", "aic_constant", "bic_constant", digits=4))


@query("m29_slope_test")
def m29(spark, d):
    """Slope of variance on log rank, with its p-value."""
    own = stats.rank_summary(week_growth(supplier_weeks(spark, d)), "rank_w", "g").where("variance is not null").select(F.ln("k").alias("x"), F.col("variance").alias("y"))
    fit = own.agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))

    def value(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            t = np.sqrt(frame["r2"] * (frame["n"] - 2) / (1 - frame["r2"]))
            yield frame.assign(p=[numeric.t_tail(a, n - 2) for a, n in zip(t, frame["n"], strict=True)])

    return fit.mapInPandas(value, "slope double, r2 double, n long, p double")


def first_rank_line(spark, d):
    daily = user_days(spark, d)
    first = daily.groupBy("endpoint_id").agg(F.min_by("rank", "date").alias("rank"))
    v = pairs.growth_pairs(daily, "date", "share", "rank", [1]).groupBy("endpoint_id").agg(F.var_samp("g").alias("v"))
    by_rank = v.join(first, "endpoint_id").where("v > 0 and rank > 1").groupBy("rank").agg(F.avg("v").alias("y"))
    return stats.weighted_line(by_rank, F.ln("rank"), F.col("y"), F.col("y"))


@query(
    "m33_first_rank_funnel",
    f"""WITH {DAYS_SQL}, o AS (SELECT endpoint_id, min_by(rank, date) AS rank FROM daily GROUP BY 1), g AS (SELECT a.endpoint_id, ln(b.share) - ln(a.share) AS g FROM daily a JOIN daily b ON b.endpoint_id = a.endpoint_id AND b.date = a.date + 1),
    v AS (SELECT endpoint_id, var_samp(g) AS v FROM g GROUP BY 1), q AS (SELECT rank, avg(v) AS y FROM v JOIN o USING (endpoint_id) WHERE v > 0 AND rank > 1 GROUP BY 1), {WLS.format(span='0', x='ln(rank)', y='y', w='y', source='q')}
    SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM k""",
)
def m33(spark, d):
    """Variance of each endpoint's daily growth on the log of its first rank, weighted by the variance."""
    return first_rank_line(spark, d).select("n", *rounded("slope", "intercept"))


@query("m34_drift_line", f"WITH {DAYS_SQL}, g AS (SELECT a.rank, ln(b.share) - ln(a.share) AS g FROM daily a JOIN daily b ON b.endpoint_id = a.endpoint_id AND b.date = a.date + 1) SELECT round(regr_intercept(g, rank), 6) AS kappa, round(-regr_slope(g, rank), 6) AS eta, count(*) AS n FROM g")
def m34(spark, d):
    own = pairs.growth_pairs(user_days(spark, d), "date", "share", "rank", [1])
    return own.agg(panels.rounded(F.regr_intercept("g", "rank"), 6).alias("kappa"), panels.rounded(-F.regr_slope("g", "rank"), 6).alias("eta"), F.count("*").alias("n"))


@query("m35_variance_exponent")
def m35(spark, d):
    """A and beta of the variance of growth, A h^beta, in three bands of ranks."""
    own = pairs.growth_pairs(user_days(spark, d), "date", "share", "rank", SMALL.exponent_horizons)
    a, b = SMALL.exponent_bands
    band = F.when(F.col("rank") <= a, f"1-{a}").when(F.col("rank") <= b, f"{a + 1}-{b}").otherwise(f"{b + 1} on")
    v = own.groupBy(band.alias("band"), "horizon").agg(F.var_samp("g").alias("v")).where("v is not null")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, beta, r2 = numeric.variance_power(pdf["horizon"].to_numpy(float), pdf["v"].to_numpy(float))
        return pd.DataFrame({"band": [pdf["band"].iloc[0]], "a": [a], "beta": [beta], "r2": [r2]})

    return v.groupBy("band").applyInPandas(fit, "band string, a double, beta double, r2 double")


@query(
    "m38_growth_funnel",
    f"""WITH {DAYS_SQL}, f AS (SELECT a.date, b.endpoint_id, coalesce(rank, 2001) AS rank, ln(coalesce(share, 0) + 1e-12) AS y FROM (SELECT DISTINCT date FROM daily) a CROSS JOIN (SELECT DISTINCT endpoint_id FROM daily) b LEFT JOIN daily x ON x.date = a.date AND x.endpoint_id = b.endpoint_id),
    l AS (SELECT lag(rank) OVER w AS prev_rank, y - lag(y) OVER w AS g FROM f WINDOW w AS (PARTITION BY endpoint_id ORDER BY date)) SELECT prev_rank, count(*) AS n, round(avg(g), 6) AS mean_g, round(stddev_samp(g), 6) AS sd_g FROM l WHERE g IS NOT NULL GROUP BY 1""",
)
def m38(spark, d):
    """Growth by the rank of the day before, entries and exits included.

    Days are numbered among those that the panel has.  An endpoint's row stands
    for the step to it (an entry if the row before is not of the day before)
    and for the step from it if that is an exit; what is off the list on both
    days has growth 0 and is only counted.  So no grid of dates is made.
    """
    daily = user_days(spark, d)
    days = churn.numbered_periods(daily, "date", "at")
    span = days.agg(F.max("at").alias("last"))
    floor = F.ln(F.lit(1e-12))
    order = Window.partitionBy("endpoint_id").orderBy("at")
    rows = daily.join(F.broadcast(days), "date").crossJoin(F.broadcast(span)).select("endpoint_id", "at", "last", "rank", F.ln(F.col("share") + 1e-12).alias("y"))  # a row for each day, and one
    met = rows.withColumn("stays", F.coalesce(F.lead("at").over(order) == F.col("at") + 1, F.lit(False)))
    met = met.withColumn("came", F.coalesce(F.lag("at").over(order) == F.col("at") - 1, F.lit(False))).withColumn("old_rank", F.lag("rank").over(order)).withColumn("old_y", F.lag("y").over(order))
    off = F.lit(churn.OFF_LIST)
    step_in = F.when(F.col("at") > 1, F.struct(F.when(F.col("came"), F.col("old_rank")).otherwise(off).alias("prev_rank"), (F.col("y") - F.when(F.col("came"), F.col("old_y")).otherwise(floor)).alias("g")))
    step_out = F.when(~F.col("stays") & (F.col("at") < F.col("last")), F.struct(F.col("rank").alias("prev_rank"), (floor - F.col("y")).alias("g")))
    steps = met.select(F.inline(F.array_compact(F.array(step_in, step_out))))
    sums = steps.groupBy("prev_rank").agg(F.count("*").alias("n"), F.sum("g").alias("s"), F.sum(F.col("g") * F.col("g")).alias("q"))
    all_steps = daily.agg(F.count_distinct("endpoint_id").alias("ids")).crossJoin(span).select((F.col("ids") * (F.col("last") - 1)).alias("steps"))
    idle = steps.agg(F.count("*").alias("n")).crossJoin(all_steps).select(off.alias("prev_rank"), (F.col("steps") - F.col("n")).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")).where("n > 0")
    out = sums.unionByName(idle).groupBy("prev_rank").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") ** 2 / F.col("n"), F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0)))
    return out.select("prev_rank", "n", panels.rounded(F.col("s") / F.col("n"), 6).alias("mean_g"), panels.rounded(spread, 6).alias("sd_g"))


@query("m32_density")
def m32(spark, d):
    """Densities of weekly growth by horizon and rank at the start, with one bandwidth for each horizon."""
    config = EngineConfig()
    weekly = supplier_weeks(spark, d)
    own = pairs.growth_pairs(weekly, "week_start", "weekly_share", "rank_w", config.weekly_horizons, 7).where(F.col("rank_w").isin(*config.ranks_keep)).select("horizon", "rank_w", "g")
    return densities(keep(own, "growth"), "g", ["horizon"], ["rank_w"])
