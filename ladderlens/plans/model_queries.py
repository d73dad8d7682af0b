"""Queries over capital distribution models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.config import SMALL, EngineConfig
from ladderlens.functions import numeric, pooling
from ladderlens.functions.spline import smoothing_spline
from ladderlens.operators import bootstrap, isotone, model, pairs, panels, stats
from ladderlens.plans.inputs import SUPPLIERS, rounded, supplier_sums, supplier_weeks, user_days
from ladderlens.plans.stat_queries import GROWTH_SQL, first_rank_line, head, week_growth
from ladderlens.registry import query
from ladderlens.tables import keep

SIGMA_SQL = """
o AS (SELECT k, v, n, sum(n) OVER (ORDER BY v, k ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cw FROM head WHERE v IS NOT NULL),
s2 AS (SELECT round(coalesce(sum(v * n) FILTER (cw BETWEEN 0.1 AND 0.9) / sum(n) FILTER (cw BETWEEN 0.1 AND 0.9), sum(v * n) / sum(n)), 9) AS sigma2 FROM o),
drift AS (SELECT k, n, bar_g, mhat, 1 / greatest(coalesce(delta, (SELECT median(delta) FROM head)), 2.220446049250313e-16) AS r, sigma2 FROM head, s2),
gap_g AS (SELECT k, n, bar_g, mhat, r, sigma2, -sigma2 / 2 * r AS big_g, -sigma2 / 2 * r - coalesce(lag(-sigma2 / 2 * r) OVER (ORDER BY k), 0) AS g FROM drift)"""


def with_sigma(own):
    """Heads with the trimmed mean of their variances as sigma2; a head without candidates is candidate 0."""
    own = own if "candidate" in own.columns else own.withColumn("candidate", F.lit(0))
    s2 = stats.trimmed_mean(own.where("v is not null"), "v", "n", SMALL.trim, ["candidate"]).select("candidate", F.round("trimmed", 9).alias("sigma2"))
    return own.join(s2, "candidate")


def gap_drift(spark, d, k_max=50):
    return model.drift_from_gaps(with_sigma(head(spark, d, k_max)), F.col("sigma2"))


def heads(spark, d, sizes):
    """Heads of several sizes, from one rank table; the size is the candidate."""
    return head(spark, d, max(sizes)).withColumn("candidate", F.explode(F.array(*map(F.lit, sizes)))).where("k <= candidate")


def gap_drifts(spark, d, sizes):
    """The gap drift of heads of several sizes, from one panel; the size is the candidate."""
    return model.drift_from_gaps(with_sigma(heads(spark, d, sizes)), F.col("sigma2"))


@query("m4_drift_from_gaps", f"WITH {GROWTH_SQL}, {SIGMA_SQL} SELECT k, round(r, 5) AS r, round(big_g, 5) AS big_g, round(g, 5) AS g FROM gap_g")
def m4(spark, d):
    return gap_drift(spark, d).select("k", *rounded("r", "big_g", "g", digits=5))


@query("w15_first_difference", f"WITH {GROWTH_SQL}, {SIGMA_SQL} SELECT k, round(big_g - coalesce(lag(big_g) OVER (ORDER BY k), 0), 5) AS g FROM gap_g")
def w15(spark, d):
    return gap_drift(spark, d).select("k", *rounded("g", digits=5))


ISO_SQL = """
pre AS (SELECT k, row_number() OVER (ORDER BY k) AS i, sum(w) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS cw, sum(w * y) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS cy, w, y FROM src),
blocks AS (SELECT a.i AS i, b.i AS j, (b.cy - a.cy + a.w * a.y) / (b.cw - a.cw + a.w) AS m FROM pre a JOIN pre b ON b.i >= a.i),
iso AS (SELECT p.k, max(x.m) AS iso FROM pre p JOIN (SELECT p2.i AS at, b.i, min(b.m) AS m FROM pre p2 JOIN blocks b ON b.i <= p2.i AND b.j >= p2.i GROUP BY 1, 2) x ON x.at = p.i GROUP BY 1)"""


@query("m1_isotonic", f"WITH {GROWTH_SQL}, src AS (SELECT k, bar_g AS y, n AS w FROM head WHERE bar_g IS NOT NULL), {ISO_SQL} SELECT k, round(iso, 6) AS iso FROM iso")
def m1(spark, d):
    """Mean growth made monotone in rank, weighted by counts."""
    return isotone.monotone(head(spark, d), "bar_g", "n", []).select("k", *rounded("iso"))


def around_market(own):
    """Mean growth less the market's, which is its weighted mean over the ranks of a candidate, as y."""
    whole = Window.partitionBy("candidate")
    return own.where("bar_g is not null").withColumn("y", F.col("bar_g") - F.sum(F.col("bar_g") * F.col("n")).over(whole) / F.sum("n").over(whole))


@query(
    "m2_isotonic_penalty",
    f"""WITH {GROWTH_SQL}, raw AS (SELECT k, bar_g - (SELECT sum(bar_g * n) / sum(n) FROM head) AS y, CAST(n AS DOUBLE) AS w, min(k) OVER () AS a, max(k) OVER () AS b FROM head WHERE bar_g IS NOT NULL),
    src AS (SELECT k, w, y + CASE WHEN k = a AND a < b THEN 2.0 / (2 * w) WHEN k = b AND a < b THEN -2.0 / (2 * w) ELSE 0 END AS y FROM raw), {ISO_SQL} SELECT k, round(iso, 6) AS iso FROM iso""",
)
def m2(spark, d):
    """Monotone drifts around the market's growth, with a penalty on total variation."""
    return isotone.monotone(around_market(head(spark, d).withColumn("candidate", F.lit(0))), "y", "n", penalty=2.0).select("k", *rounded("iso"))


@query("m2_robust_isotonic")
def m2_robust(spark, d):
    """The same with Huber's loss, for heads of several sizes and several widths of the part that is squared."""
    sizes, widths = (50, 80), (0.1, 0.5, 1.0)
    own = keep(around_market(heads(spark, d, sizes)), "drifts")
    fits = [isotone.monotone(own, "y", "n", penalty=2.0, loss=pooling.Huber(width)).withColumn("width", F.lit(width)) for width in widths]
    return reduce(DataFrame.unionByName, fits).select(F.col("candidate").alias("k_max"), "width", "k", *rounded("iso"))


@query(
    "m2_needs_robust",
    f"WITH {GROWTH_SQL}, m AS (SELECT abs(h.bar_g - r.tilde_g) AS gap FROM head h JOIN rank_stats r USING (k)), c AS (SELECT median(gap) AS c FROM m), s AS (SELECT median(abs(gap - c)) AS mad FROM m, c) SELECT round(avg(CASE WHEN gap > 3 * mad THEN 1.0 ELSE 0.0 END), 6) AS far, avg(CASE WHEN gap > 3 * mad THEN 1.0 ELSE 0.0 END) > 0.25 AS robust FROM m, s",
)
def m2_needs_robust(spark, d):
    """Whether means and medians of growth differ so often that the robust loss is called for."""
    own = stats.rank_summary(week_growth(supplier_weeks(spark, d)), "rank_w", "g").where(F.col("k") <= SMALL.k_head)
    gaps = keep(own.select(F.abs(F.col("mean") - F.col("middle")).alias("gap")), "gaps")
    middle = gaps.agg(F.median("gap").alias("c"))  # of a row a rank
    spread = gaps.crossJoin(F.broadcast(middle)).agg(F.median(F.abs(F.col("gap") - F.col("c"))).alias("mad"))
    far = gaps.crossJoin(F.broadcast(spread)).agg(F.avg((F.col("gap") > 3 * F.col("mad")).cast("double")).alias("far"))
    return far.select(F.round("far", 6).alias("far"), (F.col("far") > 0.25).alias("robust"))


@query("m3_fused_drift")
def m3(spark, d):
    """Drifts of few levels, by a penalty on steps, and their monotone fit, for heads of several sizes and several penalties."""
    own = around_market(heads(spark, d, (30, 50, 80)))
    smooth = keep(isotone.fused(own, "y", "n", [0.01, 0.05, 0.2, 1.0]), "fused")
    weights = own.select("candidate", "k", "n")
    iso = isotone.monotone(smooth.join(weights, ["candidate", "k"]), "smooth", "n", ["candidate", "part"])
    return smooth.join(iso, ["candidate", "part", "k"]).select(F.col("candidate").alias("k_max"), "part", "k", *rounded("penalty", "smooth", "iso"))


@query("m5_combined_drift", f"WITH {GROWTH_SQL}, {SIGMA_SQL}, src AS (SELECT k, coalesce(bar_g, g) AS y, CASE WHEN bar_g IS NULL THEN 1.0 ELSE n END AS w FROM gap_g), {ISO_SQL} SELECT k, round(iso, 5) AS iso FROM iso")
def m5(spark, d):
    """Observed mean growth where there is any, gap drift elsewhere, made monotone."""
    own = gap_drift(spark, d).select("candidate", "k", F.coalesce("bar_g", "g").alias("y"), F.when(F.col("bar_g").isNull(), 1.0).otherwise(F.col("n")).alias("w"))
    return isotone.monotone(own, "y", "w").select("k", *rounded("iso", digits=5))


@query("m6_market_growth", f"WITH {GROWTH_SQL} SELECT round(sum(bar_g * n) / sum(n), 6) AS gamma_mean, round(median(bar_g), 6) AS gamma_median FROM head")
def m6(spark, d):
    return head(spark, d).agg(panels.rounded(F.sum(F.col("bar_g") * F.col("n")) / F.sum("n"), 6).alias("gamma_mean"), panels.rounded(F.median("bar_g"), 6).alias("gamma_median"))


@query("m13_expand_variance", f"WITH {GROWTH_SQL} SELECT k, round(coalesce(v, last_value(v IGNORE NULLS) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) AS v FROM (SELECT unnest(generate_series(1, 200)) AS k) LEFT JOIN (SELECT k, v FROM head) USING (k)")
def m13(spark, d):
    """Variances up to rank 200; the last one known goes on."""
    ranks = spark.range(1, 201).select(F.col("id").alias("k"), F.lit(0).alias("candidate"))
    order = Window.partitionBy("candidate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ranks.join(head(spark, d).select("k", "v"), "k", "left").select("k", panels.rounded(F.coalesce("v", F.last("v", ignorenulls=True).over(order)), 6).alias("v"))


@query("m14_tail_regression", f"WITH {GROWTH_SQL}, {SIGMA_SQL} SELECT round(-regr_slope(ln(-big_g), ln(k + 1)), 5) AS alpha, round(exp(regr_intercept(ln(-big_g), ln(k + 1))), 5) AS a, count(*) AS n FROM gap_g WHERE k >= 30 AND big_g < 0")
def m14(spark, d):
    """Power tail of the prefix drifts by regression on logs, from 0.6 of the head on."""
    own = gap_drift(spark, d).where("k >= 30 and big_g < 0").select(F.ln(-F.col("big_g")).alias("y"), F.ln(F.col("k") + 1).alias("x"))
    return own.agg(F.round(-F.regr_slope("y", "x"), 5).alias("alpha"), F.round(F.exp(F.regr_intercept("y", "x")), 5).alias("a"), F.count("*").alias("n"))


TAIL_FIELDS = "candidate int, k0 int, family string, a double, shape double, sse double"


def tails(own, starts, anchored: bool):
    """Fits of every family from every start rank; those without a negative drift there are left out."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k, g, w = pdf["k"].to_numpy(), pdf["g"].to_numpy(float), pdf["w"].to_numpy(float)
        rows = []
        for k0 in starts:
            for family in numeric.TAILS:
                try:
                    rows.append((int(pdf["candidate"].iloc[0]), k0, family, *numeric.fit_tail(k, g, w, k0, family, anchored)))
                except ValueError:
                    continue
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TAIL_FIELDS.split(", ")])

    return own.select("candidate", "k", "g", "w").groupBy("candidate").applyInPandas(fit, TAIL_FIELDS)


def lowered(own):
    """Monotone drifts of each candidate, lowered so that the last rank is below 0."""
    own = isotone.monotone(own.withColumn("w", F.lit(1.0)), "g", "w")
    return own.select("candidate", "k", (F.col("iso") - F.max("iso").over(Window.partitionBy("candidate")) - 0.01).alias("g"), F.lit(1.0).alias("w"))


def negative_head(spark, d, k_max=50):
    return lowered(gap_drift(spark, d, k_max))


def negative_heads(spark, d, sizes):
    return lowered(gap_drifts(spark, d, sizes))


@query("m14_tail_fits")
def m14_fits(spark, d):
    """Power and logarithmic tails, anchored at each start rank."""
    return tails(negative_head(spark, d), [5, 10, 25], True)


def held_out(own, starts):
    """(candidate, k0, family, loss): errors of every family from every start rank on blocks of ranks that its fits have not seen."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k, g, w = pdf["k"].to_numpy(), pdf["g"].to_numpy(float), pdf["w"].to_numpy(float)
        rows = []
        for family in numeric.TAILS:
            try:
                rows.append((int(pdf["candidate"].iloc[0]), int(pdf["k0"].iloc[0]), family, numeric.held_out_loss(k, g, w, int(pdf["k0"].iloc[0]), family)))
            except ValueError:
                continue
        return pd.DataFrame(rows, columns=["candidate", "k0", "family", "loss"])

    own = own.select("candidate", "k", "g", "w").withColumn("k0", F.explode(F.array(*map(F.lit, starts))))
    return own.groupBy("candidate", "k0").applyInPandas(fit, "candidate int, k0 int, family string, loss double")


@query("m15_tail_choice")
def m15(spark, d):
    """For each start rank, the family that predicts held-out blocks of ranks best; power wins ties."""
    order = Window.partitionBy("candidate", "k0").orderBy("loss", F.desc("family"))
    return held_out(negative_head(spark, d), [5, 10, 25]).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


@query("m24_tail_windows")
def m24(spark, d):
    """Tails fitted to heads of several sizes, each of which is a candidate."""
    return tails(negative_heads(spark, d, (50, 80)), [10], True).withColumnRenamed("candidate", "k_max")


SCHEDULE_SQL = f"""{GROWTH_SQL}, {SIGMA_SQL},
low AS (SELECT k, round(g - 0.02, 9) AS g, mhat, sigma2 FROM gap_g),
grid AS (SELECT n, unnest(generate_series(1, n)) AS k FROM (SELECT unnest([100, 200, 400]) AS n)),
filled AS (SELECT n, grid.k AS k, last_value(g IGNORE NULLS) OVER (PARTITION BY n ORDER BY grid.k ROWS UNBOUNDED PRECEDING) AS h FROM grid LEFT JOIN low ON low.k = grid.k),
tail AS (SELECT n, k, CASE WHEN k < 25 THEN h ELSE max(CASE WHEN k = 25 THEN h END) OVER (PARTITION BY n) * power(k / 25.0, -0.5) END AS g FROM filled),
sched AS (SELECT n, k, max(g) OVER (PARTITION BY n ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM tail)"""


def schedules(spark, d, own=None):
    """Schedules of three sizes from the gap drift."""
    own = (own or gap_drift(spark, d)).withColumn("g", F.round(F.col("g") - 0.02, 9))
    return model.schedule(own, [100, 200, 400], SMALL.k0, 0.5)


@query("m16_schedule", f"WITH {SCHEDULE_SQL} SELECT n, k, round(g, 5) AS g FROM sched")
def m16(spark, d):
    return schedules(spark, d).select("n", "k", *rounded("g", digits=5))


@query("w14_running_max", f"WITH {SCHEDULE_SQL} SELECT n, count(DISTINCT round(g, 5)) AS n_levels FROM sched GROUP BY 1")
def w14(spark, d):
    """How many levels a schedule has once it is monotone."""
    return schedules(spark, d).groupBy("n").agg(F.countDistinct(F.round("g", 5)).alias("n_levels"))


@query("a19_schedule_diagnostics", f"WITH {SCHEDULE_SQL}, p AS (SELECT n, k, g, sum(g) OVER (PARTITION BY n ORDER BY k ROWS UNBOUNDED PRECEDING) AS big_g FROM sched) SELECT n, round(sum(g), 4) AS sum_g, round(max(big_g), 4) AS max_prefix, round(min(g), 5) AS min_g, round(max(g), 5) AS max_g, round(min_by(g, k), 5) AS g_first, round(max_by(g, k), 5) AS g_last FROM p GROUP BY 1")
def a19(spark, d):
    """Sum, largest prefix sum, extremes and ends of each schedule."""
    own = schedules(spark, d).withColumn("big_g", F.sum("g").over(Window.partitionBy("candidate", "n").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("n").agg(
        F.round(F.sum("g"), 4).alias("sum_g"), F.round(F.max("big_g"), 4).alias("max_prefix"), F.round(F.min("g"), 5).alias("min_g"), F.round(F.max("g"), 5).alias("max_g"), F.round(F.min_by("g", "k"), 5).alias("g_first"), F.round(F.max_by("g", "k"), 5).alias("g_last")
    )


# every uplift of the fitted schedules, and the curves of those that come out
PLAIN_SQL = f"""{SCHEDULE_SQL},
ups AS (SELECT DISTINCT n, m FROM (SELECT n, unnest([5, 10, 20, 50, 100, greatest(5, n // 20), greatest(5, n // 10), n - 1]) AS m FROM (SELECT unnest([100, 200, 400]) AS n)) WHERE m < n),
up AS (SELECT n, m, k, g - CASE WHEN k > n - m THEN s / m ELSE 0 END AS g, s FROM (SELECT p.n, k, g, u.m, sum(g) OVER (PARTITION BY p.n, u.m) AS s FROM sched p JOIN ups u ON u.n = p.n)),
pre AS (SELECT *, sum(g) OVER (PARTITION BY n, m ORDER BY k ROWS UNBOUNDED PRECEDING) AS big_g FROM up),
ok AS (SELECT n, m, bool_and(s < 0 AND (k = n OR big_g < 0)) AS feasible FROM pre GROUP BY 1, 2),
rates AS (SELECT n, m, k, g, big_g, CASE WHEN k < n THEN -2 * big_g / (SELECT sigma2 FROM s2) END AS r FROM pre JOIN ok USING (n, m) WHERE feasible),
line AS (SELECT *, (SELECT round(mhat, 9) FROM head WHERE k = 1) - coalesce(sum(1 / r) OVER (PARTITION BY n, m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m_k FROM rates),
model AS (SELECT *, exp(m_k - max(m_k) OVER (PARTITION BY n, m)) / sum(exp(m_k)) OVER (PARTITION BY n, m) * exp(max(m_k) OVER (PARTITION BY n, m)) AS mce FROM line)"""


def plain_candidates(spark, d, own=None):
    """Every uplift of the schedules of the gap drift, with sigma2 and the first log share m1."""
    own = own or gap_drift(spark, d)
    scale = own.groupBy("candidate").agg(F.max("sigma2").alias("sigma2"), F.round(F.max(F.when(F.col("k") == 1, F.col("mhat"))), 9).alias("m1"))
    uplifts = model.uplift_sizes(F.col("n"), SMALL.uplift_grid, SMALL.uplift_least)
    return model.uplifted(schedules(spark, d, own), uplifts).join(F.broadcast(scale), "candidate")  # a row for each candidate


def plain_models(spark, d):
    return model.curves(plain_candidates(spark, d).where("feasible"), F.col("sigma2"), F.col("m1"))


@query("m17_stationarity", f"WITH {PLAIN_SQL} SELECT n, m, feasible FROM ok")
def m17(spark, d):
    """Which uplifts make a schedule stationary with negative prefix sums."""
    return plain_candidates(spark, d).select("n", "m", "feasible").distinct()


@query(
    "m17_least_shift",
    f"""WITH {SCHEDULE_SQL},
    p AS (SELECT n, n // 10 AS m, k, g, sum(g) OVER w AS s, sum(g) OVER (w ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS before, sum(g) OVER (w ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) / nullif(n - k, 0) AS after, max(abs(g)) OVER w AS most FROM sched WINDOW w AS (PARTITION BY n)),
    c AS (SELECT n, greatest(0, max(before) FILTER (k <= n - m), (max(s) - max(m) * min(after) FILTER (k > n - m AND k < n)) / max(n - m)) + 1e-10 * (1 + max(most)) AS c FROM p GROUP BY 1)
    SELECT n, m, k, round(g - c - CASE WHEN k > n - m THEN (s - n * c) / m ELSE 0 END, 5) AS g FROM p JOIN c USING (n)""",
)
def m17_shift(spark, d):
    """Schedules lowered by the least constant with which the sum may go to the last tenth of the ranks."""
    return model.shifted(schedules(spark, d), F.floor(F.col("n") / 10).cast("int")).select("n", "m", "k", *rounded("g", digits=5))


@query("m17_variants")
def m17_variants(spark, d):
    """Every way of making a schedule stationary, and whether it came out."""
    own, tenth = schedules(spark, d), F.floor(F.col("n") / 10).cast("int")
    summed = lambda df, variant: df.groupBy("n").agg(F.lit(variant).alias("variant"), F.bool_and("feasible").alias("ok"), F.sum("g").alias("sum_g"), F.max(F.when(F.col("k") < F.col("n"), F.col("big_g"))).alias("max_prefix"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g, n = pdf.sort_values("k")["g"].to_numpy(float), int(pdf["n"].iloc[0])
        out, ok = numeric.stationary(g, "tail", n // 10, SMALL.protect)
        return pd.DataFrame([(n, "tail", ok, float(out.sum()), float(np.cumsum(out)[:-1].max()))], columns=["n", "variant", "ok", "sum_g", "max_prefix"])

    tail = own.groupBy("n").applyInPandas(fit, "n int, variant string, ok boolean, sum_g double, max_prefix double")
    return summed(model.uplifted(own, F.array(tenth)), "uplift").unionByName(summed(model.shifted(own, tenth), "shift")).unionByName(tail)


@query("m18_gap_rates", f"WITH {PLAIN_SQL} SELECT n, m, k, round(r, 5) AS r, round(m_k, 5) AS m_k FROM model")
def m18(spark, d):
    return plain_models(spark, d).select("n", "m", "k", *rounded("r", "m_k", digits=5))


@query("m19_curve_weights", f"WITH {PLAIN_SQL} SELECT n, m, k, round(mce, 8) AS mce FROM model")
def m19(spark, d):
    return plain_models(spark, d).select("n", "m", "k", *rounded("mce", digits=8))


@query("w11_prefix_sums", f"WITH {PLAIN_SQL} SELECT n, m, k, round(big_g, 4) AS big_g FROM pre WHERE k < n")
def w11(spark, d):
    return plain_candidates(spark, d).where("k < n").select("n", "m", "k", *rounded("big_g", digits=4))


@query("w12_reverse_sums", f"WITH {PLAIN_SQL} SELECT n, m, k, round(sum(1 / r) OVER (PARTITION BY n, m ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS rest FROM rates WHERE k < n")
def w12(spark, d):
    """What is left of the curve's fall from each rank on."""
    rest = Window.partitionBy("n", "m").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    return plain_models(spark, d).where("k < n").select("n", "m", "k", F.round(F.sum("rho").over(rest), 5).alias("rest"))


@query("w13_curve_recursion", f"WITH {PLAIN_SQL} SELECT n, m, round(min(m_k), 4) AS lowest, round(max(m_k), 4) AS highest FROM model GROUP BY 1, 2")
def w13(spark, d):
    return plain_models(spark, d).groupBy("n", "m").agg(F.round(F.min("m_k"), 4).alias("lowest"), F.round(F.max("m_k"), 4).alias("highest"))


FIT_SQL = f"{PLAIN_SQL}, top AS (SELECT avg(s) AS top_share FROM (SELECT sum(weekly_share) FILTER (rank_w <= 50) AS s FROM weekly GROUP BY week_start)), fit AS (SELECT n, m, sqrt(avg((m_k - h.mhat) * (m_k - h.mhat))) AS rmse, sum(mce) AS modelled FROM model JOIN (SELECT k, mhat FROM head) h USING (k) WHERE k <= 50 GROUP BY 1, 2)"


def plain_scores(spark, d):
    own = gap_drift(spark, d)
    models = model.curves(plain_candidates(spark, d, own).where("feasible"), F.col("sigma2"), F.col("m1"))
    return model.scores(models, own, stats.share_of_top(own, SMALL.k_head), SMALL.k_head, SMALL.lambda_share)


@query("m20_scores", f"WITH {FIT_SQL} SELECT n, m, round(rmse, 5) AS rmse, round(abs(modelled - top_share), 6) AS share_gap, round(rmse + abs(modelled - top_share), 5) AS score FROM fit, top")
def m20(spark, d):
    return plain_scores(spark, d).select("n", "m", *rounded("rmse", digits=5), *rounded("share_gap"), *rounded("score", digits=5))


@query("t4_best_candidates", f"WITH {FIT_SQL} SELECT n, m, round(rmse + abs(modelled - top_share), 5) AS score FROM fit, top ORDER BY rmse + abs(modelled - top_share), n, m LIMIT 5")
def t4(spark, d):
    """The five candidates with the least score."""
    return plain_scores(spark, d).orderBy("score", "n", "m").limit(5).select("n", "m", *rounded("score", digits=5))


@query(
    "j20_parameter_grid",
    f"WITH {SUPPLIERS}, f AS (SELECT CAST(floor(median(c)) AS INTEGER) AS k_full FROM (SELECT count(*) AS c FROM weekly GROUP BY week_start)), s AS (SELECT k_full * unnest([2, 4, 8]) AS n FROM f) SELECT DISTINCT n, m FROM (SELECT n, unnest([5, 10, 20, 50, 100, greatest(5, n // 20), greatest(5, n // 10), n - 1]) AS m FROM s) WHERE m < n",
)
def j20(spark, d):
    """Sizes of two, four and eight times the endpoints of a median week, each with its uplifts."""
    weeks = supplier_sums(spark, d).groupBy("week_start").agg(F.count("*").alias("c"))  # a row for each week
    sizes = weeks.agg(F.floor(F.median("c")).cast("int").alias("k_full")).select(F.explode(F.array(*[F.col("k_full") * times for times in (2, 4, 8)])).alias("n"))
    return sizes.withColumn("m", F.explode(model.uplift_sizes(F.col("n"), SMALL.uplift_grid, SMALL.uplift_least))).where("m < n")


@query("m40_acceptance", f"WITH {PLAIN_SQL}, c AS (SELECT n, m, bool_and(coalesce(r > 0, true)) AS rates_positive, abs(sum(mce) - 1) < 1e-8 AS sums_to_one, bool_and(coalesce(m_k > nx, true)) AS falling FROM (SELECT *, lead(m_k) OVER (PARTITION BY n, m ORDER BY k) AS nx FROM model) GROUP BY 1, 2) SELECT * FROM c")
def m40(spark, d):
    """Checks of each model: positive rates, weights that sum to 1, a falling curve."""
    own = plain_models(spark, d).withColumn("_next", F.lead("m_k").over(Window.partitionBy("n", "m").orderBy("k")))
    return own.groupBy("n", "m").agg(F.bool_and(F.coalesce(F.col("r") > 0, F.lit(True))).alias("rates_positive"), (F.abs(F.sum("mce") - 1) < 1e-8).alias("sums_to_one"), F.bool_and(F.coalesce(F.col("m_k") > F.col("_next"), F.lit(True))).alias("falling"))


def fitted(own, sizes=(100, 200, 400)):
    """Models of all sizes and uplifts from each candidate's own drift, variance and first log share."""
    grid = model.uplifted(model.schedule(lowered(own), sizes, SMALL.k0, 0.5), model.uplift_sizes(F.col("n"), SMALL.uplift_grid, SMALL.uplift_least)).where("feasible")
    scale = own.groupBy("candidate").agg(F.max("sigma2").alias("sigma2"), F.max(F.when(F.col("k") == 1, F.col("mhat"))).alias("m1"))
    return model.curves(grid.join(F.broadcast(scale), "candidate"), F.col("sigma2"), F.col("m1"))


# the same chain from the monotone gap drift, lowered below 0
FITTED_SQL = PLAIN_SQL.replace("low AS (SELECT k, round(g - 0.02, 9) AS g, mhat, sigma2 FROM gap_g)", f"src AS (SELECT k, g AS y, 1.0 AS w FROM gap_g), {ISO_SQL.strip().replace("pre AS", "ranked AS").replace("FROM pre", "FROM ranked").replace("JOIN pre", "JOIN ranked")}, low AS (SELECT k, iso - max(iso) OVER () - 0.01 AS g FROM iso)").replace("round(mhat, 9)", "mhat")
FITTED_FIT_SQL = FIT_SQL.replace(PLAIN_SQL, FITTED_SQL)


@query(
    "m21_selection_grid",
    f"WITH {FITTED_FIT_SQL}, s AS (SELECT n, m, rmse, abs(modelled - top_share) AS share_gap, rmse + abs(modelled - top_share) AS score FROM fit, top) SELECT n, m, round(rmse, 5) AS rmse, round(share_gap, 6) AS share_gap, round(score, 5) AS score, CAST(row_number() OVER (ORDER BY round(score, 9), n, m) AS INTEGER) AS place FROM s",
)
def m21(spark, d):
    """All feasible sizes and uplifts with their scores, best first; ranked from 1."""
    own = gap_drift(spark, d)
    out = model.scores(fitted(own), own, stats.share_of_top(own, SMALL.k_head), SMALL.k_head)
    place = F.row_number().over(Window.partitionBy("candidate").orderBy(F.round("score", 9), "n", "m"))
    return out.withColumn("place", place).select("n", "m", *rounded("rmse", digits=5), *rounded("share_gap"), *rounded("score", digits=5), "place")


@query("m22_first_feasible_curve", f"WITH {FITTED_SQL} SELECT n, m, k, round(m_k, 5) AS m_k, round(mce, 8) AS mce FROM model JOIN (SELECT n, min(m) AS m FROM model GROUP BY 1) f USING (n, m)")
def m22(spark, d):
    """The curve of each size with its least feasible uplift."""
    return model.first_feasible(fitted(gap_drift(spark, d))).select("n", "m", "k", *rounded("m_k", digits=5), *rounded("mce", digits=8))


@query("m23_head_sensitivity")
def m23(spark, d):
    """Best score for heads of several sizes, each refitted; all sizes come from one rank table and run side by side."""
    own = gap_drifts(spark, d, (30, 50, 70))
    models = fitted(own, (100, 200))
    met = models.where("k <= candidate").join(own.select("candidate", "k", "mhat"), ["candidate", "k"])
    fit = met.groupBy("candidate", "n", "m").agg(F.sqrt(F.avg((F.col("m_k") - F.col("mhat")) ** 2)).alias("rmse"), F.sum("mce").alias("modelled_share"))
    top = own.groupBy("candidate").agg((F.sum("value_sum") / F.max(F.when(F.col("k") == 1, F.col("periods")))).alias("top_share"))
    out = fit.join(F.broadcast(top), "candidate").withColumn("score", F.col("rmse") + F.abs(F.col("modelled_share") - F.col("top_share")))  # a row for each head size
    return out.groupBy(F.col("candidate").alias("k_max")).agg(F.min("score").alias("score"), F.min_by("n", "score").alias("n"), F.min_by("m", "score").alias("m"))


@query("m25_robust_refit")
def m25(spark, d):
    """Mean growth by Huber's estimator, where the plain one and the gap drift differ by much on average."""
    own = gap_drift(spark, d)
    growth = pairs.growth_pairs(supplier_weeks(spark, d), "week_start", "weekly_share", "rank_w", [1], 7).where("rank_w <= 50").select(F.col("rank_w").alias("k"), "g")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "robust_g": [numeric.huber_mean(pdf["g"].to_numpy())]})

    robust = growth.groupBy("k").applyInPandas(fit, "k int, robust_g double")
    gap = own.agg(F.avg(F.abs(F.col("bar_g") - F.col("g"))).alias("mean_gap"))
    return own.select("k", "bar_g", "g").join(robust, "k").crossJoin(F.broadcast(gap)).select("k", F.when(F.col("mean_gap") > 0.05, F.col("robust_g")).otherwise(F.col("bar_g")).alias("drift"), "mean_gap")


@query(
    "m26_simple_curve",
    f"""WITH {GROWTH_SQL}, {SIGMA_SQL}, src AS (SELECT k, bar_g - (SELECT median(bar_g) FROM head) AS y, n AS w FROM head WHERE bar_g IS NOT NULL), {ISO_SQL},
    full_g AS (SELECT k, 400 AS n, 50 AS m, last_value(iso IGNORE NULLS) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT unnest(generate_series(1, 400)) AS k) LEFT JOIN iso USING (k)),
    p AS (SELECT *, sum(g) OVER () AS s, sum(g) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS before, sum(g) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) / nullif(n - k, 0) AS after, max(abs(g)) OVER () AS most FROM full_g),
    c AS (SELECT greatest(0, max(before) FILTER (k <= n - m), (max(s) - max(m) * min(after) FILTER (k > n - m AND k < n)) / max(n - m)) + 1e-10 * (1 + max(most)) AS c FROM p),
    q AS (SELECT k, n, g - c - CASE WHEN k > n - m THEN (s - n * c) / m ELSE 0 END AS g FROM p, c),
    r AS (SELECT k, CASE WHEN k < n THEN -2 * sum(g) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / (SELECT sigma2 FROM s2) END AS r FROM q)
    SELECT k, r > 0 AS falls FROM r WHERE k < 400""",
)
def m26(spark, d):
    """Ranks at which the curve of a model made in one go falls: monotone drift, the last drift up to 400 ranks, least shift."""
    return simple_curve(spark, d).where("k < n").select("k", (F.col("r") > 0).alias("falls"))


def simple_curve(spark, d, n=400, m=50):
    own = with_sigma(head(spark, d)).where("bar_g is not null")
    middle = own.groupBy("candidate").agg(F.median("bar_g").alias("middle"), F.first("sigma2").alias("sigma2"))
    iso = isotone.monotone(own.join(middle.drop("sigma2"), "candidate").withColumn("y", F.col("bar_g") - F.col("middle")), "y", "n").withColumnRenamed("iso", "g")
    full = model.held(iso, n)
    return model.curves(model.shifted(full, F.lit(m)).join(middle, "candidate"), F.col("sigma2"), F.lit(0.0))


@query("m26_curve")
def m26_curve(spark, d):
    """That model's log curve and weights."""
    return simple_curve(spark, d).select("k", "m_k", "mce", F.col("feasible").alias("ok"))


def splined(own, x, y, parts):
    """own (candidate, k, ..) with the smoothing spline of y over x, through what parts makes of it; a candidate is a task."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return parts(pdf[["candidate", "k"]].reset_index(drop=True), smoothing_spline(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)))

    return lambda schema: own.select("candidate", "k", x.cast("double").alias("x"), y.cast("double").alias("y")).groupBy("candidate").applyInPandas(fit, schema)


def smooth_variance(own):
    """(candidate, k, smooth_v, freedom): variances by rank, smoothed by a spline whose strength is cross-validated."""
    parts = lambda ranks, f: ranks.assign(smooth_v=np.maximum(f.value, 1e-10), freedom=f.freedom)
    return splined(own.where("v is not null"), F.col("k"), F.greatest("v", F.lit(1e-10)), parts)("candidate int, k int, smooth_v double, freedom double")


@query("m11_smooth_variance")
def m11(spark, d):
    """Variance by rank, smoothed, for heads of several sizes."""
    return smooth_variance(heads(spark, d, (50, 100, 10_000))).withColumnRenamed("candidate", "k_max")


@query("m12_piecewise_variance")
def m12(spark, d):
    """Smooth variance at the top and in the tail, the trimmed mean in between, for heads of several sizes."""
    own = with_sigma(heads(spark, d, (50, 100, 10_000))).select("candidate", "k", "sigma2", "v")
    body = F.col("k").between(20, 60)
    return own.join(smooth_variance(own), ["candidate", "k"]).select(F.col("candidate").alias("k_max"), "k", F.when(body, F.col("sigma2")).otherwise(F.col("smooth_v")).alias("sigma2"), body.alias("in_body"))


@query("m30_slope_and_curvature")
def m30(spark, d):
    """Slope and curvature of the mean log share in log rank, from its smoothing spline: their signs, Kendall's tau of the slope, and quantiles of it, for several numbers of ranks."""
    parts = lambda ranks, f: ranks.assign(x=f.x, slope=f.slope(), bend=f.second)
    fits = splined(heads(spark, d, (50, 100, 10_000)), F.ln("k"), F.col("mhat"), parts)("candidate int, k int, x double, slope double, bend double")

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"candidate": pdf["candidate"].head(1), "tau": [numeric.kendall(pdf["x"].to_numpy(), pdf["slope"].to_numpy())]})

    sums = fits.groupBy("candidate").agg(
        F.avg((F.col("slope") < 0).cast("double")).alias("falling"), F.avg((F.col("bend") < 0).cast("double")).alias("bent_down"), *[F.percentile("slope", p / 100).alias(f"q{p}") for p in (10, 50, 90)]
    )
    return sums.join(fits.groupBy("candidate").applyInPandas(tau, "candidate int, tau double"), "candidate").withColumnRenamed("candidate", "k_max")


@query("m37_simulation")
def m37(spark, d):
    """Paths of the first day's shares by rank: geometric steps with the drift line's kappa and eta and the funnel's sigma, then made to sum to 1. Day 0 is the start."""
    daily, config = user_days(spark, d), EngineConfig()
    first = daily.join(F.broadcast(daily.agg(F.min("date").alias("date"))), "date").groupBy("rank").agg(F.avg("share").alias("w"))
    start = first.agg(F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("w"))  # a list of one day's ranks
    line = pairs.growth_pairs(daily, "date", "share", "rank", [1]).agg(F.regr_intercept("g", "rank").alias("kappa"), (-F.regr_slope("g", "rank")).alias("eta"))
    sigma = first_rank_line(spark, d).select(F.sqrt(F.greatest("slope", F.lit(1e-12))).alias("sigma"))
    given = start.crossJoin(line).crossJoin(sigma)
    ids = spark.range(config.simulation_paths, numPartitions=max(1, config.simulation_paths // 4))
    paths = ids.crossJoin(F.broadcast(given)).select(F.col("id").alias("path"), F.transform("w", lambda x: x["rank"]).alias("rank"), F.transform("w", lambda x: x["w"]).alias("w"), "kappa", "eta", "sigma")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, rank, w, kappa, eta, sigma in zip(*(frame[c] for c in frame.columns), strict=True):
                r = np.random.default_rng(np.random.SeedSequence([config.seed, path]))
                rank, w = np.asarray(rank, int), np.maximum(np.asarray(w, float), 1e-12)
                w, drift, vol = w / w.sum(), kappa - eta * rank, sigma * np.sqrt(np.log(rank))
                for first in range(0, config.simulation_days, 32):  # a rank's days lie side by side, which files hold in less room than a day's ranks
                    block, days = [], np.arange(first, min(first + 32, config.simulation_days))
                    for day in days:
                        if day:
                            w = np.maximum(w * np.exp(drift + vol * r.standard_normal(len(w))), 1e-12)
                            w /= w.sum()
                        block.append(w)
                    for at in range(0, len(w), 16384):
                        own = rank[at : at + 16384]
                        share = np.stack([x[at : at + 16384] for x in block], axis=1).ravel()
                        yield pd.DataFrame({"path": path, "day": np.tile(days, len(own)), "rank": np.repeat(own, len(days)), "share": share})

    return paths.mapInPandas(run, "path long, day int, rank int, share double")


@query("m39_block_bootstrap")
def m39(spark, d):
    """Bands of the log curve by rank and of the modelled share of the top ranks, over refits on blocks of weeks drawn with replacement."""
    weekly = supplier_weeks(spark, d).where(F.col("rank_w") <= SMALL.k_head)  # a growth counts where both weeks are in the head
    own = pairs.growth_pairs(weekly, "week_start", "weekly_share", "rank_w", [1], 7, "left")
    own = keep(own.select("week_start", F.col("rank_w").alias("k"), "g", F.ln("weekly_share").alias("log_share")), "head")
    draws = bootstrap.drawn(own, "week_start", EngineConfig().bootstrap_replicates, SMALL.bootstrap_block, SMALL.seed)
    return bootstrap.bands(bootstrap.curves(own, own, draws, "week_start"), [10])
