"""Hand-made edge cases of panels, pairs, churn and sources."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderlens.operators import churn, pairs, panels, stats
from ladderlens.sources import readers, sinks
from ladderlens.streaming import weekly as weekly_stream

DAY = dt.date(2024, 1, 1)


def week(n):
    return DAY + dt.timedelta(days=7 * n)


def panel(spark, rows):
    return spark.createDataFrame(rows, "week_start date, endpoint_id string, weekly_metric double")


def test_four_ranks_of_ties(spark):
    df = panel(spark, [(DAY, x, v) for x, v in zip("abcde", (10.0, 10.0, 5.0, 5.0, 1.0), strict=True)])
    of = lambda out: [r["r"] for r in out.orderBy("endpoint_id").collect()]
    args = (df, "week_start", "weekly_metric", "r")
    assert of(panels.ranked(*args, "dense_rank")) == [1, 1, 2, 2, 3]
    assert of(panels.ranked(*args, "rank")) == [1, 1, 3, 3, 5]
    assert of(panels.ranked(*args, ties=[F.col("endpoint_id")])) == [1, 2, 3, 4, 5]


def test_ties_go_to_who_led_the_week_before(spark):
    df = panel(spark, [(week(0), "c", 1.0), (week(0), "d", 2.0), (week(1), "c", 5.0), (week(1), "d", 5.0), (week(1), "a", 5.0)])
    got = {r["endpoint_id"]: r["r"] for r in panels.previous_rank(df, "week_start", "weekly_metric", "r").where(F.col("week_start") == week(1)).collect()}
    assert got == {"d": 1, "c": 2, "a": 3}


def test_sliced_ranks_equal_windows_over_whole_periods(spark):
    x = F.when(F.col("id") % 50 == 0, 0.0).when(F.col("id") % 51 == 0, None).when(F.col("id") % 53 == 0, float("nan")).when(F.col("id") % 3 == 0, F.pmod("id", F.lit(4)).cast("double")).otherwise(F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0 - 20)
    df = spark.range(3000).select(F.expr("date '2024-01-01' + cast(id % 2 as int)").alias("p"), F.col("id").cast("string").alias("endpoint_id"), x.alias("x"))
    ties = [F.col("endpoint_id")]
    for kind in ("row_number", "rank", "dense_rank"):
        order = Window.partitionBy("p").orderBy(F.desc("x"), *(ties if kind == "row_number" else ()))
        want = df.select("endpoint_id", getattr(F, kind)().over(order).alias("r"))
        got = panels.ranked(df, "p", "x", "r", kind, ties).select("endpoint_id", "r")
        assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_ranks_around_the_largest_whole_number_that_is_a_part_of_its_own(spark):
    values = [4300.0, 4250.5, 4096.01, 4096.0, 4096.0, 4095.99, 4095.0, 0.5, 0.0, -4095.5, -4096.0, -4096.01, -4250.5]
    df = panel(spark, [(DAY, f"{i:02d}", v) for i, v in enumerate(values)])
    of = lambda out: [r["r"] for r in out.orderBy("endpoint_id").collect()]
    args = (df, "week_start", "weekly_metric", "r")
    assert of(panels.ranked(*args, ties=[F.col("endpoint_id")])) == list(range(1, 14))
    assert of(panels.ranked(*args, "rank")) == [1, 2, 3, 4, 4, *range(6, 14)]
    assert of(panels.panel(df, ("week_start", "weekly_metric", "t", "s", "r"))) == list(range(1, 14))


def test_sums_at_half_a_cent_are_rounded_as_sql_does_and_in_any_order(spark):
    import math
    import random

    import duckdb

    r = random.Random(3)
    groups = [[1.005], [8.345], [-1.005], [0.1, 0.905], [4350.675, 1.33]]
    groups += [[r.randrange(10**7) / 1000 for _ in range(n)] for n in (3, 5, 40) for _ in range(300)]
    groups += [[7.0, float("inf")], [float("nan"), 1.0], [2.0**60, 2.0**38, 0.125], [None, 2.5], [None]]
    rows = [(g, i, x) for g, xs in enumerate(groups) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    sums = lambda out: {x["g"]: x["s"] for x in out.groupBy("g").agg(panels.rounded_sum(out, "x").alias("s")).collect()}
    got, turned = sums(df.coalesce(1).sortWithinPartitions("i")), sums(df.repartition(7, "i", "x").sortWithinPartitions("x"))
    assert all(repr(got[g]) == repr(turned[g]) for g in range(len(groups)))
    con = duckdb.connect()
    for g, xs in enumerate(groups):
        exact = None if xs == [None] else sum(x for x in xs if x is not None) if any(x is None or not math.isfinite(x) for x in xs) else math.fsum(xs)
        (want,) = con.execute("SELECT round(?::DOUBLE, 2)", [exact]).fetchone()
        assert got[g] == want or math.isnan(got[g]) and math.isnan(want), (xs, got[g], want)
    whole = spark.createDataFrame([(1, 2), (1, 5)], "g int, x long")
    assert whole.groupBy("g").agg(panels.rounded_sum(whole, "x").alias("s")).schema["s"].dataType.typeName() == "long"


def test_what_is_rounded_to_nothing_keeps_its_sign_as_in_sql(spark):
    import random

    import duckdb

    from ladderlens.plans.inputs import rounded

    r = random.Random(4)
    xs = [-1e-7, 1e-7, -0.0, 0.0, -4.9e-7, -5e-7, 0.49999999999999994e-6, 1.0000005, -2.0000025, 12345.0000005, -1e305, 1e305, float("inf"), float("-inf"), float("nan"), None]
    xs += [r.uniform(-2, 2) for _ in range(300)] + [r.randrange(-(10**9), 10**9) / 2**20 for _ in range(300)] + [(2 * r.randrange(10**8) + 1) / 2e6 for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, g double").select("i", *rounded("g"))
    assert df.schema["g"].dataType.typeName() == "double"
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs]
    assert [repr(x["g"]) for x in df.orderBy("i").collect()] == list(map(repr, want))


def test_growth_that_is_rounded_to_nothing_keeps_its_sign(spark, tmp_path):
    import duckdb

    from ladderlens import catalog

    rows = [(s, dt.datetime.combine(week(w), dt.time()), 50000.0 if s or w != 1 else 49999.99) for w in range(3) for s in range(200)]
    lines = spark.createDataFrame([(s, s, t, x) for s, t, x in rows], "l_suppkey long, l_partkey long, l_shipdate timestamp, l_extendedprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("j11_next_kept_week", "p5_winsorize_by_rank", "flagship_growth_by_rank"):
        got = sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())))
        want = sorted(map(repr, con.execute(catalog.ORACLE[name]).fetchall()))
        assert got == want
        assert any("-0.0" in row for row in want)


def against_sql(spark, folder, name, rows):
    """Rows of a query and of its SQL as sorted text, on a lineitem of (supplier, date, price)."""
    import duckdb

    from ladderlens import catalog

    lines = spark.createDataFrame([(s, s, dt.datetime.combine(d, dt.time()), x) for s, d, x in rows], "l_suppkey long, l_partkey long, l_shipdate timestamp, l_extendedprice double")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, str(folder)).select([c[0] for c in want.description]).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want.fetchall()))


def half_shares():
    """A week's prices that add up to 10^8, most of whose shares have a 5 after the ninth digit."""
    own = [(s, week(0), (2 * s + 1) * 7 / 20) for s in range(1500)]
    return [*own, (9999, week(0), round(1e8 - sum(x for _, _, x in own), 2))]


def test_shares_of_a_weekly_panel_are_rounded_as_sql_does(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "a2_weekly_panel", half_shares())
    assert got == want and len(got) == 1501


def test_panel_totals_are_exact_in_any_order(spark):
    for parts in (1, 7):
        df = spark.range(200_000, numPartitions=parts).select(F.lit(DAY).alias("p"), F.col("id").cast("string").alias("endpoint_id"), F.lit(500000.01).alias("x"))
        assert panels.panel(df, ("p", "x", "t", "s", "r")).agg(F.collect_set("t")).first()[0] == [100000002000.0]


def test_shares_of_the_long_form_are_rounded_as_sql_does(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "s10_standardize_long", half_shares())
    assert got == want and len(got) == 1501


def test_previous_ranks_around_a_sum_of_4096_are_those_of_sql(spark, tmp_path):
    prices = [4300.0, 4250.5, 4096.01, 4096.0, 4096.0, 4095.99, 4095.0, 64.0]
    rows = [(s, week(w), x) for w in range(3) for s, x in enumerate(prices[w:] + prices[:w])]
    got, want = against_sql(spark, tmp_path, "j13_previous_week_rank", rows)
    assert got == want and len(got) == 24


def test_weekly_sums_at_half_a_cent_and_at_4096_are_coerced_as_in_sql(spark, tmp_path):
    rows = [(s, week(0), (2 * s + 1) / 200 + d) for s in range(400) for d in (0.0, 1000.13)]  # two of a supplier: their order doesn't matter
    rows += [(1000 + s, week(0), x) for s, x in enumerate([4100.0, 4096.0, 4096.0, 4250.5, 4095.99])]
    rows += [(2000 + s, week(0), 1.005 + s) for s in range(100)]
    got, want = against_sql(spark, tmp_path, "p2_coerce_weekly", rows)
    assert got == want and len(got) == 505


def test_panel_totals_and_ranks(spark):
    df = spark.range(500).select(F.lit(DAY).alias("p"), F.col("id").cast("string").alias("endpoint_id"), F.pmod(F.xxhash64("id"), F.lit(30)).cast("double").alias("x"))
    got = panels.panel(df, ("p", "x", "t", "s", "r"))
    order = Window.partitionBy("p").orderBy(F.desc("x"), "endpoint_id")
    want = df.withColumn("t", F.sum("x").over(Window.partitionBy("p"))).withColumn("s", F.col("x") / F.col("t")).withColumn("r", F.row_number().over(order))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 500


def test_gaps_across_blocks_of_ranks(spark):
    df = spark.range(1, 40).where("id <> 20").select(F.lit(DAY).alias("p"), F.exp(-F.col("id") / 1.0).alias("v"), F.col("id").cast("int").alias("r"))
    got = {r["r"]: round(r["gap"], 9) for r in pairs.rank_gaps(df, "p", "v", "r", block=5).collect()}
    assert got == {k: 1.0 for k in range(1, 39) if k not in (19, 20)}


def test_top_of_a_period_by_parts(spark):
    df = spark.range(300).select(F.lit(DAY).alias("p"), F.col("id").cast("string").alias("endpoint_id"), (F.col("id") % 7).alias("x"))
    got = sorted((r["x"], r["endpoint_id"], r["rank"]) for r in panels.top_n(df, "p", "x", 50, [F.col("endpoint_id")], salts=5).collect())
    want = sorted([(i % 7, str(i)) for i in range(300)], key=lambda v: (-v[0], v[1]))[:50]
    assert got == sorted((x, i, 7 - x) for x, i in want)


def test_positive_drops_zeros_nulls_and_nan(spark):
    df = panel(spark, [(DAY, "a", 0.0), (DAY, "b", None), (DAY, "c", float("nan")), (DAY, None, 1.0), (DAY, "d", 1.0), (DAY, "e", float("inf"))])
    assert [r["endpoint_id"] for r in panels.positive(df, "weekly_metric", ["week_start", "endpoint_id"]).collect()] == ["d"]


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),)], "d date")
    assert [str(r[0]) for r in df.orderBy("d").select(panels.week_of("d")).collect()] == ["2024-01-01", "2024-01-08"]


def test_head_must_be_whole(spark):
    rows = [(week(0), k) for k in (1, 2, 4)] + [(week(1), k) for k in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "week_start date, rank_w int")
    assert [r[0] for r in panels.full_head_periods(df, "week_start", "rank_w", 4).collect()] == [week(1)]


def test_three_meanings_of_next(spark):
    rows = [(week(n), "a", 1.0 + n) for n in (1, 2, 4)] + [(week(n), "b", 1.0 + n) for n in (1, 2, 3, 4)]
    df = panels.ranked(panel(spark, rows), "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")])
    n = lambda out: out.where("endpoint_id = 'a'").count()
    assert n(pairs.growth_pairs(df, "week_start", "weekly_metric", "rank_w", [1], 7)) == 1
    assert n(pairs.lead_pairs(df, "week_start", "weekly_metric")) == 2
    assert n(pairs.lead_pairs(df, "week_start", "weekly_metric", 7)) == 1
    assert n(pairs.ordinal_pairs(df, "week_start", "weekly_metric")) == 1
    kept = df.where(F.col("week_start") != week(3))
    assert n(pairs.ordinal_pairs(kept, "week_start", "weekly_metric")) == 2


def test_leakage_and_bounds(spark):
    rows = [(week(0), x, float(v)) for v, x in enumerate("abcdefghijkl", 1)] + [(week(1), x, float(v)) for v, x in enumerate("abcdef", 1)]
    df = panels.ranked(panel(spark, rows), "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")]).withColumn("one", F.lit(1))
    leak = pairs.leakage(df, "week_start", "weekly_metric", "one", [1], 7)
    assert leak.first()["leakage"] == 0.5
    own = pairs.growth_pairs(df, "week_start", "weekly_metric", "one", [1], 7)
    got = pairs.lee_bounds(own, ["one"], "g", leak, [0.25, 0.5, 0.75], least=1).collect()
    assert len(got) == 3 and all(r["q_lb"] <= r["q_obs"] <= r["q_ub"] for r in got)
    gone = leak.withColumn("leakage", F.lit(1.0))
    assert all(r["q_lb"] is None and r["q_obs"] is not None for r in pairs.lee_bounds(own, ["one"], "g", gone, [0.5], least=1).collect())


def test_leakage_of_unique_ranks_groups_once(spark):
    rows = [(week(n), x, float(v + n)) for n in range(6) for v, x in enumerate("abcdef", 1) if (n * v) % 5 != 3]
    df = panels.ranked(panel(spark, rows), "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")])
    own, starts = pairs.growth_pairs(df, "week_start", "weekly_metric", "rank_w", [1, 2], 7, "left"), pairs.observed_starts(df, "week_start", [1, 2], 7)
    one, two = (pairs.leakage_of(own, starts, "week_start", "rank_w", unique) for unique in (True, False))
    assert sorted(one.collect()) == sorted(two.collect()) and 0 < one.agg(F.avg("leakage")).first()[0] < 1
    assert "week_start" not in one._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")[0]  # no group of a period and a rank


def test_filled_over_blocks(spark):
    values = [None, None, None, 1.0, None, None, None, None, None, 2.0, 3.0, None, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values, 1) if k != 8], "k int, y double")
    want = {k: v for k, v in enumerate([1.0] * 9 + [2.0, 3.0, 3.0, 3.0], 1) if k != 8}
    for block in (1, 2, 3, 100):
        out = panels.filled(df, "k", "y", block)
        assert {r["k"]: r["y"] for r in out.collect()} == want and out.columns == ["k", "y"]
    assert {r["y"] for r in panels.filled(df.withColumn("y", F.lit(None).cast("double")), "k", "y", 2).collect()} == {None}


def test_new_and_returning(spark):
    rows = [(week(n), "always", 1.0) for n in range(20)] + [(week(n), "a", 1.0) for n in (0, 4, 17)]
    got = {r["week_idx"]: (r["n"], r["new_ever"], r["back_4"], r["back_12"]) for r in churn.new_and_returning(panel(spark, rows), "week_start").collect()}
    assert got[5] == (2, 0, 1, 0) and got[18] == (2, 0, 1, 1) and 4 not in got


def test_captures_are_an_interval_join(spark):
    rows = [(week(n), x, v) for n in range(3) for x, v in (("a", 3.0), ("b", 1.0))]
    df = panels.ranked(panels.shares(panel(spark, rows), "week_start", "weekly_metric", "weekly_total", "weekly_share"), "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")])
    got = {(r["start_idx"], r["r"]): (r["captured"], r["ratio"]) for r in churn.captures(df, [1], [2]).collect()}
    assert got == {(1, 2): (6.0, 0.75), (2, 2): (6.0, 0.75)}


def test_single_observation_has_no_variance(spark):
    df = spark.createDataFrame([(1, 0.5)], "rank_w int, g double")
    assert stats.rank_summary(df, "rank_w", "g").first()["variance"] is None


def test_empty_panels(spark):
    df = panels.ranked(panels.shares(panel(spark, []), "week_start", "weekly_metric", "weekly_total", "weekly_share"), "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")])
    assert df.count() == 0 and churn.captures(df, [1], [2]).count() == 0 and panels.missing_dates(df, "week_start").count() == 0
    assert pairs.leakage(df, "week_start", "weekly_metric", "rank_w", [1], 7).count() == 0


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(100,), (101,)], "k int")
    assert [r[0] for r in df.orderBy("k").select(F.ceil(F.col("k") / 100.0)).collect()] == [1, 2]


def test_sources(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "id string, likes long")
    b = spark.createDataFrame([("x", 2, dt.date(2024, 5, 6))], "id string, likes long, date date")
    a.coalesce(1).write.parquet(f"{tmp_path}/dump/2024-01-02.parquet")
    b.coalesce(1).write.parquet(f"{tmp_path}/dump/other.parquet")
    both = readers.read_dumps(spark, f"{tmp_path}/dump")
    assert both.count() == 2 and "date" in both.columns
    dated = {r["file_name"]: r["file_date"] for r in readers.with_file_date(both, "date").collect()}
    assert dated == {"2024-01-02.parquet": dt.date(2024, 1, 2), "other.parquet": dt.date(2024, 5, 6)}
    sinks.write_csv(b, f"{tmp_path}/t.csv")
    assert readers.read_any(spark, f"{tmp_path}/t.csv").first()["likes"] == 2
    b.createOrReplaceTempView("dump_view")
    assert readers.read_any(spark, "nowhere.parquet", "dump_view").count() == 1
    assert readers.find_path(spark, "t.csv", [str(tmp_path)]) == f"{tmp_path}/t.csv"
    assert readers.find_path(spark, "2024-01-02.parquet/*.parquet", [f"{tmp_path}/none", f"{tmp_path}/dump"]).startswith(f"{tmp_path}/dump")
    with pytest.raises(FileNotFoundError):
        readers.find_path(spark, "none.csv", [str(tmp_path)])
    with pytest.raises(ValueError, match="endpoint"):
        readers.resolve_columns(b.select("date", "likes"))


def test_appended_periods_replace_their_own(spark, tmp_path):
    path = f"{tmp_path}/panel"
    sinks.append_periods(panel(spark, [(week(0), "a", 1.0), (week(1), "a", 1.0)]), path, "week_start")
    sinks.append_periods(panel(spark, [(week(1), "b", 2.0)]), path, "week_start")
    assert sorted((r["week_start"], r["endpoint_id"]) for r in spark.read.parquet(path).collect()) == [(week(0), "a"), (week(1), "b")]


def test_interactions_of_absent_and_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "`a.b` long, c long")
    assert [r[0] for r in df.select(panels.interactions(df, ["a.b", "c", "none"])).collect()] == [1, 5]


def test_stream_ranks_closed_weeks(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 12), x, float(v)) for d, x, v in ((1, "a", 1), (7, "a", 2), (2, "b", 5), (8, "a", 1), (30, "z", 1))]
    spark.createDataFrame(rows, "ts timestamp, id string, v double").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, id string, v double").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run closes nothing twice
        weekly_stream.rank_closed_weeks(weekly_stream.weekly_sums(events, "ts", "id", "v"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = sorted((str(r["week_start"]), r["endpoint_id"], r["weekly_metric"], r["rank_w"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("2024-01-01", "a", 3.0, 2), ("2024-01-01", "b", 5.0, 1), ("2024-01-08", "a", 1.0, 1)]
