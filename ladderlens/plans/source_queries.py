"""Queries over the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ladderlens.config import SMALL
from ladderlens.operators import churn, panels
from ladderlens.plans.inputs import DAYS_SQL, SUPPLIERS, rounded, supplier_sums, supplier_weeks, user_days
from ladderlens.registry import query
from ladderlens.session import table
from ladderlens.sources import matrices, readers, sinks, staging
from ladderlens.tables import folder, keep, remove_at_end


@query("s1_list_and_read", "SELECT count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_keys FROM nation")
def s1(spark, d):
    """Rows of the files of a folder that match a pattern."""
    return readers.read_dumps(spark, d, "nation.parquet").agg(F.count("*").alias("n_rows"), F.countDistinct("n_nationkey").alias("n_keys"))


@query("s2_file_date", "SELECT 'events.parquet' AS file_name, min(CAST(ts AS DATE)) AS file_date, count(*) AS n FROM events")
def s2(spark, d):
    """The date of each file: from its name, else the least date inside."""
    return readers.with_file_date(table(spark, d, "events"), "ts").groupBy("file_name", "file_date").agg(F.count("*").alias("n"))


@query(
    "s3_union_by_name",
    "SELECT 'orders' AS origin, count(*) AS n, count(o_totalprice) AS n_price, count(NULL) AS n_quantity FROM orders UNION ALL SELECT 'lineitem', count(*), count(l_extendedprice), count(l_quantity) FROM lineitem",
)
def s3(spark, d):
    """Files with different columns in one table; what one lacks is null."""
    orders = table(spark, d, "orders").select(F.lit("orders").alias("origin"), F.col("o_totalprice").alias("price"))
    items = table(spark, d, "lineitem").select(F.lit("lineitem").alias("origin"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return readers.union_by_name([orders, items]).groupBy("origin").agg(F.count("*").alias("n"), F.count("price").alias("n_price"), F.count("quantity").alias("n_quantity"))


@query("s4_read_any", "SELECT r_regionkey, r_name FROM region")
def s4(spark, d):
    """A file by its extension."""
    return readers.read_any(spark, f"{d}/region.parquet").select("r_regionkey", "r_name")


@query("s8_projected_read", "SELECT CAST(l_shipdate AS DATE) AS ship_date, count(*) AS n, round(sum(l_extendedprice), 2) AS metric FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def s8(spark, d):
    """Two of eleven columns are read, and the filter is pushed down."""
    own = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP '2000-01-01'").select(F.to_date("l_shipdate").alias("ship_date"), "l_extendedprice")
    return own.groupBy("ship_date").agg(F.count("*").alias("n"), panels.rounded_sum(own, "l_extendedprice").alias("metric"))


@query("s9_resolve_and_fill", f"WITH {DAYS_SQL} SELECT date, endpoint_id, metric_value, total_metric, round(share, 9) AS share, rank FROM daily")
def s9(spark, d):
    """A panel with other names and a rank that is mostly null gets all its columns."""
    odd = user_days(spark, d).select(F.col("date").alias("Day"), F.col("endpoint_id").alias("page_id"), F.col("metric_value").alias("interactions"), F.when(F.col("rank") < 3, F.col("rank")).alias("rank"))
    return readers.fill_panel(readers.coerce(readers.resolve_columns(odd))).withColumns({"share": panels.rounded("share", 9)})


@query("s10_standardize_long", f"WITH {SUPPLIERS} SELECT endpoint_id AS id, week_start AS time, CAST(rank() OVER (PARTITION BY week_start ORDER BY weekly_metric DESC) AS INTEGER) AS rank, round(weekly_share, 9) AS share, weekly_metric AS metric FROM weekly")
def s10(spark, d):
    """The long form (id, time, rank, share, metric), with least ranks."""
    return readers.standardize_long(keep(supplier_sums(spark, d), "sums")).withColumns({"share": panels.rounded("share", 9)})


@query("s11_rename_stats", f"WITH {SUPPLIERS} SELECT rank_w AS k, round(avg(weekly_share), 9) AS mean_share, count(*) AS n FROM weekly GROUP BY 1")
def s11(spark, d):
    """A table of statistics by rank under its standard names."""
    stats = supplier_weeks(spark, d).groupBy("rank_w").agg(F.avg("weekly_share").alias("avg_share"), F.count("*").alias("count"))
    return stats.withColumnsRenamed({"rank_w": "k", "avg_share": "mean_share", "count": "n"}).select("k", *rounded("mean_share", digits=9), "n")


def scratch(spark, name):
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    return path


def write_days(spark, d, path, days=None):
    """The events as daily files, a folder with the date in its name for each day."""
    own = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id", "value")
    (own if days is None else own.where(days)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


@query(
    "s12_incremental_weeks",
    f"""WITH {DAYS_SQL}, w AS (SELECT CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS week_start, CAST(user_id AS VARCHAR) AS endpoint_id, round(sum(value), 2) AS metric_value FROM events GROUP BY 1, 2)
    SELECT week_start, endpoint_id, metric_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY week_start ORDER BY metric_value DESC, endpoint_id) AS n, CAST(dense_rank() OVER (PARTITION BY week_start ORDER BY metric_value DESC) AS INTEGER) AS rank FROM w WHERE metric_value > 0) WHERE n <= 100""",
)
def s12(spark, d):
    """The largest hundred of each week, from daily files of which every third comes late: two loads, and one that finds nothing new."""
    dumps, store = scratch(spark, "dumps"), scratch(spark, "weeks")
    late = F.pmod(F.unix_date("day"), F.lit(3)) == 0
    for days in (~late, late, F.lit(False)):
        write_days(spark, d, dumps, days)
        staging.load(spark, dumps, store, F.col("user_id"), F.col("value"), 100)
    return staging.ranked(spark, store)


@query(
    "r2_sampled_files",
    "WITH o AS (SELECT CAST(ts AS DATE) AS file_date, value FROM events), p AS (SELECT file_date FROM (SELECT DISTINCT file_date FROM o) ORDER BY md5('42/' || CAST(file_date AS VARCHAR)), file_date LIMIT 10) SELECT file_date, count(*) AS n, round(sum(value), 2) AS metric FROM o JOIN p USING (file_date) GROUP BY 1",
)
def r2(spark, d):
    """Rows and sums of ten days, chosen by a seed among the names of the daily files."""
    dumps = scratch(spark, "dumps")
    write_days(spark, d, dumps)
    own = readers.sampled_dumps(spark, dumps, 10, SMALL.seed)
    return own.groupBy("file_date").agg(F.count("*").alias("n"), panels.rounded_sum(own, "value").alias("metric"))


@query(
    "s15_run_record",
    f"""WITH {SUPPLIERS}, r AS (SELECT rank_w, avg(weekly_share) AS mean FROM weekly WHERE rank_w <= 50 GROUP BY 1)
    SELECT 'panel' AS frame, unnest(['rows', 'metric', 'last_rank']) AS metric, unnest([CAST(n AS DOUBLE), m, CAST(k AS DOUBLE)]) AS value FROM (SELECT count(*) AS n, round(sum(weekly_metric), 2) AS m, max(rank_w) AS k FROM weekly)
    UNION ALL SELECT 'result', unnest(['rows', 'share']), unnest([CAST(n AS DOUBLE), s]) FROM (SELECT count(*) AS n, round(sum(mean), 9) AS s FROM r)""",
)
def s15(spark, d):
    """What a run saw of its frames, from the record beside its result."""
    path, run = scratch(spark, "run"), sinks.RunRecord("shares", SMALL)
    weekly = run.watch(supplier_weeks(spark, d), "panel", metric=F.round(F.sum("weekly_metric"), 2), last_rank=F.max("rank_w"))
    out = weekly.where(F.col("rank_w") <= SMALL.k_head).groupBy("rank_w").agg(F.avg("weekly_share").alias("mean"))
    run.write(run.watch(out, "result", share=F.round(F.sum("mean"), 9)), path)
    remove_at_end(spark, f"{path}.run")
    return sinks.read_record(spark, path)


@query(
    "s16_weekday_matrices",
    f"""WITH {DAYS_SQL}, s AS (SELECT date, endpoint_id, rank FROM daily WHERE rank <= 2000), b AS (SELECT DISTINCT date FROM daily WHERE date + 7 IN (SELECT date FROM daily)),
    m AS (SELECT coalesce(x.date, y.date - 7) AS date, coalesce(x.rank, 2001) AS from_rank, coalesce(y.rank, 2001) AS to_rank FROM s x FULL JOIN s y ON y.endpoint_id = x.endpoint_id AND y.date = x.date + 7),
    n AS (SELECT strftime(date, '%A') AS weekday, from_rank, to_rank, count(*) AS n FROM m WHERE date IN (SELECT date FROM b) GROUP BY 1, 2, 3)
    SELECT weekday, from_rank, to_rank, n, round(n / sum(n) OVER (PARTITION BY weekday, from_rank), 6) AS p FROM n""",
)
def s16(spark, d):
    """The transition matrices, written as one compressed file a weekday and read again."""
    path = scratch(spark, "matrices")
    spark.dataSource.register(matrices.WeekdayMatrices)
    moves = churn.transitions(user_days(spark, d), "date", "rank", 7, churn.OFF_LIST - 1).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in matrices.SCHEMA.split(", ")])
    moves.repartition("weekday").write.format("weekday_matrices").mode("overwrite").save(path)
    return spark.read.format("weekday_matrices").load(path).withColumn("p", F.round("p", 6))
