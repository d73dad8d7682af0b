"""Weekly ranked tables that are kept up to date as daily files arrive.

A store has three tables: ``ledger``, the files that were loaded; ``increments``,
each file's sums by endpoint, a folder for each week and file; and ``ranked``,
the largest endpoints of each week.  A load reads only files that the ledger
lacks, and ranks only the weeks that they touch.  The ledger is written last: a
load that fails before is done again and replaces the folders that it wrote, so
nothing counts twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlens.operators import panels
from ladderlens.sources.readers import date_in, listed
from ladderlens.sources.sinks import append_periods

LEDGER = "path string, length long, modified timestamp, file_date date, loaded_at timestamp"


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """The files that a store has loaded; empty for a new store."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{store}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def pending(spark: SparkSession, folder: str, store: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length, modified, file_date) of the files that aren't in the ledger, or have changed since; those without a date in their name are no dumps."""
    return listed(spark, folder, pattern).where("file_date is not null").join(ledger(spark, store), ["path", "length", "modified"], "left_anti").select("path", "length", "modified", "file_date")


def load(spark: SparkSession, folder: str, store: str, endpoint: Column, metric: Column, top: int, pattern: str = "*.parquet") -> int:
    """Bring a store up to date with the files of a folder; how many were loaded."""
    files = pending(spark, folder, store, pattern).orderBy("path").collect()  # a row for each new file
    if not files:
        return 0
    path = F.col("_metadata.file_path")
    week = panels.week_of(date_in(path))
    rows = spark.read.option("mergeSchema", True).parquet(*[r["path"] for r in files])
    own = rows.select(week.alias("week_start"), F.md5(F.regexp_replace(path, r"^(\w+):/+", "$1:/")).alias("file"), endpoint.cast("string").alias("endpoint_id"), metric.alias("_metric"))
    sums = own.groupBy("week_start", "file", "endpoint_id").agg(F.sum("_metric").alias("metric"))
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("week_start", "file").parquet(f"{store}/increments")
    spark.catalog.refreshByPath(f"{store}/increments")
    touched = spark.createDataFrame([(r["file_date"],) for r in files], "d date").select(panels.week_of("d").alias("week_start")).distinct()
    weeks = [r["week_start"] for r in touched.collect()]
    kept = spark.read.parquet(f"{store}/increments").where(F.col("week_start").isin(weeks))  # other weeks' folders aren't opened
    total = kept.groupBy("week_start", "endpoint_id").agg(panels.rounded_sum(kept, "metric").alias("metric_value"))
    ranked = panels.top_n(panels.positive(total, "metric_value", ["week_start", "endpoint_id"]), "week_start", "metric_value", top, [F.col("endpoint_id")])
    append_periods(ranked, f"{store}/ranked", "week_start")
    spark.catalog.refreshByPath(f"{store}/ranked")
    done = spark.createDataFrame([tuple(r) for r in files], LEDGER.rpartition(",")[0]).withColumn("loaded_at", F.current_timestamp())
    done.coalesce(1).write.mode("append").parquet(f"{store}/ledger")
    spark.catalog.refreshByPath(f"{store}/ledger")
    return len(files)


def ranked(spark: SparkSession, store: str) -> DataFrame:
    """(week_start, endpoint_id, metric_value, rank) of all weeks."""
    return spark.read.parquet(f"{store}/ranked").select("week_start", "endpoint_id", "metric_value", "rank")
