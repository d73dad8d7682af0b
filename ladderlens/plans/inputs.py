"""The panels that the named queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlens.operators import panels
from ladderlens.session import table


def supplier_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week_start, endpoint_id, weekly_metric) of suppliers, for what needs no ranks."""
    return panels.weekly_sums(table(spark, sf_dir, "lineitem"), F.col("l_shipdate"), F.col("l_suppkey"), F.col("l_extendedprice"))


def part_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly_sums(table(spark, sf_dir, "lineitem"), F.col("l_shipdate"), F.col("l_partkey"), F.col("l_extendedprice"))


def user_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, endpoint_id, metric_value) of users."""
    return panels.daily_sums(table(spark, sf_dir, "events"), F.col("ts"), F.col("user_id"), F.col("value"))


def supplier_weeks(spark: SparkSession, sf_dir: str, rows: str | None = None) -> DataFrame:
    return panels.weekly_panel(table(spark, sf_dir, "lineitem"), F.col("l_shipdate"), F.col("l_suppkey"), F.col("l_extendedprice"), rows)


def part_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly_panel(table(spark, sf_dir, "lineitem"), F.col("l_shipdate"), F.col("l_partkey"), F.col("l_extendedprice"))


def customer_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly_panel(table(spark, sf_dir, "orders"), F.col("o_orderdate"), F.col("o_custkey"), F.col("o_totalprice"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.daily_panel(table(spark, sf_dir, "events"), F.col("ts"), F.col("user_id"), F.col("value"))


def weeks_sql(source: str = "lineitem", date: str = "l_shipdate", endpoint: str = "l_suppkey", metric: str = "l_extendedprice") -> str:
    """The CTE ``weekly``."""
    return f"""
weekly_raw AS (
  SELECT CAST(date_trunc('week', CAST({date} AS DATE)) AS DATE) AS week_start, CAST({endpoint} AS VARCHAR) AS endpoint_id, round(sum({metric}), 2) AS weekly_metric
  FROM {source} GROUP BY 1, 2 HAVING round(sum({metric}), 2) > 0),
weekly_sum AS (SELECT week_start, round(sum(weekly_metric), 2) AS weekly_total FROM weekly_raw GROUP BY 1),
weekly AS (
  SELECT week_start, endpoint_id, weekly_metric, weekly_total, weekly_metric / weekly_total AS weekly_share,
    CAST(row_number() OVER (PARTITION BY week_start ORDER BY weekly_metric DESC, endpoint_id) AS INTEGER) AS rank_w
  FROM weekly_raw JOIN weekly_sum USING (week_start))"""


DAYS_SQL = """
daily_raw AS (
  SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS endpoint_id, round(sum(value), 2) AS metric_value
  FROM events GROUP BY 1, 2 HAVING round(sum(value), 2) > 0),
daily_sum AS (SELECT date, round(sum(metric_value), 2) AS total_metric FROM daily_raw GROUP BY 1),
daily AS (
  SELECT date, endpoint_id, metric_value, total_metric, metric_value / total_metric AS share,
    CAST(row_number() OVER (PARTITION BY date ORDER BY metric_value DESC, endpoint_id) AS INTEGER) AS rank
  FROM daily_raw JOIN daily_sum USING (date))"""

SUPPLIERS = weeks_sql()
PARTS = weeks_sql(endpoint="l_partkey")
CUSTOMERS = weeks_sql("orders", "o_orderdate", "o_custkey", "o_totalprice")


def rounded(*names: str, digits: int = 6) -> list:
    return [panels.rounded(n, digits).alias(n) for n in names]
