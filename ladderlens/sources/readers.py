"""Readers: files of several formats, dates of files, and schemas with other names."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderlens.operators import panels

DATE = r"(\d{4}-\d{2}-\d{2})"

#: Names that a column may have, the first present wins.
SYNONYMS = {
    "date": ["date", "day", "week_start", "time", "ts"],
    "endpoint_id": ["endpoint_id", "id", "page_id", "account_id", "name"],
    "metric_value": ["metric_value", "weekly_metric", "metric", "value", "interactions"],
    "rank": ["rank", "rank_w"],
    "total_metric": ["total_metric", "weekly_total", "total"],
    "share": ["share", "weekly_share"],
}


def read_any(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A registered table if it exists, else a file or folder by its extension.

    Parquet, ORC, JSON, CSV and TSV (also gzipped) are read by Spark.
    """
    if table and spark.catalog.tableExists(table):
        return spark.table(table)
    name = path.lower().removesuffix(".gz").rstrip("/")
    kind = name.rpartition(".")[2]
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else ",")
    if kind in ("json", "orc"):
        return spark.read.format(kind).load(path)
    return spark.read.parquet(path)


def read_dumps(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All Parquet files of a folder, by name of column; folder names are no partitions."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(folder)


def date_in(path: Column) -> Column:
    """The last date in a path, as in the name of a daily file or of its folder; null if there is none."""
    return F.to_date(F.nullif(F.regexp_extract(path, ".*" + DATE, 1), F.lit("")))


def listed(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length, modified, file_date) of the files below a folder; Spark lists them and opens none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), date_in(F.col("path")).alias("file_date"))


def sampled_dumps(spark: SparkSession, folder: str, days: int = 10, seed: int = 42, pattern: str = "*.parquet") -> DataFrame:
    """The files of so many days, with file_date; the days are those with the least hash of seed and date.

    The choice is made among the names, so files of other days are never opened.
    """
    files = listed(spark, folder, pattern).where("file_date is not null")
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("file_date").cast("string")))
    chosen = files.select("file_date").distinct().orderBy(order, "file_date").limit(days)
    paths = [r["path"] for r in files.join(F.broadcast(chosen), "file_date", "left_semi").orderBy("path").collect()]  # names of some days' files
    if not paths:
        raise FileNotFoundError(f"no file with a date in its name below {folder}")
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    return rows.withColumn("file_date", date_in(F.col("_metadata.file_path")))


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def file_name() -> Column:
    """The name of the file that a row came from; of a folder of part files, the folder's."""
    path = F.col("_metadata.file_path")
    return F.regexp_extract(path, r"([^/]+\.parquet)(?:/[^/]*)?$", 1)


def with_file_date(df: DataFrame, date: str) -> DataFrame:
    """df with file_date: the date in the file's name, else the least date inside the file."""
    named = df.select("*", file_name().alias("file_name"))
    least = named.groupBy("file_name").agg(F.min(F.to_date(date)).alias("_least"))  # a row for each file
    by_name = F.to_date(F.nullif(F.regexp_extract("file_name", DATE, 1), F.lit("")))
    return named.join(least, "file_name").withColumn("file_date", F.coalesce(by_name, "_least")).drop("_least")


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first of names that df has, whatever its case."""
    own = {c.lower(): c for c in df.columns}
    return next((own[n.lower()] for n in names if n.lower() in own), None)


def resolve_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """df with the names of SYNONYMS; date, endpoint_id and metric_value must be found."""
    chosen = {want: (mapping or {}).get(want) or first_present(df, names) for want, names in SYNONYMS.items()}
    if missing := [c for c in ("date", "endpoint_id", "metric_value") if not chosen[c]]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`").alias(want) for want, c in chosen.items() if c])


def coerce(df: DataFrame) -> DataFrame:
    """date as DATE, endpoint_id as STRING, the numbers as DOUBLE and rank as INT; what can't be cast is null."""
    kinds = {"date": "date", "endpoint_id": "string", "rank": "int"}
    return df.select(*[F.col(c).try_cast(kinds.get(c, "double")).alias(c) for c in df.columns])


def fill_panel(df: DataFrame, most_null: float = 0.25) -> DataFrame:
    """A resolved panel with total_metric, share and rank.

    A column that is absent, or null in over most_null of the rows, is computed.
    """
    optional = [c for c in ("total_metric", "share", "rank") if c in df.columns]
    nulls = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in optional]).first() if optional else {}
    good = {c for c in optional if (nulls[c] or 0) <= most_null}
    out = df
    if "total_metric" not in good:
        totals = df.groupBy("date").agg(panels.rounded_sum(df, "metric_value").alias("total_metric"))
        out = out.drop("total_metric").join(totals, "date")
    if "share" not in good:
        out = out.drop("share").withColumn("share", F.try_divide("metric_value", "total_metric"))
    if "rank" not in good:
        out = panels.ranked(out.drop("rank"), "date", "metric_value", "rank", ties=[F.col("endpoint_id")])
    return out.select("date", "endpoint_id", "metric_value", "total_metric", "share", "rank")


def standardize_long(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """(id, time, rank, share, metric) of a panel with other names; rank is the least rank of ties.

    Times that are no dates become their ordinal.
    """
    df = resolve_columns(df, mapping)
    if not isinstance(df.schema["date"].dataType, T.DateType | T.TimestampType):
        order = df.select("date").distinct().select("date", F.dense_rank().over(Window.orderBy("date")).alias("_at"))  # a row for each time
        df = df.join(order, "date").drop("date").withColumnRenamed("_at", "date")
    else:
        df = df.withColumn("date", F.to_date("date"))
    metric = F.greatest(F.col("metric_value").cast("double"), F.lit(0.0))
    totals = df.groupBy("date").agg(panels.rounded_sum(df, metric).alias("_total"))
    out = df.join(totals, "date").select(F.col("endpoint_id").cast("string").alias("id"), F.col("date").alias("time"), F.try_divide(metric, "_total").alias("share"), metric.alias("metric"))
    return panels.ranked(out, "time", "metric", "rank", "rank").select("id", "time", "rank", "share", "metric")


def find_path(spark: SparkSession, name: str, roots: Iterable[str] = ("", "~", "data", "data/raw")) -> str:
    """The first of roots/name that Spark can list, else a file of that name anywhere below the roots.

    Spark does the looking, so roots may be in any store that it reads; no file is opened.
    """

    def files(path: str, **options) -> DataFrame | None:
        try:
            return spark.read.format("binaryFile").options(**options).load(path).select("path")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    roots = [os.path.expanduser(r) for r in roots]
    for root in roots:
        path = os.path.join(root, name)
        if files(path) is not None:
            return path
    for root in filter(None, roots):
        below = files(root, recursiveFileLookup=True, pathGlobFilter=os.path.basename(name))
        if below is not None and (found := below.agg(F.min("path")).first()[0]):
            return found
    raise FileNotFoundError(name)
