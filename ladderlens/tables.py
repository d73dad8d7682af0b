"""Written tables that cut a plan: what is behind one runs once, and outlives any executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, else one below its warehouse.

    A warehouse on the driver's own disk is shared only where the driver runs the tasks too.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    if path.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a path when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again; it is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
