"""Writers of panels and result tables, and the record of a run beside its result."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, zstd-compressed; one folder for each period if partition_by is given."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_periods(df: DataFrame, path: str, period: str) -> None:
    """Write the periods that df has; those already there are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(period).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_one(df: DataFrame, path: str) -> None:
    """A single Parquet file, zstd-compressed, for results that one task can write."""
    spark = df.sparkSession
    folder = f"{path}.writing"
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, path))
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(at) if f.getPath().getName().startswith("part-"))
    store.delete(to, True)
    store.rename(part, to)
    store.delete(at, True)


class RunRecord:
    """Counts and sums of a run's frames, taken as they pass, and its settings.

    ``watch`` puts an observation on a frame; ``write`` writes the result and
    then, in a folder beside it, the record: no frame is computed again for it.
    A frame that is not part of the result's plan, or is in it twice, must not
    be watched.
    """

    def __init__(self, name: str, config: object = None) -> None:
        self.name, self.config = name, config
        self.watched: dict[str, Observation] = {}

    def watch(self, df: DataFrame, frame: str, **metrics: Column) -> DataFrame:
        """df, whose number of rows and other metrics will be in the record under the frame's name."""
        self.watched[frame] = Observation(f"{self.name}-{frame}")
        return df.observe(self.watched[frame], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])

    def write(self, df: DataFrame, path: str) -> None:
        write_panel(df, path)
        config = asdict(self.config) if is_dataclass(self.config) else self.config
        found = {frame: o.get for frame, o in self.watched.items()}
        text = json.dumps({"name": self.name, "config": config, "metrics": found}, default=str, sort_keys=True)
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.run")


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """(frame, metric, value) of the record beside a result."""
    kinds = "name string, config string, metrics map<string, map<string, double>>"
    own = spark.read.text(f"{path}.run").select(F.from_json("value", kinds).alias("r")).select(F.explode("r.metrics").alias("frame", "own"))
    return own.select("frame", F.explode("own").alias("metric", "value"))
