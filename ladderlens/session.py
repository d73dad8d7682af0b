"""Session helper for tests, the bench and local use."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that this library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ladderlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"file://{tempfile.gettempdir()}/ladderlens-warehouse")  # one machine: its folder is shared
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables, by its Parquet path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
