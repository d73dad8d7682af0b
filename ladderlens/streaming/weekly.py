"""Weekly ranked panels from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ladderlens.operators import panels
from ladderlens.sources.sinks import append_periods


def weekly_sums(events: DataFrame, time: str, endpoint: str, metric: str, late: str = "2 days") -> DataFrame:
    """(week_start, endpoint_id, weekly_metric) of Monday weeks; a week closes when the watermark passes it."""
    week = F.window(time, "7 days", startTime="4 days")  # the epoch was a Thursday
    sums = events.withWatermark(time, late).groupBy(week.alias("w"), F.col(endpoint).cast("string").alias("endpoint_id")).agg(panels.rounded_sum(events, metric).alias("weekly_metric"))
    return sums.select(F.to_date("w.start").alias("week_start"), "endpoint_id", "weekly_metric")


def rank_closed_weeks(sums: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each closed week, with shares and ranks, to its own folder under path.

    A batch that is run again after a failure replaces the weeks it wrote.
    """

    def write(batch: DataFrame, _: int) -> None:
        own = panels.positive(batch, "weekly_metric", ["week_start", "endpoint_id"])
        own = panels.ranked(panels.shares(own, "week_start", "weekly_metric", "weekly_total", "weekly_share"), "week_start", "weekly_metric", "rank_w", ties=[F.col("endpoint_id")])
        append_periods(own, path, "week_start")

    return sums.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
