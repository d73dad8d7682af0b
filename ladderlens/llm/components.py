"""Connected components of a graph of links, by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import hand_on, materialize, scope


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): the smallest node that is reachable.

    Each round takes the smallest label among the neighbours, which Spark sums
    up before the shuffle, and then the label of the label.  The labels of a
    round are written to the shared folder, those of the round before are
    deleted; rounds end when none changes.  Links from a node to itself keep
    the node; no links give no rows.
    """
    spark = links.sparkSession
    with scope(spark) as written:
        ways = F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = materialize(links.select(ways).distinct(), "links")
        labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = lower.join(jump, "label").select("node", F.least("label", "far").alias("label"), (F.col("old") > F.least("label", "far")).alias("moved"))
            step = materialize(step, "labels")
            moved = step.where("moved").limit(1).count()
            labels = step.select("node", "label")
            if not moved:
                hand_on(written.pop())
                return labels
