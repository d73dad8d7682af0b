"""Fits over ranks that are monotone, or constant in pieces.

``monotone`` pools slices of ranks in parallel.  What a slice returns are
blocks, which go on as rows; the blocks are dealt to slices again, moved by
half a slice so that old edges lie inside, until no neighbours are pooled any
more.  Pooling in any order gives one result, so slices don't show in it.
``fused`` fits one vector of ranks a task: each of a grid of candidates and
penalties is one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.functions import pooling
from ladderlens.tables import keep

#: Blocks that one task pools.
SLICE = 4096
BLOCK = "at long, to long, y array<double>, w array<double>, linear double, level double"


def _pooled(blocks: DataFrame, group: Sequence[str], slices: Column, loss) -> DataFrame:
    """Blocks of each slice, pooled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        own = [pooling.Block(int(a), int(z), np.asarray(y, float), np.asarray(w, float), float(v)) for a, z, y, w, v in zip(pdf["at"], pdf["to"], pdf["y"], pdf["w"], pdf["linear"], strict=True)]
        rows = [(b.at, b.to, b.y.tolist(), b.w.tolist(), b.linear, b.level) for b in pooling.pool(own, loss)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK.split(", ")])
        for c in reversed(group):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    fields = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in group)
    return blocks.withColumn("_slice", slices).groupBy(*group, "_slice").applyInPandas(run, fields + BLOCK)


def _placed(blocks: DataFrame, group: Sequence[str]) -> DataFrame:
    """blocks with _place, their number in the order of ranks from 0; no window holds more than a stretch of ranks, or a row for each."""
    cut = blocks.withColumn("_stretch", F.expr(f"at div {SLICE}L"))
    counts = cut.groupBy(*group, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_stretch").orderBy("at")))
    return own.join(starts, [*group, "_stretch"]).withColumn("_place", F.col("_start") + F.col("_own") - 1)


def monotone(df: DataFrame, value: str, weight: str, group: Sequence[str] = ("candidate",), penalty: float = 0.0, loss: pooling.Squares | pooling.Huber | None = None, slice_rows: int = SLICE) -> DataFrame:
    """(group, k, iso): the fit of value that never decreases in k, weighted, with the least loss.

    penalty: on the total variation, which for a monotone fit is its last level
    less its first.  k is unique in a group; rows without a value, or without a
    weight above 0, are left out.
    """
    if not group:
        return monotone(df.withColumn("_one", F.lit(0)), value, weight, ["_one"], penalty, loss, slice_rows).drop("_one")
    group, loss = list(group), loss or pooling.Squares()
    own = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*group, F.col("k").cast("long").alias("at"), F.col(value).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"))
    own = keep(own, "ranks")
    ends = own.groupBy(*group).agg(F.min("at").alias("_first"), F.max("at").alias("_last"), F.count("*").alias("_rows"))
    most = ends.agg(F.max("_rows")).first()[0] or 0
    linear = penalty * ((F.col("at") == F.col("_last")).cast("double") - (F.col("at") == F.col("_first")).cast("double"))
    blocks = own.join(ends, group).select(*group, "at", F.col("at").alias("to"), F.array("_y").alias("y"), F.array("_w").alias("w"), linear.alias("linear"), F.lit(0.0).alias("level"))
    if most <= slice_rows:
        blocks = _pooled(blocks, group, F.lit(0), loss)
    else:
        count, still, turn = most, 0, 0
        while still < 2:  # as long as one of two turns, with edges in other places, pools anything
            blocks = keep(_pooled(_placed(blocks, group), group, F.expr(f"(_place + {turn * (slice_rows // 2)}L) div {slice_rows}L"), loss), "blocks")
            now = blocks.count()
            still, count, turn = (still + 1 if now == count else 0), now, 1 - turn
    levels = blocks.select(*group, F.explode(F.sequence("at", "to")).alias("at"), "level")
    return own.join(levels, [*group, "at"]).select(*group, F.col("at").cast("int").alias("k"), F.col("level").alias("iso"))


def fused(df: DataFrame, value: str, weight: str, parts: Sequence[float], group: Sequence[str] = ("candidate",)) -> DataFrame:
    """(group, part, k, penalty, smooth) for each penalty: the fit with few levels, by a penalty on all steps between neighbours.

    A penalty is a part of the one from which on the fit is the mean.
    """
    group = list(group)
    own = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*group, "k", F.col(value).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    own = own.withColumn("part", F.explode(F.array(*map(F.lit, parts))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        y, w = pdf["y"].to_numpy(float), pdf["w"].to_numpy(float)
        penalty = min(float(pdf["part"].iloc[0]), 1.0) * pooling.most_penalty(y, w)
        return pdf[[*group, "part", "k"]].assign(penalty=penalty, smooth=pooling.fused(y, w, penalty))

    fields = "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in [*group, "part", "k"])
    return own.groupBy(*group, "part").applyInPandas(run, f"{fields}penalty double, smooth double")
