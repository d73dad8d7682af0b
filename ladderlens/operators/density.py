"""Kernel densities of groups of any size: rows become counts of bins, and only these meet in a task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlens.functions import bandwidth
from ladderlens.operators.quantiles import quantiles

#: Bins for the bandwidth, points of the density, and bandwidths that the points go beyond the values.
BINS, POINTS, BEYOND = 1000, 512, 3.0


def bandwidths(df: DataFrame, value: str, group: Sequence[str], bins: int = BINS) -> DataFrame:
    """(group, bw, least, most): Sheather and Jones' bandwidth, and the span of value, of each group with two different values."""
    group = list(group)
    own = df.where(F.abs(F.col(value)) < float("inf")).select(*group, F.col(value).cast("double").alias("_x"))
    spans = own.groupBy(*group).agg(F.min("_x").alias("least"), F.max("_x").alias("most"), F.stddev_samp("_x").alias("_sd")).where("least < most")
    quarters = quantiles(own, "_x", [0.25, 0.75], group).groupBy(*group).agg((F.max("q") - F.min("q")).alias("_iqr"))
    spans = spans.join(quarters, group)
    at = F.least(F.floor((F.col("_x") - F.col("least")) / (F.col("most") - F.col("least")) * bins), F.lit(bins - 1)).cast("int")
    counts = own.join(spans, group).groupBy(*group, "least", "most", "_sd", "_iqr", at.alias("_bin")).agg(F.count("*").alias("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        full = np.bincount(pdf["_bin"], pdf["_n"], minlength=bins)
        bw = bandwidth.sheather_jones(full, (first["most"] - first["least"]) / bins, first["_sd"], first["_iqr"])
        return pdf[[*group, "least", "most"]].head(1).assign(bw=bw)[[*group, "bw", "least", "most"]]

    fields = "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in group)
    return counts.groupBy(*group).applyInPandas(run, f"{fields}bw double, least double, most double")


def densities(df: DataFrame, value: str, shared: Sequence[str], group: Sequence[str], points: int = POINTS) -> DataFrame:
    """(shared, group, bw, x, density, n): the density of value for each group, at points over the span of shared, with the bandwidth of shared.

    A value's weight goes to the two points beside it, by how near they are.
    """
    shared, keys = list(shared), [*shared, *group]
    of = bandwidths(df, value, shared)
    low, high = F.col("least") - BEYOND * F.col("bw"), F.col("most") + BEYOND * F.col("bw")
    of = of.select(*shared, "bw", low.alias("_low"), ((high - low) / (points - 1)).alias("_step"))
    own = df.where(F.abs(F.col(value)) < float("inf")).select(*keys, F.col(value).cast("double").alias("_x")).join(of, shared)
    place = (F.col("_x") - F.col("_low")) / F.col("_step")
    at = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    ends = F.array(F.struct(at.alias("i"), (1 - (place - at)).alias("part")), F.struct((at + 1).alias("i"), (place - at).alias("part")))
    mass = own.select(*keys, "bw", "_low", "_step", F.inline(ends)).groupBy(*keys, "bw", "_low", "_step", "i").agg(F.sum("part").alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, full = pdf.iloc[0], np.bincount(pdf["i"], pdf["part"], minlength=points)
        x = first["_low"] + first["_step"] * np.arange(points)
        out = pd.DataFrame({"bw": first["bw"], "x": x, "density": bandwidth.normal_density(full / full.sum(), first["_step"], first["bw"]), "n": int(round(full.sum()))})
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    fields = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys)
    return mass.groupBy(*keys).applyInPandas(run, f"{fields}bw double, x double, density double, n long")
