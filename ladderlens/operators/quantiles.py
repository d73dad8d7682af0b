"""Exact quantiles of groups of any size, by counted slices.

A group's span of values is cut into slices, whose rows Spark counts before the
shuffle.  The slice that holds a wanted place is cut again, between the values
that it really has, until it has few enough rows to sort.  Slices are of equal
width where the ends of a span are within a factor of 4, else of equal width in
the logarithm of the size, so values of all magnitudes take few rounds too.  No
task holds a group, and what a round keeps is a row for each group and place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.tables import keep

SLICES = 1024
#: Rows of a slice that are sorted in one task.
SORTED = 100_000


def _part_of(x: Column, a: Column, b: Column) -> Column:
    """Where x lies between a and b, from 0 to 1."""
    size = lambda v: F.signum(v) * F.coalesce(F.ln(F.nullif(F.abs(v), F.lit(0.0))) + 800, F.lit(0.0))
    near = ((a > 0) & (b <= 4 * a)) | ((b < 0) & (a >= 4 * b))
    return F.when(near, (x - a) / (b - a)).otherwise((size(x) - size(a)) / (size(b) - size(a)))


def quantiles(df: DataFrame, value: str, parts: Sequence[float], group: Sequence[str] = (), slices: int = SLICES, most: int = SORTED) -> DataFrame:
    """(group, p, q) for each p in parts: the quantile of value, between the two nearest rows where p falls between them.

    Equal to Spark's ``percentile``.  Nulls and values that aren't finite don't
    count; groups without any value have no row.  df is read in each round.
    """
    group = list(group)
    x = F.col(value).cast("double")
    rows = df.where(F.abs(x) < float("inf")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], x.alias("_x"))
    keys = [f"_g{i}" for i in range(len(group))]
    spans = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b")).where("_n > 0")
    wanted = spans.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in parts]))).withColumn("_h", (F.col("_n") - 1) * F.col("_p"))
    wanted = keep(wanted.select(*keys, "_p", "_h", F.floor("_h").alias("_low"), F.ceil("_h").alias("_high"), "_n", "_a", "_b"), "places")
    places = wanted.select(*keys, F.explode(F.array("_low", "_high")).alias("_t"), "_a", "_b", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_count")).distinct()
    span = [*keys, "_a", "_b"]

    def inside(spans: DataFrame) -> DataFrame:
        """The rows within spans, with the span of each; there are a few spans for each group."""
        own = spans.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_a", "_b", "_below").distinct()
        met = F.col("_x").between(F.col("_a"), F.col("_b"))
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"_of{k}"))
        return rows.join(F.broadcast(own), met).drop(*[f"_of{k}" for k in keys])

    deep = (wanted.agg(F.max("_n")).first()[0] or 0) > most
    while deep:
        places = keep(places, "spans")
        wide = places.where((F.col("_count") > most) & (F.col("_a") < F.col("_b")))
        if wide.isEmpty():
            break
        at = F.least(F.floor(_part_of(F.col("_x"), F.col("_a"), F.col("_b")) * slices), F.lit(slices - 1))
        counted = inside(wide).groupBy(*span, "_below", at.alias("_slice")).agg(F.count("*").alias("_rows"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        before = Window.partitionBy(*span).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}")) for c in span]
        for s in same[1:]:
            same[0] = same[0] & s
        near = same[0] & F.col("w._t").between(F.col("c._start"), F.col("c._start") + F.col("c._rows") - 1)
        cut = wide.alias("w").join(counted.alias("c"), near).select(*[F.col(f"w.{k}") for k in keys], "w._t", F.col("c._least").alias("_a"), F.col("c._most").alias("_b"), F.col("c._start").alias("_below"), F.col("c._rows").alias("_count"))
        places = places.where((F.col("_count") <= most) | (F.col("_a") == F.col("_b"))).unionByName(cut)
    flat = places.where("_a = _b").select(*keys, "_t", F.col("_a").alias("_v"))
    order = Window.partitionBy(*span).orderBy("_x")
    numbered = inside(places.where("_a < _b")).withColumn("_at", F.col("_below") + F.row_number().over(order) - 1)
    same = F.col("n._at") == F.col("p._t")
    for c in span:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"p.{c}"))
    sorted_ = numbered.alias("n").join(places.where("_a < _b").alias("p"), same).select(*[F.col(f"p.{k}") for k in keys], "p._t", F.col("n._x").alias("_v"))
    met = F.col("v._t") == F.col("e._at")
    for k in keys:
        met = met & F.col(f"v.{k}").eqNullSafe(F.col(f"e.{k}"))
    ends = wanted.select(*keys, "_p", "_h", "_low", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_at"))
    both = ends.alias("e").join(flat.unionByName(sorted_).alias("v"), met).select("e.*", "v._v")
    low = F.col("_at") == F.col("_low")
    out = both.groupBy(*keys, "_p", "_h", "_low").agg(F.max(F.when(low, F.col("_v"))).alias("_v_low"), F.max("_v").alias("_v_high"))
    q = F.col("_v_low") + (F.col("_h") - F.col("_low")) * (F.col("_v_high") - F.col("_v_low"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, group, strict=True)], F.col("_p").alias("p"), q.alias("q"))
