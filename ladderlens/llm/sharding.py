"""Sharding by vector bin packing.

Every row has a size in three dimensions: bytes, tokens (words between ASCII
blanks) and rows.  Rows with equal texts are a group and stay together.
Groups that hold more than a small share of the bytes are items of their own.
All others fall by a hash into ``items`` places, far more than a table of
moderate size has groups, so that nearly each is an item of its own; with more
groups than places an item is a few of them.  So the number of items is bounded
whatever the input.  The driver places the items, largest first, each in the
shard where the dot product of its size with the shard's residual capacity is
highest, among those that have room for it in all three dimensions.  Where none
has, the shard whose tightest dimension is least overfull takes it; a second
packing asks for room in bytes there.  Exchanges of items with equal rows
between the shard of most and that of least bytes then even out what is left,
and of the two packings the one with more equal bytes stays, or, if both have
them equal, the one with more equal rows and tokens.  So shards come out with nearly equal bytes (law ``bytes``), and with tokens and
rows as equal as the groups let them be.

A group of more bytes than a shard's even share can't stay together under that
law: it is dealt row by row into parts of about a thirtieth of a share.

Slots number a shard's rows from 0 without gaps.  They are given out within
parts of items, not in whole shards, and each part starts where the one before
ends, so no task sees a shard.

Defined results: a null text counts as empty and has the checksum 0.  Rows
that are equal in doc_id and text take slots in any order.  Of shards that are
equally good the first takes an item.  An empty table gives no rows.  Texts of
any length count whole.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.llm.common import materialize

#: Places that small groups are hashed into.
ITEMS = 1 << 17
#: Bytes that each row takes beside its text.
OVERHEAD = 16
#: Cells that the rows of a large group's part are dealt into, so that none is large.
CELLS = 64


def place(sizes: np.ndarray, shards: int, bytes_first: bool = False) -> np.ndarray:
    """Shard of each item (row of sizes), by vector bin packing."""
    total = np.maximum(sizes.sum(axis=0), 1)
    share = sizes / total * shards  # of one shard's capacity, in each dimension
    residual = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share[:, 0], -share.sum(axis=1))):
        room = residual - share[i]
        fits, able = (room >= 0).all(axis=1), (room[:, 0] >= 0) | (not bytes_first)
        if fits.any():
            best = np.where(fits, residual @ share[i], -np.inf).argmax()
        elif able.any():
            best = np.where(able, room.min(axis=1), -np.inf).argmax()
        else:
            best = room[:, 0].argmax()
        out[i], residual[best] = best, room[best]
    return out


def even_out(sizes: np.ndarray, out: np.ndarray, shards: int, rounds: int = 20) -> np.ndarray:
    """out with items of one row exchanged between the shard of most and that of least bytes, while that brings them closer."""
    out, load = out.copy(), np.bincount(out, sizes[:, 0], shards)
    single = [np.flatnonzero((out == s) & (sizes[:, -1] == 1)) for s in range(shards)]
    for _ in range(rounds * shards):
        a, b = int(load.argmax()), int(load.argmin())
        own, other = (x[np.argsort(sizes[x, 0], kind="stable")] for x in (single[a], single[b]))
        if not len(own) or not len(other):
            break
        gap = load[a] - load[b]
        match = np.clip(np.searchsorted(sizes[other, 0], sizes[own, 0] - gap / 2), 0, len(other) - 1)
        gain = sizes[own, 0] - sizes[other[match], 0]
        k = int(np.abs(gain - gap / 2).argmin())
        if not 0 < gain[k] < gap:
            break
        i, j = own[k], other[match[k]]
        out[i], out[j] = b, a
        load[a], load[b] = load[a] - gain[k], load[b] + gain[k]
        own[k], other[match[k]] = j, i
        single[a], single[b] = own, other
    return out


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The better of two packings, evened out."""

    def unevenness(out: np.ndarray) -> tuple[float, float]:
        loads = np.stack([np.bincount(out, column, shards) for column in sizes.T])
        spread = np.ptp(loads, axis=1) / np.maximum(loads.mean(axis=1), 1)
        return round(float(spread[0]), 3), float(spread[1:].max(initial=0))

    return min((even_out(sizes, place(sizes, shards, first), shards) for first in (False, True)), key=unevenness)


def shard(docs: DataFrame, shards: int, items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    tokens = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        tokens.alias("tokens"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(text, F.lit(1)).alias("h2"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    # at most 128 x shards groups can hold more than 1 / (128 x shards) of all bytes
    large = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * 128 * shards > total)
    parts = F.when(F.col("bytes") * shards > total, F.ceil(32 * F.col("bytes") * shards / F.lit(max(total, 1)))).otherwise(1)
    large = materialize(large.select("h1", "h2", parts.cast("int").alias("parts")), "large")
    part = F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")).cast("string")
    alone = F.col("parts").isNotNull()
    item = F.when(alone, F.concat_ws(":", "h1", "h2", part)).otherwise(F.pmod("h1", F.lit(items)).cast("string"))
    cell = F.when(alone, F.pmod(F.xxhash64("row", F.lit(3)), F.lit(CELLS))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(large), ["h1", "h2"], "left").select("doc_id", "size", "text_crc32", "tokens", "h1", "h2", "row", item.alias("item"), cell.alias("cell"))
    cells = dealt.groupBy("item", "cell").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).toPandas()  # items + CELLS x large groups rows at most
    cells = cells.sort_values(["item", "cell"]).reset_index(drop=True)
    packed = cells.groupby("item", sort=True)[["bytes", "tokens", "rows"]].sum()
    sizes = packed.to_numpy(np.float64)
    where = pack(sizes, shards)
    cells["shard"] = cells["item"].map(dict(zip(packed.index, where.tolist(), strict=True))).astype("int32")
    cells["base"] = (cells.groupby("shard")["rows"].cumsum() - cells["rows"]).astype("int64") if len(cells) else cells["rows"]
    plan = spark.createDataFrame(list(cells[["item", "cell", "shard", "base"]].itertuples(index=False, name=None)), "item string, cell int, shard int, base long")
    within = Window.partitionBy("item", "cell").orderBy("doc_id", "h1", "h2", "row")
    return (
        dealt.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(plan), ["item", "cell"])  # as many rows as cells
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
