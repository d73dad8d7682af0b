"""SimHash near-dedup with bit-sliced comparison.

``fingerprints`` gives each text 64 bits: bit j is set if it is set in over
half of the hashes of the text's word shingles.  ``link`` finds the groups of
fingerprints that differ in few bits.  Distinct fingerprints only are
compared.  With radius r the 64 bits are cut into k > r blocks, and any two
fingerprints within r bits agree in k - r blocks at least, so each choice of
k - r blocks is a table whose buckets hold all links (more blocks for more
fingerprints, so that buckets stay small).  Within a task the fingerprints of
many buckets, sorted by bucket, are stored as vertical bit planes.  One shift
of the planes by d lanes compares 64 fingerprints a word with their d-th
successors: the differing bits of all planes are added by carry-save counters,
and words whose lanes have all left the radius are abandoned.  Links within a
task are joined to stars, and the stars to components by Spark.

A bucket of more than ``block`` fingerprints is dealt out in blocks, each pair
of which is a task of its own, so no link is lost.

Defined results: a null text counts as empty; texts without a word have
fingerprint zero and are linked like any other.  A null doc_id never is the
smallest; a component of nulls alone has a null id.  Repeated rows each get
their own row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ladderlens.llm.common import beside, each, materialize, with_few
from ladderlens.llm.components import components

BLOCK = 16_384
#: A fingerprint with more than one in so many of the rows is joined by broadcast.
HOT = 1000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and blanks are 20 and 09 to 0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    width = min(width, len(words))
    counts, total, digest = np.zeros(64, np.int64), len(words) - width + 1, xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        hashes = np.array([digest(joined[a + 1 : b], 42) for a, b in zip(ends[at:to], ends[at + width : to + width], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], width: int = 4, name: str = "fp") -> DataFrame:
    """The columns in keep, and the fingerprint, of every row."""
    return beside(docs, keep, ["text"], StructType([StructField(name, LongType())]), lambda: lambda columns: ({name: [fingerprint(t, width) for t in each(columns[0])]}, None))


def masks(n: int, radius: int, bucket: int = 4096) -> list[int]:
    """Masks of the tables for n fingerprints: signed 64-bit integers."""
    for k in range(radius + 1, radius + 9):
        edges = [round(i * 64 / k) for i in range(k + 1)]
        fixed = k - radius
        if n / 2 ** (fixed * (64 // k)) <= bucket or k == radius + 8:
            bits = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]  # noqa: B905
            return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(bits, fixed)]
    raise AssertionError


def near_lanes(fps: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of one bucket and within the radius, shift by shift.

    fps are unsigned and sorted by bucket.  Distances up to 7 are counted, so
    the radius is 6 at most.
    """
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    flat = np.zeros((64, (2 * words + 2) * 8), np.uint8)
    flat[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = flat.view(np.uint64)
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    last = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]  # end of each lane's bucket
    for d in range(1, int((last - np.arange(n)).max())):
        lanes = np.zeros(words * 8, np.uint8)
        lanes[: -(-n // 8)] = np.packbits(np.arange(n) + d < last, bitorder="little")
        lanes = lanes.view(np.uint64)
        at = np.flatnonzero(lanes)
        live, (q, r) = lanes[at], divmod(d, 64)
        one = two = four = np.zeros(len(at), np.uint64)
        right, left = np.uint64(r), np.uint64(64 - r)
        for j in range(64):
            p = planes[j]
            other = p[at + q] if r == 0 else (p[at + q] >> right) | (p[at + q + 1] << left)
            differ = p[at] ^ other
            carry, one = one & differ, one ^ differ
            carry, two = two & carry, two ^ carry
            carry, four = four & carry, four ^ carry
            live = live & ~carry  # past 7
            if j % 8 == 7:
                if j >= 15:
                    live = live & ~beyond(one, two, four, radius)
                go = live != 0
                if not go.all():
                    at, live, one, two, four = at[go], live[go], one[go], two[go], four[go]
                if not len(at):
                    break
        if len(at):
            hit = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, lane = np.nonzero(hit)
            i = at[w] * 64 + lane
            yield i, i + d


def beyond(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (bits one, two, four) is over the radius."""
    out = np.zeros_like(one)
    for value in range(radius + 1, 8):
        out |= (one if value & 1 else ~one) & (two if value & 2 else ~two) & (four if value & 4 else ~four)
    return out


def stars(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked fingerprint to the first of its group within the task."""
    order = np.lexsort((fps, bucket))
    fps, bucket = fps[order], bucket[order]
    top = np.arange(len(fps))
    for i, j in near_lanes(fps, bucket, radius):
        while (apart := top[i] != top[j]).any():
            i, j = i[apart], j[apart]
            a, b = top[i], top[j]
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while ((up := top[top]) != top).any():
                top = up
    moved = np.flatnonzero(top != np.arange(len(fps)))
    return fps[top[moved]], fps[moved]


def link(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(fp, label) for the distinct fingerprints in prints that have a link to another one."""
    prints = materialize(prints.select("fp").distinct(), "distinct")
    tables = masks(prints.count(), radius)
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in tables))).alias("t", "key"))
    large = keyed.groupBy("t", "key").count().where(F.col("count") > 2 * block)  # summed up before the shuffle
    large = materialize(large.select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("parts")), "large")
    groups = max(1, keyed.count() // block)
    part = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.concat_ws("-", F.least(o, part).cast("string"), F.greatest(o, part).cast("string")))
    dealt = with_few(keyed, large, ["t", "key"], "left").select(
        "fp",
        F.xxhash64("t", "key").alias("bucket"),
        F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(""))).otherwise(pair)).alias("pair"),
        F.col("parts").isNull().alias("small"),
        "t",
        "key",
    )
    group = F.when(F.col("small"), F.pmod(F.xxhash64("t", "key", F.lit(5)), F.lit(groups))).otherwise(F.xxhash64("t", "key", "pair"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = stars(frame["fp"].to_numpy().view(np.uint64), frame["bucket"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = dealt.select("fp", "bucket", "small", group.alias("task")).groupBy("small", "task").applyInPandas(run, "a long, b long")
    return components(found.where("a <> b")).select(F.col("node").alias("fp"), "label")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    rows = materialize(fingerprints(docs, ["doc_id"], width), "prints")
    one = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    linked = one.join(link(rows, radius), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = materialize(linked, "groups")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    found = materialize(linked.join(least, "label").select("fp", "component_id", "rows"), "found")
    # fingerprints that many rows share go to the rows, of which no task should get all; there are HOT of them at most
    total = found.agg(F.sum("rows")).first()[0] or 0
    hot = found.where(F.col("rows") * HOT > total).select("fp", F.struct("component_id").alias("hot"))
    own = rows.join(F.broadcast(hot), "fp", "left")
    cold = own.where("hot is null").select("doc_id", "fp").join(found.where(F.col("rows") * HOT <= total).select("fp", "component_id"), "fp")
    return own.where("hot is not null").select("doc_id", "fp", "hot.component_id").unionByName(cold.select("doc_id", "fp", "component_id"))
