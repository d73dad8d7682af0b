"""Merkle manifest of a table: one tree for each source, and one over their roots.

Leaves of a source ascend by doc_id.  A level's nodes are hashed in runs of
``fanout``; the last run may be shorter, down to one node, and is not padded.
This goes on until one node remains.

The leaves are dealt by ranges of (source, doc_id) and each gets its place in
its source, from counts of the partitions.  Every task then streams its leaves
into a mountain range: a stack that holds, for each level, the nodes of the run
not yet full.  A full run is hashed and carried to the level above, as in
counting to the base ``fanout``.  A task knows how many leaves a source has, so
it closes a short last run too.  Runs that no task holds from end to end leave
their nodes open, at most two runs a level and stretch; these meet by their
place in a shuffle, level by level.  Proofs go from the roots down: each run is
joined with the path of its parent, so a path is made once a run.

Defined results: a null value is hashed as ``-``, so nulls differ from empty
texts.  The null source is a source and comes first.  Null ids come first in
their source; equal ids are ordered by their leaf, and equal rows are leaves of
their own.  Other columns are not looked at.  An empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladderlens.llm.common import hand_on, materialize, named, scope, with_few

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits of a digest.
WIDE = 64
NODE = "grp string, level int, idx long, n long, digest string, open boolean"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(values: Sequence[Column]) -> Column:
    """Hash of the values, each after its length in bytes."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in as_text)), 256)


def group_of(source: Column) -> Column:
    """A source as a text that isn't null; the null source is before all others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def nodes_at(level: int, fanout: int) -> Column:
    """How many nodes a level has over n leaves."""
    return F.expr(f"(n + {fanout**level - 1}L) div {fanout**level}L")


def sizes(n: int, fanout: int) -> list[int]:
    """Nodes of each level over n leaves, up to the one at the top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """The mountain range over consecutive leaves of a group that has n in all."""

    def __init__(self, n: int, fanout: int, emit: Callable[[int, int, str, bool], None]) -> None:
        self.sizes, self.fanout, self.emit = sizes(n, fanout), fanout, emit
        self.first = [0] * len(self.sizes)
        self.held: list[list[str]] = [[] for _ in self.sizes]

    def push(self, idx: int, digest: str) -> None:
        """Take the next leaf; carries go as far up as runs become full."""
        for level, size in enumerate(self.sizes):
            if size == 1:
                self.emit(level, idx, digest, False)
                return
            held = self.held[level]
            if not held:
                self.first[level] = idx
            held.append(digest)
            if (idx + 1) % self.fanout and idx + 1 < size:
                return
            whole = self.first[level] % self.fanout == 0
            self._out(level, not whole)
            if not whole:
                return
            digest, idx = hashlib.sha256("".join(held).encode()).hexdigest(), idx // self.fanout
            self.held[level] = []

    def _out(self, level: int, is_open: bool) -> None:
        for i, d in enumerate(self.held[level]):
            self.emit(level, self.first[level] + i, d, is_open)
        if is_open:
            self.held[level] = []

    def close(self) -> None:
        """Hand out what waits for nodes of other tasks."""
        for level in range(len(self.sizes)):
            self._out(level, True)


def _climb(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]
        at: tuple[str, int] | None = None
        peaks: Range | None = None

        def start(grp: str, n: int) -> Range:
            def emit(level: int, idx: int, digest: str, is_open: bool) -> None:
                if level or is_open:  # whole leaves are in the table of leaves
                    for column, value in zip(out, (grp, level, idx, n, digest, is_open), strict=True):
                        column.append(value)

            return Range(n, fanout, emit)

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["grp", "level", "idx", "n", "digest", "open"])
            for c in out:
                c.clear()
            return made

        for b in batches:
            for grp, idx, n, digest in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if peaks is None or at != (grp, idx):
                    if peaks is not None:
                        peaks.close()
                    peaks = start(grp, n)
                peaks.push(idx, digest)
                at = (grp, idx + 1)
            if len(out[0]) > 4096:
                yield batch()
        if peaks is not None:
            peaks.close()
        yield batch()

    return run


@dataclass
class Forest:
    """Trees over groups of leaves.

    rows: the leaves with their idx and the n of their group; nodes: (grp,
    level, idx, n, digest) above the leaves; tops: (grp, n, top).
    """

    rows: DataFrame
    nodes: DataFrame
    tops: DataFrame
    height: int
    fanout: int


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with idx, the place in grp by order, and n, the rows of grp; no task holds more than a range of them."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    by = ["grp", *order, "row"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("row")
    dealt = materialize(dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), "ranges")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = dealt.groupBy("part", "grp").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
    counts = counts.select("part", "grp", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    found = with_few(dealt, materialize(counts, "counts"), ["part", "grp"])
    return materialize(found.withColumn("idx", F.col("seq") + F.col("shift")).drop("seq", "shift", "part").sortWithinPartitions("grp", "idx"), "placed")


def run_of(fanout: int) -> Column:
    return F.expr(f"idx div {fanout}L")


def in_order(*values: str) -> Column:
    """The rows of a run by their place; there are fanout at most."""
    return F.array_sort(F.collect_list(F.struct("idx", *values)))


def joined(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda x: x["digest"]), "")


def grow(rows: DataFrame, order: Sequence[str], fanout: int = FANOUT) -> Forest:
    """Trees over rows with (grp, digest), whose leaves are in the given order."""
    rows = placed(rows, order)
    height = len(sizes(rows.agg(F.max("n")).first()[0] or 1, fanout)) - 1
    climbed = materialize(rows.select("grp", "idx", "n", "digest").mapInArrow(_climb(fanout), NODE), "nodes")
    parts, open_ = [climbed.where("level > 0").drop("open")], climbed.where("open").drop("open")
    if not open_.isEmpty():
        merged = None
        for level in range(height):
            children = open_.where(F.col("level") == level)
            children = children.unionByName(merged.where(nodes_at(level, fanout) > 1)) if merged is not None else children
            runs = children.groupBy("grp", run_of(fanout).alias("idx"), "n").agg(in_order("digest").alias("run"))
            merged = materialize(runs.select("grp", F.lit(level + 1).alias("level"), "idx", "n", F.sha2(joined(F.col("run")), 256).alias("digest")), "merged")
            parts.append(merged)
    nodes = reduce(DataFrame.unionByName, parts)
    lone = rows.where("n = 1").select("grp", "n", F.col("digest").alias("top"))
    top = F.lit(False)
    for level in range(1, height + 1):
        top = top | ((F.col("level") == level) & (nodes_at(level, fanout) == 1))
    return Forest(rows, nodes, nodes.where(top).select("grp", "n", F.col("digest").alias("top")).unionByName(lone), height, fanout)


def _beside(i: Column, text: Column) -> tuple[Column, Column]:
    """What a run's text has before and after its i-th digest."""
    return F.substr(text, F.lit(1), i * WIDE), F.substr(text, (i + 1) * WIDE + 1)


def down(forest: Forest, tops: DataFrame, payload: Sequence[str]) -> DataFrame:
    """The leaves with their payload, the columns of tops, and their path.

    tops: for each grp ``path``, the siblings before and after from its top to
    what is above, and ``rest``, their text.  Both are extended by the levels
    of the tree; no path is made twice for one run.
    """
    fanout, extra = forest.fanout, [c for c in tops.columns if c not in ("grp", "path", "rest")]
    tops = forest.tops.select("grp", "n").join(tops, "grp")

    def at(level: int) -> DataFrame:
        """Tops at a level, as nodes."""
        is_top = nodes_at(level, fanout) == 1
        if level:
            is_top = is_top & (nodes_at(level - 1, fanout) > 1)
        return tops.where(is_top).select("grp", F.lit(0).cast("long").alias("parent"), "path", "rest", *extra)

    def step(children: DataFrame, parents: DataFrame, own: Sequence[str], alone: Column) -> DataFrame:
        runs = children.groupBy("grp", run_of(fanout).alias("parent")).agg(in_order("digest", *own, "n").alias("run"))
        found = runs.join(parents, ["grp", "parent"]).withColumn("text", joined(F.col("run"))).select("*", F.posexplode("run").alias("i", "one"))
        before, after = _beside(F.col("i"), F.col("text"))
        path = F.when(alone, F.col("path")).otherwise(F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), F.col("path")))
        return found.select("grp", "one.*", path.alias("path"), F.when(alone, F.col("rest")).otherwise(F.concat(before, after, "rest")).alias("rest"), *extra)

    parents = at(forest.height)
    for level in range(forest.height - 1, 0, -1):
        children = forest.nodes.where(F.col("level") == level).where(nodes_at(level, fanout) > 1)
        parents = step(children, parents, [], F.lit(False)).select("grp", F.col("idx").alias("parent"), "path", "rest", *extra).unionByName(at(level))
    if forest.height:
        parents = parents.unionByName(at(0))
    return step(forest.rows, parents, payload, F.col("one.n") == 1)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


def _subroots(forest: Forest) -> DataFrame:
    """The top of each group as a leaf of the one tree above."""
    return forest.tops.select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("top").alias("digest"))


def _grown(docs: DataFrame, changed: Column | None, fanout: int) -> tuple[Forest, Forest]:
    """The trees of the sources, and the one over their tops."""
    claim = F.lit(None).cast("string") if changed is None else changed
    leaves = docs.select(group_of(named("source")).alias("grp"), named("doc_id").alias("doc_id"), leaf([named(c) for c in FIELDS]).alias("digest"), claim.alias("changed"))
    forest = grow(leaves, ["doc_id", "digest"], fanout)
    return forest, grow(_subroots(forest), ["source"], fanout)


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, source, level, idx, n, digest): all nodes above the leaves, and the subroots as leaves of the tree ``root``; a written table."""
    with scope(docs.sparkSession) as written:
        forest, whole = _grown(docs, None, fanout)
        null_or = F.when(F.col("source") != "", F.substr("source", F.lit(2)))
        own = forest.nodes.withColumnRenamed("grp", "source").select(F.lit("source").alias("tree"), null_or.alias("source"), "level", "idx", "n", "digest")
        subroots = whole.rows.select(F.lit("root").alias("tree"), null_or.alias("source"), F.lit(0).alias("level"), "idx", "n", "digest")
        above = whole.nodes.select(F.lit("root").alias("tree"), F.lit(None).cast("string").alias("source"), "level", "idx", "n", "digest")
        out = materialize(own.unionByName(subroots).unionByName(above), "manifest")
        hand_on(written.pop())
    return out


def verify(docs: DataFrame, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """For each of docs: leaf, subroot, root, the hash of its proof, and whether its leaf and siblings give the root.

    ``changed`` is a leaf to be checked in place of the row's own; null where
    there is none.  The result is a written table.
    """
    with scope(docs.sparkSession) as written:
        forest, whole = _grown(docs, changed, fanout)
        top = whole.tops.select("grp", F.col("top").alias("root"), F.array().cast("array<struct<before: string, after: string>>").alias("path"), F.lit("").alias("rest"))
        above = down(whole, top, ["source"]).select(F.col("source").alias("grp"), F.col("digest").alias("subroot"), "root", "path", "rest")
        rows = down(forest, materialize(above, "above"), ["doc_id", "changed"])
        rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2("rest", 256).alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
        out = materialize(rows.withColumn("verified", F.col("folded_root") == F.col("root")), "verified")
        hand_on(written.pop())
    return out
