"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage of a text in
``floor(n * error_rate)`` edits.  It is split into one piece more than that:
at least one piece is then unchanged in the passage.  An automaton over the
pieces finds their exact hits in each whole text, and Myers' bit-parallel
algorithm computes the least edit distance of the item to any substring of the
text around the hit.  Items and texts are compared lower-cased and with runs
of white space as one blank; positions are in that form.

An item too short for an edit must be found unchanged, from one word boundary
to another.  Of several best matches in a text, the first counts.

The items are read in blocks of bounded size.  A block goes to the tasks, which
search all texts for it, and is dropped before the next one is sent, so neither
the driver nor a task ever holds more than a block.

Defined results: null and empty texts and items, and those of white space
alone, match nothing.  Items that occur twice give a row each.  Repeated
document rows give their rows again.  Texts of any length are searched whole.
No items, or no documents, give no matches.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ladderlens.llm.common import beside, each, materialize

#: Characters of items that go to the tasks at once.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def original_end(text: str, end: int) -> int:
    """Where the first ``end`` characters of the normal form of text end in text itself."""
    seen = 0
    for word in re.finditer(r"\S+", text):
        seen += 1 if seen else 0
        if seen >= end > 0:
            return word.start()
        for i, ch in enumerate(word[0], word.start() + 1):
            seen += len(ch.lower())
            if seen >= end:
                return i
    return len(text)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces that cover the item."""
    edges = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]  # noqa: B905


def distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of item to a substring of text, and where the first such substring ends."""
    n = len(item)
    if not n:
        return 0, 0
    at: dict[str, int] = {}
    for i, ch in enumerate(item):
        at[ch] = at.get(ch, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, ch in enumerate(text):
        eq = at.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more = down | (full & ~(diagonal | up))
        less = up & diagonal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1) & full, (less << 1) & full
        up = less | (full & ~((diagonal | down) | more))
        down = more & (diagonal | down)
        if score < best:
            best, end = score, j + 1
    return best, end


def at_words(text: str, a: int, b: int) -> bool:
    """Whether no word goes on past either end of text[a:b]."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


class Matcher:
    """The pieces of all items of a block."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items = [(key, text, int(len(text) * error_rate)) for key, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((k, offset))
        self.hits = ahocorasick.Automaton()
        for piece, places in where.items():
            self.hits.add_word(piece, (len(piece), places))
        if where:
            self.hits.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item key, edits, end of the match, edits allowed) for the best match of each item in a normal text."""
        if not self.items:
            return []
        found: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (size, places) in self.hits.iter(text):
            for k, offset in places:
                _, item, errors = self.items[k]
                if not errors:
                    if k not in found and at_words(text, last + 1 - size, last + 1):
                        found[k] = (0, last + 1)
                    continue
                start = last + 1 - size - offset  # where the item would start without edits
                slot = start // (errors + 1)  # near starts share a window
                if (k, slot) in seen or found.get(k, (1, 0))[0] == 0:
                    continue
                seen.add((k, slot))
                a = max(0, slot * (errors + 1) - errors)
                edits, end = distance(item, text[a : (slot + 1) * (errors + 1) + len(item) + errors])
                if edits <= errors and edits < found.get(k, (errors + 1, 0))[0]:
                    found[k] = (edits, a + end)
        return [(self.items[k][0], e, end, self.items[k][2]) for k, (e, end) in sorted(found.items())]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, block by block; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        block.append((row["item_id"], text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


#: The block that a Python worker has last seen, the error rate, and their matcher.
_last: list = [None, 0.0, None]


def matcher_of(block: list[tuple[int, str]], error_rate: float) -> Matcher:
    """One matcher for all tasks of a Python worker that search for a block."""
    if _last[0] is not block or _last[1] != error_rate:
        _last[:] = [block, error_rate, Matcher(block, error_rate)]
    return _last[2]


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row (doc_id, item_id, edits, allowed, match_end) for each item found in a document.

    match_end is where the best match ends in the text, in code points.
    """
    numbers = [StructField("edits", IntegerType()), StructField("allowed", IntegerType()), StructField("match_end", LongType())]
    found = StructType([StructField("item_id", items.schema["item_id"].dataType), *numbers])
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *found])
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    out, last = spark.createDataFrame([], schema), None
    for block in item_blocks(items, block_chars):
        if last is not None:
            out = materialize(out, "matches")
            last.destroy()
        last = spark.sparkContext.broadcast(block)  # block_chars and one item at most

        def start(shared=last):
            matcher = matcher_of(shared.value, error_rate)

            def derive(columns: list[pa.Array]):
                rows = [(i, key, edits, allowed, original_end(text, end)) for i, text in enumerate(each(columns[0])) for key, edits, end, allowed in matcher.matches(normal(text))]
                return {f.name: [r[k] for r in rows] for k, f in enumerate(found, 1)}, [r[0] for r in rows]

            return derive

        out = out.unionByName(beside(docs, ["doc_id"], ["text"], found, start))
    return out


def clean(docs: DataFrame, items: DataFrame, error_rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in whose text no item is found."""
    last = None
    for block in item_blocks(items, block_chars):
        if last is not None:
            docs = materialize(docs, "clean")
            last.destroy()
        last = docs.sparkSession.sparkContext.broadcast(block)  # block_chars and one item at most

        def start(shared=last):
            matcher = matcher_of(shared.value, error_rate)
            return lambda columns: ({}, [i for i, t in enumerate(each(columns[0])) if t is None or not matcher.matches(normal(t))])

        docs = beside(docs, docs.columns, ["text"], StructType([]), start)
    return docs
