"""Suffix-array dedup over run-length compressed indexes.

A byte is removed if a string of ``length`` bytes around it also starts
earlier: in a document with a smaller doc_id, or earlier in the same one.

What is removed is decided by matching statistics alone (``resolve``): texts
that come first are indexed by a run-compressed Burrows-Wheeler transform with
samples at both ends of each run, later ones are streamed against the index,
and where the longest match is ``length`` bytes or more, the window is marked.
Hashes only choose which texts meet:

1. Each window of ``length`` bytes has an anchor: its least-hashed ``GRAM``
   bytes.  Neighbouring windows with the same anchor are a run.  Equal windows
   have equal anchors, so a window can only match one of a run with its anchor.
2. A task resolves the runs of its own documents that share an anchor, so that
   copies are gone before the shuffle.  Of windows without a mark it sends
   where they are, packed by anchor.
3. Runs whose anchor came from several places are read again, meet by anchor in
   buckets, and are resolved there.
4. Marks meet the texts by document.

An anchor with too large a share of all runs would gather in one task; such
anchors are found first (each task reports those with a large share of its own
runs, of which there can be few), and what is left of their runs is dealt by
whole windows.

Defined results: a null text counts as empty.  Rows that share both doc_id and
text are one document and all get its result; rows that share a doc_id alone
are ordered by a hash of the text; null ids come last.  An id of another type
than integers counts by its place in the order of all ids.  Texts of any length
are searched whole, and an empty table gives no rows; the spans of a document
meet in its row, as what is kept of it does.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ladderlens.llm.common import beside, materialize

GRAM = 24
#: Bytes of text that are anchored at once; positions within take 20 bits.
BLOCK = 1 << 16
LOW = np.uint64((1 << 20) - 1)
#: Entries that a task holds before it sends them.
HELD = 400_000
#: Text for each bucket of steps 2 and 3, and for the indexes that are made at once.
BUCKET_BYTES, BATCH_BYTES = 8 << 20, 8 << 20
#: An anchor with this share of all runs is dealt by windows.
HOT_SHARE, HOT_LEAST = 1 / 2000, 500

#: A run: anchor, document (d and h), first window, number of windows (or of marked bytes).
RUN = np.dtype([("a", "<u8"), ("d", "<i8"), ("h", "<i8"), ("p", "<u4"), ("n", "<u4")])
KEY = ["d", "h"]
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position."""
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    h = words[:-16] * MIX[0]
    for k in (1, 2):
        h ^= h >> np.uint64(29)
        h += words[8 * k : len(words) - 16 + 8 * k] * MIX[k]
    h ^= h >> np.uint64(32)
    h *= MIX[3]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of a block of texts.

    starts and ends are those of the texts in data; no window crosses them.
    """
    count = len(data) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    grams, width = length - GRAM + 1, 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: width - grams], least[grams - width :])
    inside = np.zeros(count + 1, np.int32)
    fit = ends - starts >= length
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(window):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = (least[window] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    return window[first], np.diff(np.append(first, len(window))), h[at[first]]


def blocks(frame: pd.DataFrame, length: int, size: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, row in the batch, offset in the document) of the texts of a batch, cut into blocks."""
    parts, rows, offsets, total = [], [], [], 0

    def made():
        ends = np.cumsum([len(p) for p in parts])
        return b"".join(parts), ends - [len(p) for p in parts], ends, np.array(rows, np.int64), np.array(offsets, np.int64)

    for row, text in enumerate(frame["data"]):
        for at in range(0, max(1, len(text) - length + 1), size):
            part = text[at : at + size + length - 1]
            if len(part) < length:
                continue
            if total + len(part) > size and parts:
                yield made()
                parts, rows, offsets, total = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(at)
            total += len(part)
    if parts:
        yield made()


def _report_hot(length: int, block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some = 0, np.zeros((0, 2), np.uint64)

        def thin(rows: np.ndarray, floor: float) -> np.ndarray:
            value, at = np.unique(rows[:, 0], return_inverse=True)
            n = np.bincount(at, weights=rows[:, 1].astype(np.float64)).astype(np.uint64)
            return np.stack([value, n], axis=1)[n >= floor]

        pending, held = [some], 0
        for frame in frames:
            for data, starts, ends, _, _ in blocks(frame, length, block):
                a = anchors(np.frombuffer(data, np.uint8), starts, ends, length)[2]
                total += len(a)
                pending.append(np.stack([a, np.ones(len(a), np.uint64)], axis=1))
                held += len(a)
                if held >= HELD:  # what is left out each time has a small share of what was seen
                    pending, held = [thin(np.concatenate(pending), HOT_SHARE / 4 * held)], 0
        hot = thin(np.concatenate(pending), HOT_SHARE / 2 * total)
        yield pd.DataFrame({"a": hot[:, 0].view(np.int64) if len(hot) else [], "n": hot[:, 1].astype(np.int64), "total": 0}).astype("int64")
        yield pd.DataFrame({"a": [0], "n": [0], "total": [total]})

    return run


def bucket_of(a: np.ndarray, buckets: int) -> np.ndarray:
    return (((a * MIX[0]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def merged(rows: np.ndarray) -> np.ndarray:
    """Marks (RUN, of n bytes from p on), those that touch or overlap made one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["p"], rows["h"], rows["d"]))]
    new = np.concatenate([[True], (rows["d"][1:] != rows["d"][:-1]) | (rows["h"][1:] != rows["h"][:-1])])
    s, e = rows["p"].astype(np.int64), rows["p"].astype(np.int64) + rows["n"]
    group = np.cumsum(new)
    big = int(e.max()) + 1
    reach = np.maximum.accumulate(e + group * big) - group * big  # furthest end so far within a document
    head = np.flatnonzero(new | np.concatenate([[False], s[1:] > reach[:-1]]))
    out = rows[head].copy()
    out["n"] = np.append(reach[head[1:] - 1], reach[-1]) - s[head]
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with samples at the first and last place of each run.

    Each text has a tag, which is a part of all its letters: texts with
    different tags have none in common.
    """

    def __init__(self, texts: list[bytes], tags: np.ndarray) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        count, n = len(texts), int(sizes.sum()) + len(texts)
        ends = np.cumsum(sizes + 1) - 1  # where each text's end mark is
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        which = np.repeat(np.arange(count), sizes + 1)
        left = ends[which] - np.arange(n)  # bytes to the end mark
        tag = np.asarray(tags, np.int64)[which]
        order = self._suffix_order(data, tag, which, left, count)
        whole = np.concatenate([[True], which[1:] != which[:-1]])
        letters = tag << 8 | data
        letter = np.where(whole, -1, np.roll(letters, 1))[order]  # the letter before, or -1 for a whole text
        head = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
        last = np.append(head[1:], n) - 1
        self.start, self.last, self.letter = head, last, letter[head]
        self.run = np.repeat(np.arange(len(head), dtype=np.int32), last - head + 1)  # the run of each place
        self.at_start, self.at_last = order[head], order[last]  # the samples: places in the texts
        self.data, self.left = np.concatenate([data, np.zeros(16, np.uint8)]), left
        # LF: suffixes that start with a letter follow the end marks and all smaller letters, in the order of the runs
        size = last - head + 1
        by = np.argsort(self.letter, kind="stable")
        marks = int((self.letter < 0).sum())
        before = np.cumsum(size[by]) - size[by]
        self.base = np.empty(len(head), np.int64)
        self.base[by] = before - before[marks] + count if marks < len(by) else 0
        self.by_letter = self.letter[by] * (len(head) + 1) + by  # runs by letter, then place

    @staticmethod
    def _suffix_order(data: np.ndarray, tag: np.ndarray, which: np.ndarray, left: np.ndarray, count: int) -> np.ndarray:
        """Places in the order of their suffixes; an end mark is below all letters, and marks are in the order of texts.

        By prefix doubling: as many bytes as a number holds come first, then only
        suffixes that still have equals are sorted again.  The rank of a suffix
        is the first slot of its equals.
        """
        n, used = len(data), np.bincount(data[left > 0], minlength=256) > 0
        code = np.cumsum(used)  # 1 and up, in the order of bytes
        bits = int(code[-1]).bit_length()
        known = max(1, (62 - int(tag.max(initial=0)).bit_length()) // max(1, bits))
        padded = np.concatenate([np.where(left > 0, code[data], 0), np.zeros(known, np.int64)])
        key, inside = tag.copy(), np.ones(n, bool)
        for i in range(known):
            inside &= left > i
            key = (key << bits) | np.where(inside, padded[i : i + n], 0)
        key[left == 0] = 0
        slots, rank = np.arange(n), np.empty(n, np.int64)
        order = at = np.argsort(key)
        key = key[at]
        while True:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            rank[at] = np.repeat(slots[first], size)
            slots = slots[np.repeat(size > 1, size)]
            if not len(slots):
                return order
            at = order[slots]
            key = rank[at] * (n + count) + np.where(left[at] >= known, rank[np.minimum(at + known, n - 1)] + count, which[at])
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[slots] = at
            known *= 2

    def matches(self, texts: list[bytes], tags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, offset) of each place of texts at which a string of ``length`` bytes of the index starts.

        All texts are streamed backwards at once, one byte a step, with the
        longest match of what has been read.  If a run's letter goes on with
        the match, LF follows it.  Else the match goes over to the last place
        of the run with that letter before, or the first one of the run after,
        whose sample shares more bytes with the text.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        q = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(16, np.uint8)])
        high = np.asarray(tags, np.int64) << 8
        text = np.argsort(-sizes, kind="stable")
        descending = -sizes[text]
        at, matched, runs, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), len(self.start), []
        for done in range(int(sizes.max(initial=0))):
            go = int(np.searchsorted(descending, -done, side="left"))
            text, at, matched, descending = text[:go], at[:go], matched[:go], descending[:go]
            if not go:
                break
            here = begin[text] + sizes[text] - 1 - done
            c = high[text] | q[here]
            run = self.run[at]
            off = np.flatnonzero(self.letter[run] != c)
            if len(off):
                place = np.searchsorted(self.by_letter, c[off] * (runs + 1) + run[off])
                best, share = np.full(len(off), -1, np.int64), np.full(len(off), -1, np.int64)
                for step, sample, edge in ((-1, self.at_last, self.last), (0, self.at_start, self.start)):
                    near = place + step
                    own = self.by_letter[np.clip(near, 0, runs - 1)]
                    ok = (near >= 0) & (near < runs) & (own // (runs + 1) == c[off])
                    k = own[ok] % (runs + 1)
                    common = self._common(q, here[off[ok]] + 1, sample[k], matched[off[ok]])
                    better = common > share[ok]
                    rows = np.flatnonzero(ok)[better]
                    share[rows], best[rows] = common[better], edge[k[better]]
                at[off], matched[off] = np.maximum(best, 0), share  # a share of -1: the letter is nowhere
                run[off] = self.run[at[off]]
            lost = matched < 0
            at = np.where(lost, 0, self.base[run] + at - self.start[run])
            matched = np.where(lost, 0, matched + 1)
            hit = np.flatnonzero(matched >= length)
            if len(hit):
                found.append(np.stack([text[hit], sizes[text[hit]] - 1 - done]))
            if done % 8 == 7:  # texts of which too little is left for a match of that length are over
                live = np.flatnonzero(matched + sizes[text] - 1 - done >= length)
                text, at, matched, descending = text[live], at[live], matched[live], descending[live]
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def _common(self, q: np.ndarray, here: np.ndarray, sample: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that q has from here on in common with the index's texts from a sample on, most at most."""
        most = np.minimum(most, self.left[sample])
        out, todo, step = np.zeros(len(here), np.int64), np.arange(len(here)), np.arange(16)
        while len(todo):
            same = q[(here[todo] + out[todo])[:, None] + step] == self.data[(sample[todo] + out[todo])[:, None] + step]
            run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
            out[todo] += run
            todo = todo[(run == 16) & (out[todo] < most[todo])]
        return np.minimum(out, most)


class Resolved(NamedTuple):
    """Runs in order, for each the one that was given, and for each of their windows, one run after the other, whether it has a mark."""

    rows: np.ndarray
    source: np.ndarray
    marked: np.ndarray

    def stretches(self, marked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, first window within it, windows) of each stretch of a run whose windows all have a mark, or all have none."""
        n = self.rows["n"].astype(np.int64)
        begin = np.cumsum(n) - n
        run = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(self.marked == marked)
        new = np.concatenate([[True], (run[at][1:] != run[at][:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return run[at[first]], at[first] - begin[run[at[first]]], np.diff(np.append(first, len(at)))

    def marks(self, length: int) -> np.ndarray:
        """Spans of marked bytes (RUN)."""
        run, skip, n = self.stretches(True)
        out = self.rows[run].copy()
        out["p"] += skip.astype(np.uint32)
        out["n"] = n + length - 1
        return out

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the windows without a mark, and for each the given one that it is of."""
        run, skip, n = self.stretches(False)
        out = self.rows[run].copy()
        out["p"] += skip.astype(np.uint32)
        out["n"] = n
        return out, self.source[run]


def resolve(rows: np.ndarray, texts: list[bytes], length: int) -> Resolved:
    """Which windows of runs an earlier run with the same anchor has too.

    texts are the bytes of the runs.  Runs that have the same bytes are one text
    with several places, each of which but the first repeats it whole.  The
    texts of an anchor, in the order of their first places, are halved again and
    again: the first half is indexed, the second is streamed against it, and
    both are halved.  As other anchors can't match, and tags keep the halves of
    one anchor apart, each halving takes a single index.
    """
    order = np.lexsort((rows["p"], rows["h"], rows["d"], rows["a"]))
    rows, texts = rows[order], [texts[i] for i in order.tolist()]
    rows, texts, kept = _once(rows, texts)
    size = np.cumsum([len(t) for t in texts])
    cuts, sent = [0], 0
    for head in (np.flatnonzero(rows["a"][1:] != rows["a"][:-1]) + 1).tolist():
        if size[head - 1] - sent >= BATCH_BYTES:
            cuts.append(head)
            sent = size[head - 1]
    cuts.append(len(rows))
    flags = [_marked(rows[a:b], texts[a:b], length) for a, b in zip(cuts, cuts[1:]) if b > a]  # noqa: B905
    return Resolved(rows, order[kept], np.concatenate(flags) if flags else np.zeros(0, bool))


def _once(rows: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Sorted runs without windows that a row before has of the same document (as repeated rows do), and which are left."""
    whole = np.arange(len(rows))
    same = np.zeros(len(rows), bool)
    same[1:] = (rows["a"][1:] == rows["a"][:-1]) & (rows["d"][1:] == rows["d"][:-1]) & (rows["h"][1:] == rows["h"][:-1])
    if not same.any():
        return rows, texts, whole
    e = rows["p"].astype(np.int64) + rows["n"]
    group, big = np.cumsum(~same), int(e.max()) + 1
    reach = np.maximum.accumulate(e + group * big) - group * big
    cut = np.where(same, np.clip(np.append(0, reach[:-1]) - rows["p"].astype(np.int64), 0, rows["n"].astype(np.int64)), 0)
    rows = rows.copy()
    rows["p"] += cut.astype(np.uint32)
    rows["n"] -= cut.astype(np.uint32)
    keep = np.flatnonzero(rows["n"] > 0)
    return rows[keep], [texts[i][cut[i] :] for i in keep.tolist()], keep


def _marked(rows: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """For each window of sorted runs, whether an earlier run with the same anchor has it."""
    boxed = np.empty(len(texts), object)
    boxed[:] = texts
    code = pd.factorize(boxed)[0]  # by the bytes themselves
    first = np.unique(code, return_index=True)[1]  # of each text, its first run
    anchor = rows["a"][first]
    by = np.lexsort((first, anchor))
    head = np.concatenate([[True], anchor[by][1:] != anchor[by][:-1]])
    begin = np.flatnonzero(head)
    place = np.empty(len(first), np.int64)  # of each text among those of its anchor
    place[by] = np.arange(len(by)) - begin[np.cumsum(head) - 1]
    many = np.diff(np.append(begin, len(by)))
    group = np.empty(len(first), np.int64)
    group[by] = np.cumsum(head) - 1
    windows = rows["n"][first].astype(np.int64)
    base = np.cumsum(windows) - windows
    marked = np.zeros(int(windows.sum()), bool)  # of each window of each text
    of_text = np.repeat(np.arange(len(windows)), windows)
    for level in range(int(many.max() - 1).bit_length()):
        half = place >> level
        tag, block = half >> 1, group * (len(place) + 1) + (half >> 1)
        left = np.bincount(of_text[~marked], minlength=len(windows)) > 0
        later = np.flatnonzero((half & 1 == 1) & left)
        indexed = np.flatnonzero((half & 1 == 0) & left & np.isin(block, block[later]))
        if not len(indexed):
            continue
        index = RunLengthIndex([texts[first[i]] for i in indexed.tolist()], tag[indexed])
        t, at = index.matches([texts[first[i]] for i in later.tolist()], tag[later], length)
        marked[base[later[t]] + at] = True
    n = windows[code]
    at = np.repeat(base[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    again = np.ones(len(rows), bool)
    again[first] = False
    return marked[at] | np.repeat(again, n)


def _packed(rows: np.ndarray, bucket: np.ndarray, kind: int) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    value, head = np.unique(bucket, return_index=True)
    return pd.DataFrame({"bucket": value.astype(np.int64), "kind": kind, "rows": [x.tobytes() for x in np.split(rows, head[1:])] if len(value) else []})


def shared(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    return count[at] > 1


def _send_runs(length: int, buckets: int, hot: np.ndarray, block: int):
    """Step 2, for the documents of a task: marks (kind 1), and runs without a mark (kind 0)."""

    def flush(held: list[tuple[np.ndarray, bytes, np.ndarray]]) -> Iterator[pd.DataFrame]:
        rows = np.concatenate([r for r, _, _ in held])
        block_of = np.repeat(np.arange(len(held)), [len(r) for r, _, _ in held])
        start = np.concatenate([s for _, _, s in held])

        def text(i: int, skip: int = 0, n: int = 0) -> bytes:
            a = int(start[i]) + skip
            return held[block_of[i]][1][a : a + (n or int(rows["n"][i])) + length - 1]

        often = np.flatnonzero(shared(rows["a"]))
        own = resolve(rows[often], [text(i) for i in often.tolist()], length)
        some, of = own.rest()
        other = np.flatnonzero(~np.isin(np.arange(len(rows)), often))
        left, source = np.concatenate([rows[other], some]), np.concatenate([other, often[of]])
        split = np.flatnonzero(np.isin(left["a"], hot))
        if len(split):  # each window is a run of its own
            n = left["n"][split].astype(np.int64)
            window = np.repeat(left[split], n)
            window["p"] += (np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32)
            window["n"] = 1
            skip = window["p"].astype(np.int64) - rows["p"][np.repeat(source[split], n)]
            window["a"] = [xxhash.xxh3_64_intdigest(text(i, k, 1), 1) for i, k in zip(np.repeat(source[split], n).tolist(), skip.tolist(), strict=True)]
            left = np.concatenate([np.delete(left, split), window])
        yield _packed(left, bucket_of(left["a"], buckets), 0)
        marks = merged(own.marks(length))
        yield _packed(marks, bucket_of(marks["d"].view(np.uint64) * MIX[1] if len(marks) else marks["a"], buckets), 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            d, h = frame["d"].to_numpy(np.int64), frame["h"].to_numpy(np.int64)
            for data, starts, ends, numbers, offsets in blocks(frame, length, block):
                at, size, a = anchors(np.frombuffer(data, np.uint8), starts, ends, length)
                rows = np.zeros(len(at), RUN)
                of = np.searchsorted(ends, at, side="right")
                rows["a"], rows["n"], rows["d"], rows["h"], rows["p"] = a, size, d[numbers[of]], h[numbers[of]], at - starts[of] + offsets[of]
                held.append((rows, data, at))
                n += len(rows)
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _as_frame(rows: np.ndarray, kind: str) -> pd.DataFrame:
    own = {"d": rows["d"], "h": rows["h"], "s": rows["p"].astype(np.int64), "n": rows["n"].astype(np.int64)}
    return pd.DataFrame(own | ({"a": rows["a"].view(np.int64) if len(rows) else []} if kind == "run" else {})).astype("int64")


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """For a bucket: marks (a is null), and the runs that share an anchor."""
    read = lambda kind: np.frombuffer(b"".join(frame["rows"][frame["kind"] == kind]), RUN)
    rows, marks = read(0), merged(read(1))
    met = _as_frame(rows[shared(rows["a"])], "run")
    return pd.concat([met, _as_frame(marks, "mark").assign(a=None)]).astype({"a": "Int64"})


def _read_texts(length: int, buckets: int):
    """The runs that meet, with their bytes, packed by bucket; of equal ones of a batch the bytes go once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            count = frame["s"].map(len).to_numpy()
            rows = np.zeros(int(count.sum()), RUN)
            if not len(rows):
                continue
            rows["d"], rows["h"] = np.repeat(frame["d"].to_numpy(np.int64), count), np.repeat(frame["h"].to_numpy(np.int64), count)
            rows["p"], rows["n"], rows["a"] = np.concatenate(list(frame["s"])), np.concatenate(list(frame["n"])), np.concatenate(list(frame["a"])).astype(np.int64).view(np.uint64)
            boxed = np.empty(len(rows), object)
            boxed[:] = [data[a : a + n + length - 1] for data, s, m in zip(frame["data"], frame["s"], frame["n"], strict=True) for a, n in zip(s.tolist(), m.tolist(), strict=True)]
            code, texts = pd.factorize(boxed)
            bucket = bucket_of(rows["a"], buckets)
            order = np.lexsort((code, bucket))
            rows, code, bucket = rows[order], code[order], bucket[order]
            head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = []
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(rows)], strict=True):
                own, which = np.unique(code[a:b], return_inverse=True)
                parts = [texts[i] for i in own.tolist()]
                out.append((int(bucket[a]), rows[a:b].tobytes(), which.astype(np.int32).tobytes(), np.array([len(x) for x in parts], np.int32).tobytes(), b"".join(parts)))
            yield pd.DataFrame(out, columns=["bucket", "rows", "which", "sizes", "texts"])

    return run


def _match(length: int):
    """Step 3, for a bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, texts = np.frombuffer(b"".join(frame["rows"]), RUN), []
        for which, sizes, joined in zip(frame["which"], frame["sizes"], frame["texts"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            own = [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            texts += [own[i] for i in np.frombuffer(which, np.int32).tolist()]
        return _as_frame(merged(resolve(rows, texts, length).marks(length)), "mark")

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d and h (longs, in the order of documents and equal only for equal rows) and data (the bytes of the text)."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("data"))
    docs = docs.withColumn("h", F.xxhash64("data"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct().orderBy("id").withColumn("d", F.monotonically_increasing_id())
    return docs.join(materialize(ids, "ids"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "data", "h", F.coalesce("d", F.lit((1 << 63) - 1)).alias("d"))


def marks(docs: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(d, h, s, n): spans of n removed bytes, which may touch or overlap, from keyed documents."""
    texts = docs.select(*KEY, "data").where(F.octet_length("data") >= length)
    buckets = max(8, (texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // BUCKET_BYTES)
    seen = texts.mapInPandas(_report_hot(length, block), "a long, n long, total long").groupBy("a").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    seen = materialize(seen, "anchors")
    total = seen.agg(F.sum("total")).first()[0] or 0
    floor = max(HOT_LEAST, HOT_SHARE / 2 * total)  # so 2 / HOT_SHARE anchors at most
    hot = np.array([r["a"] for r in seen.where(F.col("n") >= floor).select("a").collect()], np.int64).view(np.uint64)
    sent = texts.mapInPandas(_send_runs(length, buckets, hot, block), "bucket long, kind int, rows binary")
    met = materialize(sent.groupBy("bucket").applyInPandas(_meet, "d long, h long, s long, n long, a long"), "runs")
    runs = met.where("a is not null").groupBy(*KEY).agg(F.collect_list(F.struct("s", "n", "a")).alias("runs"))
    read = texts.join(runs, KEY).select(*KEY, "data", "runs.s", "runs.n", "runs.a")
    read = read.mapInPandas(_read_texts(length, buckets), "bucket long, rows binary, which binary, sizes binary, texts binary")
    more = materialize(read.groupBy("bucket").applyInPandas(_match(length), "d long, h long, s long, n long"), "matches")
    return met.where("a is null").select(*KEY, "s", "n").unionByName(more)


def kept_text(data: bytes, spans: list[tuple[int, int]]) -> dict:
    cut = [0, *[x for span in spans for x in span], len(data)]
    return {"kept": b"".join(data[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)), "spans": [{"start": a, "end": b} for a, b in spans]}


def deduplicate(
    docs: DataFrame,
    length: int = 100,
    derive: Callable[[bytes, list[tuple[int, int]]], dict] = kept_text,
    derived: str = "kept binary, spans array<struct<start: long, end: long>>",
    block: int = BLOCK,
) -> DataFrame:
    """doc_id and what derive makes of each text and its removed spans (by default, the bytes kept and the spans).

    derive gets the bytes of the text and the maximal removed spans; derived is
    the schema of what it returns.
    """
    made = StructType.fromDDL(derived)
    docs = keyed(docs)
    spans = marks(docs, length, block).groupBy(*KEY).agg(F.collect_list(F.struct("s", "n")).alias("spans"))

    def of(columns: list[pa.Array]):
        out = []
        for data, s, n in zip(*columns, strict=True):
            rows = np.zeros(len(s) if s.is_valid else 0, RUN)
            if len(rows):
                rows["p"], rows["n"] = s.values.to_numpy(), n.values.to_numpy()
                rows = merged(rows)
            out.append(derive(data.as_py(), [(a, a + n) for a, n in zip(rows["p"].tolist(), rows["n"].tolist(), strict=True)]))
        return {f.name: [r[f.name] for r in out] for f in made}, None

    found = docs.join(spans, KEY, "left").select("doc_id", "data", "spans.s", "spans.n")
    return beside(found, ["doc_id"], ["data", "s", "n"], made, lambda: of)
