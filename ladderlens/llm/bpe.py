"""Byte-level BPE encoding and decoding with overlapping chunks.

Every text is cut into chunks of ``chunk`` characters that overlap, and each
chunk is pre-tokenised on its own.  A chunk in the middle of a text may start
inside a pre-token, so its first boundaries can be wrong; but from the first
boundary that two neighbours share they agree for good, as where a pre-token
ends depends only on what follows its start.  The stitching step keeps each
chunk from that point on (and pre-tokenises on from the last sure boundary
where the overlap has none), and then the pieces are encoded.  Where a text has
several chunks, Spark deals them out over all tasks; the chunk of a text that
has one takes the same steps where it is.  Decoding concatenates the raw bytes
of the ids.

Defined results: a null text encodes as an empty one, to no ids.  Repeated
rows each get their own row.  Only the columns named in ``keep`` and the text
are read, so others may have any name.  A text is at most what a Spark string
can hold; one document's ids meet in one task, as its hash needs them in order.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ladderlens.llm.common import beside, each, named

CHUNK, OVERLAP = 1 << 15, 1 << 9
#: A boundary is sure if this many characters follow it: a contraction is looked up over three.
MARGIN = 4
CACHED = 1 << 17
#: Texts whose ids a task holds before it hands them on.
AT_ONCE = 256


class Codec:
    """Ranks of one vocabulary; pieces that come again are looked up."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.find = regex.compile(pattern)
        whole = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})  # one match: the piece

        class Known(dict):
            def __missing__(self, piece: str) -> str:
                if len(self) >= CACHED:
                    self.clear()
                out = self[piece] = " ".join(map(str, whole.encode_ordinary(piece)))
                return out

        self.known = Known()

    def encode_pieces(self, pieces: list[str]) -> str:
        """Decimal ids of all pieces, with one space between."""
        return " ".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


@lru_cache(maxsize=1)
def codec_of(ranks_file: bytes, pattern: str) -> Codec:
    """One codec for all batches and groups of a Python worker."""
    return Codec(ranks_file, pattern)


def boundaries(find: regex.Pattern, text: str) -> np.ndarray:
    """Starts of the pre-tokens of text; they cover it without gaps."""
    return np.fromiter((m.start() for m in find.finditer(text)), np.int64)


def stitch(find: regex.Pattern, text: str, starts: list[np.ndarray], chunk: int, overlap: int) -> np.ndarray:
    """Starts of the pre-tokens of the whole text from those of its chunks."""
    out: list[np.ndarray] = []
    c, entry, last = 0, 0, len(starts) - 1
    while c < last:
        own = starts[c][starts[c] >= entry]
        sure = own[own <= min(len(text), (c + 1) * chunk + overlap) - MARGIN]
        both = np.intersect1d(sure, starts[c + 1], assume_unique=True)
        if len(both):
            out.append(sure[sure < both[0]])
            c, entry = c + 1, int(both[0])
            continue
        # no shared boundary: go on from the last sure one until a later chunk agrees
        out.append(sure[:-1])
        found: list[int] = []
        for m in find.finditer(text, int(sure[-1]) if len(sure) else entry):
            k = min(max(m.start() // chunk, c + 1), last)
            i = np.searchsorted(starts[k], m.start())
            if i < len(starts[k]) and starts[k][i] == m.start():
                c, entry = k, m.start()
                break
            found.append(m.start())
        else:
            return np.concatenate([*out, found]).astype(np.int64)
        out.append(np.array(found, np.int64))
    own = starts[last] if starts else np.zeros(0, np.int64)
    return np.concatenate([*out, own[own >= entry]])


def digest_nothing(codec: Codec, ids: str) -> dict:
    return {"ids": [int(x) for x in ids.split()]}


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    keep: list[str],
    derive: Callable[[Codec, str], dict] = digest_nothing,
    derived: str = "ids array<int>",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The columns in keep and what derive makes of the ids (by default, the ids).

    derive gets the codec and the decimal ids joined by a space; derived is the
    schema of what it returns.  ranks_path is read by the driver; the file, of
    about a megabyte, goes to the tasks.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    made = StructType.fromDDL(derived)

    def ids_of(codec: Codec, parts: list[str], starts: list[np.ndarray]) -> str:
        text = "".join(p[:chunk] for p in parts)
        edges = [*stitch(codec.find, text, starts, chunk, overlap).tolist(), len(text)]
        return codec.encode_pieces([text[a:b] for a, b in zip(edges, edges[1:])])  # noqa: B905

    def here():
        codec = codec_of(*shared.value)

        def of(columns: list[pa.Array]):
            rows = [derive(codec, ids_of(codec, [t], [boundaries(codec.find, t)])) for t in each(columns[0])]
            return {f.name: [r[f.name] for r in rows] for f in made}, None

        return of

    def cut(columns: list[pa.Array]):
        chunks = [(row, at // chunk, text[at : at + chunk + overlap]) for row, text in enumerate(each(columns[0])) for at in range(0, len(text), chunk)]
        return {"_no": [no for _, no, _ in chunks], "_body": [body for *_, body in chunks]}, [row for row, *_ in chunks]

    def split():
        find = regex.compile(shared.value[1])
        return lambda columns: ({"_starts": [boundaries(find, b).astype(np.int32).tobytes() for b in each(columns[0])]}, None)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        codec = codec_of(*shared.value)
        parts = frame.sort_values("_no")
        starts = [np.frombuffer(s, np.int32) + n * chunk for s, n in zip(parts["_starts"], parts["_no"].tolist(), strict=True)]
        row = derive(codec, ids_of(codec, list(parts["_body"]), starts))
        return pd.concat([parts[[*names, "_rows"]].head(1).reset_index(drop=True), pd.DataFrame([row])], axis=1)

    names = [f"_k{i}" for i in range(len(keep))]  # any name may come; those of groups may have no backtick
    docs = docs.select(*(named(c).alias(k) for c, k in zip(keep, names, strict=True)), F.coalesce("text", F.lit("")).alias("_text"))
    size = F.char_length("_text")
    short = beside(docs.where(size <= chunk), names, ["_text"], made, here, AT_ONCE)
    long = docs.where(size > chunk).withColumn("_h1", F.xxhash64("_text")).withColumn("_h2", F.xxhash64("_text", F.lit(1)))
    # equal rows, which Spark counts before the shuffle, are one text from here on
    plain = [k for c, k in zip(keep, names, strict=True) if c != "text"]
    chunks = beside(long, [*names, "_h1", "_h2"], ["_text"], "_no int, _body string", lambda: cut, AT_ONCE)
    chunks = chunks.groupBy(*names, "_h1", "_h2", "_no").agg(F.first("_body").alias("_body"), F.count("*").alias("_rows"))
    pieces = beside(chunks, chunks.columns, ["_body"], "_starts binary", split)
    whole = StructType([*(docs.schema[k] for k in names), StructField("_rows", LongType()), *made])
    found = pieces.groupBy(*plain, "_h1", "_h2").applyInPandas(join, whole)  # a group has one value of each kept column
    copies = found.withColumn("_row", F.explode(F.sequence(F.lit(1), "_rows"))).drop("_row", "_rows")
    return short.unionByName(copies).toDF(*keep, *made.names)
