"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; the n-grams are runs of 1 to 3 code points, hashed into
a fixed number of buckets.  Training sums a count for each language and bucket
in Spark, and the rows of each language, which give the priors.  The matrix of
log-probabilities has languages x buckets entries, whatever the size of the
input, and goes to the tasks with the scoring function.  A task gathers the
rows of that matrix for the n-grams of a batch of texts and adds them up within
each text.

Defined results: a null text, or one without a letter, is ``und`` with score
0.  Rows without a language don't train.  Without any training row all texts
are ``und``.  Equal posteriors go to the language that sorts first.  Texts of
any length count whole.  Repeated rows each get their own row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ladderlens.llm.common import beside

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")
#: Code points that are hashed at once, and numbers that are gathered at once.
PIECE, GATHERED = 1 << 20, 1 << 18
#: Multipliers of the hash: from one code point to the next, for the order of the n-gram, before and after the shift.
MIX = (0x01000193, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


class Model(NamedTuple):
    """Languages, their log-probabilities (buckets x languages) and log-priors."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a lower-cased text, in arrays of bounded size; n-grams go across the cuts between them."""
    over = max(ORDERS) - 1
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + over].encode("utf-32-le", "replace"), np.uint32)
        code = c
        for n in ORDERS:
            if n > 1:
                code = code[:-1] * np.uint32(MIX[0]) + c[n - 1 :]
            own = code[:PIECE]
            if not len(own):
                break
            mixed = (own + np.uint32(n * MIX[1] & 0xFFFFFFFF)) * np.uint32(MIX[2])
            mixed ^= mixed >> np.uint32(13)
            yield (mixed * np.uint32(MIX[3])) >> np.uint32(32 - BITS)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            if lang not in sums:
                sums[lang], rows[lang] = np.zeros(BUCKETS, np.int64), 0
            rows[lang] += 1
            for part in ngram_buckets(text.lower()):
                sums[lang] += np.bincount(part, minlength=BUCKETS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(total[at], rows[lang])})


def fit(rows: DataFrame, max_rows: int = 20_000, smoothing: float = 0.5) -> Model:
    """Learn from rows with ``text`` and ``lang``.

    At most about max_rows of them train, chosen by a hash of the text: a model
    of fixed size needs no more.
    """
    rows = rows.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = rows.count()
    if total > max_rows:
        share = int(max_rows / total * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < share)
    counted = rows.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # languages x (buckets + 1) rows at most
    langs = sorted(found["lang"].unique())
    seen = found[found["bucket"] < 0].set_index("lang")["n"].reindex(langs).to_numpy(np.float64)
    grams = found[found["bucket"] >= 0]
    counts = np.full((BUCKETS, len(langs)), smoothing)
    if langs:
        np.add.at(counts, (grams["bucket"].to_numpy(), pd.Categorical(grams["lang"], categories=langs).codes), grams["n"].to_numpy())
    return Model(langs, np.log(counts / counts.sum(axis=0)), np.log(seen / seen.sum()))


def log_posteriors(texts: list[str], model: Model) -> np.ndarray:
    """Log-probability of each text (lower-cased, not empty) and language, up to a constant for each text."""
    out = np.tile(model.prior, (len(texts), 1))
    parts: list[np.ndarray] = []
    owners: list[int] = []

    def add() -> None:
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        np.add.at(out, owners, np.add.reduceat(model.logp[np.concatenate(parts)], starts, axis=0))

    held = 0
    for i, text in enumerate(texts):
        for part in ngram_buckets(text):
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held * len(model.langs) >= GATHERED:
                add()
                parts.clear()
                owners.clear()
                held = 0
    if parts:
        add()
    return out


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, with the predicted language and its posterior under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def derive(columns: list[pa.Array]):
        langs, texts = shared.value.langs, columns[0].to_pylist()
        found, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        told = [i for i, t in enumerate(texts) if langs and t is not None and LETTER.search(t)]
        if told:
            logs = log_posteriors([texts[i].lower() for i in told], shared.value)
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            found[told] = np.array(langs, object)[p.argmax(axis=1)]
            scores[told] = p.max(axis=1) / p.sum(axis=1)
        return dict(zip(names, (found, scores), strict=True)), None

    made = StructType([StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return beside(docs, keep, ["text"], made, lambda: derive)
