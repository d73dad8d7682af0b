"""Toxicity: maximum-scoring segments of token log-odds, calibrated as extremes.

Tokens are runs of letters in lower case.  Learning counts in how many toxic
and other texts each token is.  A toxic text is counted by one context of the
token in it (the words beside it; that with the least hash), and each context
once, so that near copies and boilerplate don't add up to a toxic word.  A Dirichlet prior in
proportion to the counts of both kinds, of a PRIOR part of their size, gives
each token its log-odds and their standard error; tokens of LEAST_Z errors
above 0, and of log-odds of LEAST_ODDS, are significant.  All others score as
one kind of token, with the log-odds of what is left, which are below 0.  A text's segments of maximal score are found in one pass (Ruzzo and Tompa).

On other texts, segments of a score of x or more come about K n exp(-lambda x)
times in n tokens (Karlin and Altschul); lambda follows from the scores, K from
the training texts.  The best r normalized scores add up to a sum whose tail is
known; a text's evidence is minus the logarithm of the least such tail over r.
A logistic curve over it, fitted to the training texts, is the score.

Defined results: a null or empty text, or one without letters, has no evidence
and gets the score of that.  Without labels of both kinds, or without
significant tokens, every score is the share of label 1 (0 without labels).
Rows without a label don't train; a text trains once for each label that it
has, however many rows have both.  Repeated rows, and rows with null ids, get
their own scores; columns other than the text are never inputs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ladderlens.llm.common import beside, materialize, scope

TOKEN = re.compile(r"[^\W\d_]+")
#: Size of the prior as a part of all counts; errors above 0, and log-odds, that a token needs.
PRIOR, LEAST_Z, LEAST_ODDS = 0.05, 3.0, math.log(4)
#: Chance at which a passage by itself is significant.
ALPHA = 0.01
#: Evidence beyond this says no more.
MOST = 50.0


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)] if text else []


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All segments of maximal score, as (first token, last token, score).

    hits: place and score of the tokens above 0, in order; each token between
    scores drift, below 0.  Of the segments so far, ``left`` is the sum of all
    scores before one, ``right`` that up to its end, and ``link`` the nearest
    one before it whose left is less: only there can a segment be joined.
    """
    first: list[int] = []
    last: list[int] = []
    left: list[float] = []
    right: list[float] = []
    link: list[int] = []
    total, at = 0.0, 0
    for place, score in hits:
        total += (place - at) * drift
        a, lo, j = place, total, len(first) - 1
        total, at = total + score, place + 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= total:
                break
            a, lo = first[j], left[j]  # what lies between costs less than it brings
            before = link[j]
            for held in (first, last, left, right, link):
                del held[j:]
            j = before
        first.append(a)
        last.append(place)
        left.append(lo)
        right.append(total)
        link.append(j)
    return [(a, z, hi - lo) for a, z, lo, hi in zip(first, last, left, right, strict=True)]


@dataclass
class Model:
    """Scores of significant tokens and of all others, and the calibration."""

    table: dict[str, float] = field(default_factory=dict)
    drift: float = -1.0
    rate: float = 1.0  #: lambda
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    constant: float | None = 0.0

    def found(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """How many tokens a text has, and its segments."""
        own = tokens(text)
        return len(own), segments([(i, self.table[w]) for i, w in enumerate(own) if w in self.table], self.drift)

    def normal(self, n: int, score: float) -> float:
        return self.rate * score - self.log_k - math.log(max(n, 1))

    def evidence(self, n: int, scores: list[float]) -> float:
        """Minus the logarithm of the least tail of sums of the best scores; each further one halves what is claimed."""
        best, total = 0.0, 0.0
        for r, x in enumerate(sorted((self.normal(n, s) for s in scores), reverse=True), 1):
            total += x
            if r == 1:
                tail = x + math.exp(-x) / 2 if x > 5 else -math.log(-math.expm1(-math.exp(-max(x, -700.0))))
            else:
                tail = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) if total > r - 1 else 0.0
            best = max(best, tail - r * math.log(2))
            if x <= 0:
                break
        return min(best, MOST)

    def score(self, evidence: float) -> float:
        return self.constant if self.constant is not None else 1 / (1 + math.exp(-(self.slope * evidence + self.offset)))


def sample(docs: DataFrame, labels: DataFrame, max_texts: int) -> DataFrame:
    """(text, toxic): about max_texts of the distinct pairs at most, chosen by a hash.

    Only hashes of texts meet their labels; the few chosen ones go to the
    texts, so that the others are not shuffled.
    """
    hashed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text", F.lit(3)).alias("h1"), F.xxhash64("text", F.lit(4)).alias("h2"))
    own = labels.where("toxic is not null").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic")).distinct()
    pairs = materialize(hashed.select("doc_id", "h1", "h2").distinct().join(own, "doc_id").select("h1", "h2", "toxic").distinct(), "labelled")
    share = min(1.0, max_texts / max(1, pairs.count()))
    few = pairs.where(F.pmod("h1", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = hashed.join(F.broadcast(few), ["h1", "h2"])  # about max_texts rows
    return rows.groupBy("h1", "h2", "toxic").agg(F.first("text").alias("text")).select("text", "toxic")


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, context) of each token of a text, once a batch."""
    known: dict[str, int] = {}
    for frame in frames:
        parts = []
        for text in frame["text"]:
            own = tokens(text)
            if own:
                codes = np.array([known.get(w) or known.setdefault(w, zlib.crc32(w.encode("utf-8", "replace"))) for w in own], np.uint64)
                beside_ = np.append(np.uint64(0), codes[:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ np.append(codes[1:], np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F)
                least: dict[str, int] = {}
                for word, context in zip(own, (beside_ * np.uint64(0xFF51AFD7ED558CCD) ^ codes).view(np.int64).tolist(), strict=True):
                    if context < least.get(word, 1 << 63):
                        least[word] = context
                parts.append(pd.DataFrame({"word": list(least), "context": list(least.values())}))
        if parts:
            yield pd.concat(parts).drop_duplicates()
        known.clear()


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, y0): texts of a batch that have a token."""
    for frame in frames:
        seen = Counter(w for text in frame["text"] for w in set(tokens(text)))
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "y0": pd.Series(list(seen.values()), dtype="int64")})


def learn(texts: DataFrame) -> Model:
    """Significant tokens of (text, toxic), their scores, and what all others score."""
    with scope(texts.sparkSession):
        own = texts.where("toxic = 1").mapInPandas(_contexts, "word string, context long").distinct().select("word", F.lit(1).alias("y1"), F.lit(0).cast("long").alias("y0"))
        others = texts.where("toxic = 0").mapInPandas(_counted, "word string, y0 long").select("word", F.lit(0).alias("y1"), "y0")
        counts = materialize(own.unionByName(others).groupBy("word").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), "words")
        n1, n0 = counts.agg(F.sum("y1"), F.sum("y0")).first()
        if not n1 or not n0:
            return Model()
        prior = (F.col("y1") + F.col("y0")) * PRIOR
        size = (n1 + n0) * PRIOR
        odds = lambda y, n: F.log((y + prior) / (n + size - y - prior))
        error = F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
        scored = counts.withColumn("score", odds(F.col("y1"), n1) - odds(F.col("y0"), n0)).where((F.col("score") >= LEAST_Z * error) & (F.col("score") >= LEAST_ODDS))
        kept = scored.orderBy("word").collect()  # each is in several toxic texts of a bounded sample
    q, p = (sum(r[y] + (r["y1"] + r["y0"]) * PRIOR for r in kept) / (n + size) for y, n in (("y1", n1), ("y0", n0)))
    model = Model({r["word"]: r["score"] for r in kept}, math.log((1 - q) / (1 - p)) if kept and q < 1 else -1.0)
    chance = [(r["y0"] + (r["y1"] + r["y0"]) * PRIOR) / (n0 + size) for r in kept]
    model.rate = tail_rate([r["score"] for r in kept], chance, model.drift)
    return model


def tail_rate(scores: list[float], chance: list[float], drift: float) -> float:
    """lambda: where the mean of exp(lambda * score) over tokens of other texts is 1."""
    rest = 1 - sum(chance)

    def over(x: float) -> bool:
        return sum(c * math.exp(min(x * s, 700.0)) for s, c in zip(scores, chance, strict=True)) + rest * math.exp(x * drift) > 1

    low, high = 0.0, 1.0
    while scores and not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        low, high = (low, (low + high) / 2) if over((low + high) / 2) else ((low + high) / 2, high)
    return high if scores else 1.0


def calibrate(model: Model, rows: list[tuple[int, int, list[float]]]) -> Model:
    """K from the texts without the label, and the curve from all; rows are (toxic, tokens, scores)."""
    ones = sum(r[0] for r in rows)
    model.constant = ones / len(rows) if rows else 0.0
    clean = [r for r in rows if not r[0]]
    if not model.table or not ones or not clean:
        return model
    least = min(model.table.values())
    seen = max(1, sum(s >= least for r in clean for s in r[2]))
    model.log_k = math.log(seen / max(1, sum(r[1] for r in clean))) + model.rate * least
    x = np.array([model.evidence(n, scores) for _, n, scores in rows])
    toxic = np.array([r[0] for r in rows], bool)
    goal = np.where(toxic, (ones + 1) / (ones + 2), 1 / (len(clean) + 2))  # as if each kind had one more
    w, design = np.array([0.0, math.log((ones + 1) / (len(clean) + 1))]), np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        y = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        pull = np.array([1e-3, 0.0])
        step = np.linalg.solve((design * (y * (1 - y))[:, None]).T @ design + np.diag(pull) + 1e-9 * np.eye(2), design.T @ (y - goal) + pull * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset, model.constant = max(float(w[0]), 0.0), float(w[1]), None
    return model


def fit(docs: DataFrame, labels: DataFrame, max_texts: int = 40_000) -> Model:
    """Learn from (doc_id, text) and (doc_id, toxic); about max_texts distinct texts train at most."""
    with scope(docs.sparkSession):
        texts = materialize(sample(docs, labels, max_texts), "training")
        model = learn(texts)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [model.found(t) for t in frame["text"]]
                yield pd.DataFrame({"toxic": frame["toxic"], "n": [n for n, _ in found], "scores": [[s for *_, s in own] for _, own in found]})

        rows = texts.mapInPandas(run, "toxic int, n long, scores array<double>").collect()
    return calibrate(model, sorted((r["toxic"], r["n"], sorted(r["scores"])) for r in rows))


PASSAGE = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType()), StructField("chance", DoubleType())])
OUT = StructType([StructField("score", DoubleType()), StructField("passages", ArrayType(PASSAGE))])


def passages(model: Model, text: str, n: int, found: list[tuple[int, int, float]]) -> list[dict]:
    """The segments that are significant by themselves, by their characters."""
    out, at = [], None
    for a, z, s in found:
        chance = -math.expm1(-math.exp(-max(model.normal(n, s), -700.0)))
        if chance <= ALPHA:
            at = at or [m.span() for m in TOKEN.finditer(text)]
            out.append({"start": at[a][0], "end": at[z][1], "score": s, "chance": chance})
    return out


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, with the score and the significant passages of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of significant tokens

    def start():
        own = shared.value

        def derive(columns: list[pa.Array]):
            scores, found = [], []
            for value in columns[0]:
                text = value.as_py()
                n, of = own.found(text)
                scores.append(own.score(own.evidence(n, [s for *_, s in of])))
                found.append(passages(own, text, n, of) if of else [])
            return {"score": scores, "passages": found}, None

        return derive

    return beside(docs, keep, ["text"], OUT, start)
