"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes.  Each passage is encoded as
shares of character classes, of hashed byte pairs and of distinct words, and
then by a hidden layer.  Gated attention, tanh(V h) * sigmoid(U h), weighs the
passages of a document; a logistic unit scores the weighted sum.  Only labels
of documents are learned from.  Training takes a bounded sample of the distinct
labelled texts, with all of their passages; scoring takes every passage of
every text.

Defined results: a null or empty text is one passage without characters and
gets a score like any other.  Without labels of both kinds every score is the
share of label 1 (1.0 without any label).  Rows without a label don't train; a
text trains once for each label that it has, however many rows have both.  Repeated rows each get
their own row; columns other than the text are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import beside, each, materialize

PASSAGE = 512
PAIRS = 64


def _classes() -> np.ndarray:
    """Class of each byte: letters, digits, blanks, single marks, symbols, and bytes of other characters."""
    out = np.zeros(256, np.int64)
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[ord(c) for c in " \t\r\x0b\x0c"]] = 4
    for k, mark in enumerate("\n.,!|?:-"):
        out[ord(mark)] = 5 + k
    out[[ord(c) for c in "#*$%&<>@"]] = 13
    out[128:192] = 14
    out[192:] = 15
    return out


CLASSES, N_CLASSES = _classes(), 16
N_FEATURES = N_CLASSES + PAIRS + 3


def encode(text: str | None) -> np.ndarray:
    """Features of each passage (passages x N_FEATURES)."""
    data = (text or "").encode("utf-8", "replace")
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n = max(1, -(-len(b) // PASSAGE))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(b):
        return out
    passage = np.arange(len(b)) // PASSAGE
    size = np.bincount(passage, minlength=n)[:, None]
    out[:, :N_CLASSES] = np.sqrt(np.bincount(passage * N_CLASSES + CLASSES[b], minlength=n * N_CLASSES).reshape(n, -1) / size)
    pair = ((b[:-1] * 0x9E3B + b[1:] * 0x85EB) >> 5) % PAIRS
    out[:, N_CLASSES : N_CLASSES + PAIRS] = np.sqrt(np.bincount(passage[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, -1) / size)
    for k in range(n):
        words = data[k * PASSAGE : (k + 1) * PASSAGE].split()
        if words:
            out[k, -3] = len(set(words)) / len(words)
            out[k, -2] = min(1.0, len(words) / PASSAGE * 5)
    out[:, -1] = size[:, 0] / PASSAGE
    return out


class Model:
    """Parameters of the network; bags are rows of x between the offsets in starts."""

    def __init__(self, hidden: int = 32, attention: int = 16, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": draw(N_FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, attention), "U": draw(hidden, attention), "w": draw(attention, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) / self.scale
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.full(len(starts), self.constant) if self.constant is not None else self.forward(x, starts)["y"]

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict:
        f, p = self.forward(x, starts), self.p
        dy = (f["y"] - label) / len(label)
        out = {"c": f["z"].T @ dy, "d": np.array([dy.sum()])}
        dz = dy[:, None] * p["c"]
        dh = f["a"][:, None] * dz[f["bag"]]
        da = (f["h"] * dz[f["bag"]]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        out["w"] = (f["t"] * f["g"]).T @ de
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        out["W"], out["b"] = f["x"].T @ dh, dh.sum(axis=0)
        return out


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.003, decay: float = 1e-3, seed: int = 5) -> Model:
    """Fit by Adam; the same bags give the same model."""
    model = Model(seed=seed)
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 1.0
        return model
    x = np.concatenate(bags).astype(np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        pace = rate * (1 - epoch / epochs) + rate / 20
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            part = [bags[i] for i in pick]
            starts = np.cumsum([0, *map(len, part)])[:-1]
            step += 1
            for k, g in model.gradients(np.concatenate(part).astype(np.float64), starts, labels[pick]).items():
                g = g + decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def sampled(texts: DataFrame, max_texts: int, max_passages: int, labels: DataFrame | None = None) -> DataFrame:
    """(text, quality): about max_texts distinct pairs at most, which have max_passages passages at most in all.

    Labels are a column of texts, or a table of their own by doc_id.  Pairs are
    taken in the order of a hash; one that no longer fits is left out.  Only
    hashes and sizes of texts meet their labels and are counted and collected;
    only rows of the chosen pairs are shuffled with their texts, of which Spark
    keeps one before the shuffle.
    """
    passages = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE))
    hashed = texts.withColumns({"h1": F.xxhash64("text", F.lit(9)), "h2": F.xxhash64("text", F.lit(10)), "passages": passages})
    quality = F.col("quality").cast("int").alias("quality")
    if labels is None:
        hashed = hashed.select("h1", "h2", "text", "passages", quality).where("quality is not null")
        pairs = hashed
    else:
        own = labels.select("doc_id", quality).where("quality is not null").distinct()
        pairs = hashed.select("doc_id", "h1", "h2", "passages").distinct().join(own, "doc_id")
        hashed = hashed.select("h1", "h2", "text")
    pairs = materialize(pairs.groupBy("h1", "h2", "quality").agg(F.max("passages").alias("passages")), "labelled")
    share = min(1.0, max_texts / max(1, pairs.count()))
    rows = pairs.where(F.pmod("h1", F.lit(1 << 30)) < int(share * (1 << 30))).collect()  # about max_texts
    room, chosen = max_passages, []
    for r in sorted(rows, key=lambda r: (r["h1"], r["h2"], r["quality"])):
        if r["passages"] <= room:
            room -= r["passages"]
            chosen.append((r["h1"], r["h2"], r["quality"]))
    few = F.broadcast(texts.sparkSession.createDataFrame(chosen, "h1 long, h2 long, quality int"))  # about max_texts rows
    picked = hashed.join(few, ["h1", "h2", "quality"] if labels is None else ["h1", "h2"])
    return picked.groupBy("h1", "h2", "quality").agg(F.first("text").alias("text")).select("text", "quality")


def fit(texts: DataFrame, labels: DataFrame | None = None, max_texts: int = 5000, max_passages: int = 200_000) -> Model:
    """Learn from rows with ``text`` and ``quality``, or from texts and labels by doc_id; ``sampled`` bounds how many the driver gets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [encode(t).tobytes() for t in frame["text"]], "quality": frame["quality"].to_numpy()})

    rows = sampled(texts, max_texts, max_passages, labels).mapInPandas(run, "x binary, quality int").collect()
    rows = sorted((r["x"], r["quality"]) for r in rows)
    return train([np.frombuffer(bytes(x), np.float32).reshape(-1, N_FEATURES) for x, _ in rows], np.array([float(q == 1) for _, q in rows]))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, and score, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def derive(columns: list[pa.Array]):
        scores: list[float] = []
        held, count = [], 0
        for text in each(columns[0]):
            held.append(encode(text))
            count += len(held[-1])
            if count >= 4096:
                scores += _scores(shared.value, held)
                held, count = [], 0
        return {"score": scores + _scores(shared.value, held)}, None

    return beside(docs, keep, ["text"], "score double", lambda: derive)


def _scores(model: Model, held: list[np.ndarray]) -> list[float]:
    if not held:
        return []
    return model.score(np.concatenate(held).astype(np.float64), np.cumsum([0, *map(len, held)])[:-1]).tolist()
