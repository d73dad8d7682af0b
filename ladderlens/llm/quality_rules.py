"""Quality rules with risk-controlled thresholds.

Each rule rejects texts whose measure is past a cutoff.  A ladder of rule sets
goes from mild to strict: on each step every rule has the cutoff of that step,
and a text is rejected if any rule rejects it.  Labelled texts that no other
step learns from decide how far a stratum climbs: from the mildest step on, the
exact binomial (Clopper-Pearson) upper bound of the share of good texts that
the whole step rejects must stay within ``risk``.  The first step that fails
ends the climb (fixed-sequence testing, which needs no correction within a
stratum), and the error probability is split evenly over the strata
(Bonferroni).  So with probability 1 - error the verdict rejects no more than
``risk`` of the good texts of any stratum that pass the base rules.  Where too
few labels prove that, the rules stay off.

A stratum is a language and a class of length.  The trials of the bound are the
distinct good texts of a stratum: copies of a text, and of a label, are one.
Spark sums them to counts for each stratum and step, which is all that the
driver sees.

Defined results: a null text has no words and fails the base rules.  A null
language is a stratum of its own.  A text is good if any of its rows has a
label 1.  Without labels all rules are off.  Texts of any length are measured
whole.  An empty table gives no rows.  Repeated rows each get their own row;
columns other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import beside, each, materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Cutoffs of each rule, a column for each step of the ladder, from mild to strict.
CUTOFFS = {
    "symbols": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "duplicate_lines": [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "long_words": [30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.5],
    "short_words": [-1.5, -1.8, -2.0, -2.2, -2.4, -2.6, -2.7, -2.8, -2.9, -3.0, -3.1],
}
STEPS = len(CUTOFFS["symbols"])


def values() -> dict[str, Column]:
    """The measure that each rule compares; a rule rejects what is above its cutoff."""
    words = F.col("n_words").cast("double")
    return {
        "symbols": F.try_divide("n_symbols", words),
        "repeats": F.try_divide("n_repeat_words", words),
        "duplicate_lines": F.try_divide("n_dup_lines", words),
        "long_words": F.try_divide("word_chars", words),
        "short_words": -F.try_divide("word_chars", words),
    }


def rejected_by(step: int) -> dict[str, Column]:
    """Which rules of a step reject."""
    return {name: F.coalesce(value > CUTOFFS[name][step], F.lit(False)) for name, value in values().items()}


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()  # bytes: blanks are 20 and 09 to 0D
    chars = len(text) - sum(map(text.count, BLANKS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    window = count[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= window
    return int(covered.sum())


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, and the measures, of every row."""

    def derive(columns: list[pa.Array]):
        got = np.array([measure(t) for t in each(columns[0])], np.int64).reshape(-1, len(MEASURES))
        return {m: got[:, i] for i, m in enumerate(MEASURES)}, None

    return beside(docs, keep, ["text"], ", ".join(f"{m} long" for m in MEASURES), lambda: derive)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    length = F.when(F.col("n_words") < 200, "short").when(F.col("n_words") < 1000, "middle").otherwise("long")
    return F.concat_ws("/", F.coalesce(F.col("lang"), F.lit("?")), length)


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Clopper-Pearson upper bound of a proportion, at confidence 1 - error."""
    if rejected >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(rejected + 1)]

    def tail(p: float) -> float:  # P(at most `rejected` of n)
        return sum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(logs))

    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > error else (low, mid)
    return high


def choose(counts: dict[str, tuple[int, list[int]]], risk: float, error: float) -> dict[str, int]:
    """For each stratum: the strictest step that it may take, if any.

    counts has the number of good texts and how many of them each step rejects.
    """
    each = error / max(1, len(counts))
    out = {}
    for stratum, (n, rejected) in counts.items():
        for step, k in enumerate(rejected):
            if n == 0 or k > risk * n or upper_bound(k, n, each) > risk:
                break
            out[stratum] = step
    return out


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """(stratum, step) for the strata whose rules are on, learned from labels (doc_id, quality).

    measured has h1 and h2, hashes of the text.
    """
    ids = labels.where("quality = 1").select("doc_id").distinct()
    good = measured.where(~base_failed()).join(ids, "doc_id").select(stratum().alias("stratum"), "h1", "h2", *MEASURES).dropDuplicates(["stratum", "h1", "h2"])
    sums = [F.count_if(reduce(lambda a, b: a | b, rejected_by(i).values())).alias(str(i)) for i in range(STEPS)]
    rows = good.groupBy("stratum").agg(F.count("*").alias("n"), *sums).collect()  # languages x lengths rows
    chosen = choose({r["stratum"]: (r["n"], [r[str(i)] for i in range(STEPS)]) for r in rows}, risk, error)
    return measured.sparkSession.createDataFrame(sorted(chosen.items()), "stratum string, step int")


def apply_rules(measured: DataFrame, steps: DataFrame) -> DataFrame:
    """measured with base_failed, kept and the names of the rules that reject (failed_rules)."""
    out = measured.withColumn("_stratum", stratum()).join(F.broadcast(steps.select(F.col("stratum").alias("_stratum"), F.col("step").alias("_step"))), "_stratum", "left")  # languages x lengths rows
    cutoff = {name: F.get(F.array(*map(F.lit, cuts)), F.col("_step")) for name, cuts in CUTOFFS.items()}
    failed = F.array_compact(F.array(*(F.when(value > cutoff[name], F.lit(name)) for name, value in values().items())))
    out = out.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_join(failed, ","))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("_stratum", "_step")


def quality(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """doc_id, the measures, base_failed, kept and failed_rules of every row."""
    docs = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    measured = materialize(measures(docs, ["doc_id", "lang", "h1", "h2"]), "measures")
    return apply_rules(measured, calibrate(measured, labels, risk, error)).drop("lang", "h1", "h2")
