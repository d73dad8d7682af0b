"""Embedding whitening: streamed moments, merged, and a symmetric QR eigen-solve.

Entries become whole numbers, x = floor(scale * c).  The fit list has each
distinct x once.  Every task streams its part of the list through Welford's
update: the mean moves by delta / n, and the sum of squares takes the rank-one
term delta * delta' * (n - 1) / n.  The tasks' moments are merged by the
parallel formula in groups of MERGED, over and over, so no task holds many.
The sums of x are kept beside as whole numbers, for the exact deviation.  The
d x d covariance is brought to tridiagonal form by reflections, and to its
eigenvectors by implicit QR steps with Wilkinson's shift.

Defined results: rows whose vector is null or has null or non-finite entries
go.  Vectors of different lengths can't be one list: each length has its own
fit, n and components, of which there are as many as dimensions at most; an
empty vector has none.  Where a component has no variance (as with one vector
in the list), whitened and explained are null; without any component of some
variance, identity_error is too.  x is held to the range of a long; a deviation
beyond it is null.  Equal rows, and rows with null ids, have their own results.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ladderlens.llm.common import beside, materialize, named, scope

SCALE = 256
#: Moments that are merged at once.
MERGED = 8
#: Bytes of moments that a task holds before it hands some on; only many lengths of vectors reach it.
HELD = 256 << 20
MOMENTS = "fit int, part long, n long, mean binary, squares binary, sums array<string>"
EPS = float(np.finfo(float).eps)


class Moments:
    """Count, mean and sum of outer products about the mean, of vectors seen one by one."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.squares, self.buffer = 0, np.zeros(dim), np.zeros((dim, dim)), np.empty((dim, dim))

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        np.multiply(delta[:, None], delta * ((self.n - 1) / self.n), out=self.buffer)
        self.squares += self.buffer

    def merge(self, n: int, mean: np.ndarray, squares: np.ndarray) -> None:
        total = self.n + n
        if n:
            delta = mean - self.mean
            self.squares += squares + np.multiply(delta[:, None], delta * (self.n * n / total))
            self.mean += delta * (n / total)
            self.n = total


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where each row starts."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def _frame(states: dict[int, tuple[Moments, list[int]]], part: int) -> pd.DataFrame:
    rows = [(d, part, m.n, m.mean.tobytes(), m.squares.tobytes(), [str(s) for s in sums]) for d, (m, sums) in sorted(states.items())]
    return pd.DataFrame(rows, columns=["fit", "part", "n", "mean", "squares", "sums"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of (fit, vector), by fit."""
    states: dict[int, tuple[Moments, list[int]]] = {}
    context = TaskContext.get()
    part = context.partitionId() if context else 0

    def flush() -> pa.RecordBatch:
        frame = _frame(states, part)
        states.clear()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(list(frame[c]), k) for c, k in zip(frame.columns, kinds, strict=True)], names=list(frame.columns))

    for batch in batches:
        fits = batch.column(0).to_numpy(zero_copy_only=False)
        flat, at = _matrix(batch.column(1))
        whole = flat.dtype.kind == "i"
        for key in np.unique(fits).tolist():
            rows = np.flatnonzero(fits == key)
            dim = int(at[rows[0] + 1] - at[rows[0]])
            x = flat[at[rows][:, None] + np.arange(dim)]
            if key not in states:
                if sum(m.squares.nbytes for m, _ in states.values()) > HELD:
                    yield flush()
                states[key] = Moments(dim), [0] * dim
            moments, sums = states[key]
            for row in x.astype(float):
                moments.add(row)
            if whole:  # in two halves, which can't overflow
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                sums[:] = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
    yield flush()


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("part", kind="stable")
    dim = len(frame["sums"].iloc[0])
    total, sums = Moments(dim), [0] * dim
    for n, mean, squares, more in zip(frame["n"], frame["mean"], frame["squares"], frame["sums"], strict=True):
        total.merge(int(n), np.frombuffer(mean), np.frombuffer(squares).reshape(dim, dim))
        sums = [s + int(m) for s, m in zip(sums, more, strict=True)]
    return _frame({int(frame["fit"].iloc[0]): (total, sums)}, int(frame["part"].iloc[0]) // MERGED)


def moments(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray, list[int]]]:
    """From rows of (fit, vector): n, covariance and sums of each fit, which is all that the driver gets."""
    with scope(vectors.sparkSession):
        parts = materialize(vectors.mapInArrow(_stream, MOMENTS), "moments")
        most = parts.agg(F.max("part")).first()[0] or 0
        while True:
            parts = parts.groupBy("fit", F.expr(f"part div {MERGED}").alias("to")).applyInPandas(lambda frame: _merge(frame), MOMENTS)
            most //= MERGED
            if not most:
                break
        found = parts.collect()
    return {r["fit"]: (r["n"], np.frombuffer(r["squares"]).reshape(len(r["sums"]), -1) / r["n"], [int(s) for s in r["sums"]]) for r in found}


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q' of a symmetric matrix a = Q T Q', by reflections."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = float(np.linalg.norm(v))
        if norm == 0:
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return a.diagonal().copy(), a.diagonal(1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows, the largest entry of each positive."""
    d, e, q = tridiagonal(a)
    m = len(d) - 1
    while m > 0:
        small = np.abs(e) <= EPS * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[small] = 0
        if small[m - 1]:
            m -= 1
            continue
        cuts = np.flatnonzero(small[: m - 1])
        first = int(cuts[-1]) + 1 if len(cuts) else 0  # the block first..m has no zero beside its diagonal
        half = (d[m - 1] - d[m]) / 2
        shift = d[m] - e[m - 1] ** 2 / (half + (1 if half >= 0 else -1) * np.hypot(half, e[m - 1]))
        x, z = d[first] - shift, e[first]
        for k in range(first, m):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            low, high, off = d[k], d[k + 1], e[k]
            d[k] = c * c * low + 2 * c * s * off + s * s * high
            d[k + 1] = s * s * low - 2 * c * s * off + c * c * high
            e[k] = c * s * (high - low) + (c * c - s * s) * off
            if k < m - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[order]
    q *= np.where(q[np.arange(len(q)), np.abs(q).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return d, q


@dataclass
class Fit:
    """What whitens the vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray  #: a row a component, divided by the root of its eigenvalue; NaN without variance
    explained: list[float | None]
    identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes.T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of each row, exactly."""
        dim = len(self.sums)
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums))
        if dim * most**2 < 1 << 63:  # no step can leave the range
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def fit_of(n: int, covariance: np.ndarray, sums: list[int], components: int) -> Fit:
    values, axes = symmetric_qr(covariance)
    trace, count = float(np.trace(covariance)), min(components, len(values))
    some = values[:count] > max(trace, 0.0) * len(values) * EPS
    scaled = np.where(some[:, None], axes[:count] / np.sqrt(np.where(some, values[:count], 1.0))[:, None], np.nan)
    return Fit(n, sums, np.array([s / n for s in sums]), scaled, [float(v) / trace if ok else None for v, ok in zip(values[:count], some, strict=True)])


def whole_numbers(vectors: DataFrame, column: str, keep: Sequence[str], scale: int = SCALE) -> DataFrame:
    """keep, and x as the vector in whole numbers; rows without a finite vector go."""
    of = named(column)
    fine = of.isNotNull() & F.forall(of, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform(of, lambda v: F.floor(v.cast("double") * scale))
    return vectors.where(fine).select(*(named(c) for c in keep), x.alias("x"))


def fit(x: DataFrame, components: int = 4) -> dict[int, Fit]:
    """The fit of each length of the vectors in x, from the distinct ones."""
    spark = x.sparkSession
    with scope(spark):
        distinct = materialize(x.where(F.size("x") > 0).select(F.size("x").alias("fit"), "x").distinct(), "vectors")
        found = {dim: fit_of(*m, components) for dim, m in moments(distinct).items()}
        shared = spark.sparkContext.broadcast(found)  # some numbers for each dimension

        def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, (flat, at) = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    w = np.nan_to_num(shared.value[dim].whiten(flat[at[rows][:, None] + np.arange(dim)]))
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(rows), pa.int32()), pa.array(list(w), pa.list_(pa.float64()))], names=["fit", "w"])

        for dim, (_, covariance, _) in moments(distinct.mapInArrow(whitened, "fit int, w array<double>")).items():
            some = np.isfinite(found[dim].axes).all(axis=1)
            if some.any():
                found[dim].identity_error = float(np.abs(covariance - np.eye(len(covariance)))[np.ix_(some, some)].max())
    return found


OUT = StructType([StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])


def whiten(vectors: DataFrame, keep: Sequence[str], column: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """For each row with a finite vector and each component up to the limit: keep and the columns of OUT."""
    x = whole_numbers(vectors, column, keep, scale)
    shared = vectors.sparkSession.sparkContext.broadcast(fit(x, components))

    def start():
        def derive(columns: list[pa.Array]):
            flat, at = _matrix(columns[0])
            rows, out = [], {f.name: [] for f in OUT}
            for dim, own in shared.value.items():
                mine = np.flatnonzero(np.diff(at) == dim)
                part, k = flat[at[mine][:, None] + np.arange(dim)], len(own.axes)
                rows.append(np.repeat(mine, k))
                out["component"] += list(range(1, k + 1)) * len(mine)
                out["n"] += [own.n] * (k * len(mine))
                out["deviation"] += [v for v in own.deviations(part) for _ in range(k)]
                out["whitened"] += [None if v != v else v for v in own.whiten(part).ravel().tolist()]
                out["explained"] += own.explained * len(mine)
                out["identity_error"] += [own.identity_error] * (k * len(mine))
            return out, np.concatenate(rows) if rows else []

        return derive

    return beside(x, keep, ["x"], OUT, start)
