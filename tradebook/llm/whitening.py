"""Whitening of embeddings on leading principal components, by Chebyshev-filtered subspace iteration.

Entries become the integers ``floor(256 * c)``. The covariance V of the distinct integer vectors is never formed:
a pass sends a block Q of columns to all tasks, each of which adds up Xᵀ(XQ) over its centred rows, and Spark adds up these
partial sums entry by entry, so that the driver gets one block of dimension x columns however many tasks there are.

A few Lanczos steps bound the spectrum from below. Then each round filters the block with a Chebyshev polynomial of V, by its
three-term recurrence and one pass per degree, which damps the part of the spectrum between that bound and the
block's smallest Ritz value; QR and Rayleigh-Ritz follow. Rounds go on until the residuals of the wanted columns are
certified: at ``TOLERANCE`` of the largest eigenvalue, or where rounding keeps them from falling any further.

Exact numbers stay whole: sums over all vectors are added up as upper and lower halves of the integers, deviations in
Python's integers where 64 bits do not hold them.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as are rows whose vector has another
length than most have (of equally frequent lengths the longest counts). Entries beyond 64 bits count as the largest
integer. Repeated vectors count once in the fit, and each of their rows is returned. A component without variance (too few
distinct vectors) has null ``whitened``; with no variance at all, ``explained`` and ``identity_error`` are null.
A deviation beyond 64 bits is null. An empty table gives no rows; fewer dimensions give fewer components. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.columns import written

COMPONENTS = 4
#: Columns that are carried along besides the wanted ones.
GUARDS = 12
#: Degree of the polynomial, and Lanczos steps that bound the spectrum.
DEGREE, STEPS = 8, 8
#: Residual, of the largest eigenvalue, at which a component is certified at once.
TOLERANCE = 1e-14
#: Residual from which on rounding may be what keeps it from falling.
ROUNDING = 1e-9
#: Variance, of the trace, that counts as none.
NO_VARIANCE = 1e-13
_SCALE = 256
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fit: number of distinct vectors, exact sums, trace of V, eigenvalues, eigenvectors (columns) and their residuals."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def varied(self) -> np.ndarray:
        """Whether a component has variance."""
        return self.values > NO_VARIANCE * self.trace


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain, with x as integers."""
    entries = F.col("embedding").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", entries.alias("entries")).filter(F.col("entries").isNotNull() & F.coalesce(finite, F.lit(False)))
    usual = rows.groupBy(F.size("entries").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter(F.size("entries") == (usual.size if usual else 0))
    return rows.select("vec_id", F.transform("entries", lambda c: F.floor(c * _SCALE)).alias("x"))


def _blocks(batches: Iterable[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their vectors as rows of an integer matrix."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(i, _ROWS)
            yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)


def _entries(values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.arange(values.size)), pa.array(values.ravel())], ["entry", "value"])


def _summed(rows: DataFrame, run: Callable, kind: str) -> np.ndarray:
    """Sum over tasks, entry by entry, of what ``run`` gives; empty if no task has rows."""
    sums = rows.mapInArrow(run, f"entry long, value {kind}").groupBy("entry").agg(F.sum("value").alias("value"))
    found = {r.entry: r.value for r in sums.collect()}
    return np.array([found[i] for i in range(len(found))])


def _exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for _, x in _blocks(batches):
            part = np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            yield _entries(total)

    n, *halves = [int(v) for v in _summed(fit, run, "long")] or [0]
    size = len(halves) // 2
    return n, [(halves[i] << 32) + halves[size + i] for i in range(size)]


class _Covariance:
    """V as an operator: one pass over the fit list for each block that it is applied to."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]):
        self.fit, self.n, self.size, self.passes = fit, n, len(sums), 0
        self.mean = np.array([s / n for s in sums])

    def _pass(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        mean = self.mean

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for _, x in _blocks(batches):
                found = part(x - mean)
                total = found if total is None else total + found
            if total is not None:
                yield _entries(total)

        self.passes += 1
        return _summed(self.fit, run, "double") / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        return self._pass(lambda x: x.T @ (x @ block)).reshape(block.shape)

    def trace(self) -> float:
        return float(self._pass(lambda x: np.array([(x * x).sum()]))[0])

    def identity_error(self, scaled: np.ndarray) -> float:
        """Largest entry of the covariance of the vectors projected on ``scaled``, less the identity."""
        size = scaled.shape[1]
        found = self._pass(lambda x: (x @ scaled).T @ (x @ scaled)).reshape(size, size)
        return float(np.abs(found - np.eye(size)).max())


def _lower_bound(v: _Covariance, steps: int, rng: np.random.Generator) -> float:
    """Where the spectrum begins, by Lanczos steps: the smallest Ritz value less the last residual, zero at least."""
    basis = [q := _unit(rng.standard_normal(v.size))]
    a, b = [], []
    for _ in range(min(steps, v.size)):
        w = v.times(q[:, None])[:, 0]
        a.append(q @ w)
        for _ in range(2):
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        b.append(np.linalg.norm(w))
        if b[-1] <= 1e-12 * max(map(abs, a)):
            break
        basis.append(q := w / b[-1])
    off = b[: len(a) - 1]
    return max(0.0, float(np.linalg.eigvalsh(np.diag(a) + np.diag(off, 1) + np.diag(off, -1))[0] - b[len(a) - 1]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x)


def _filtered(v: _Covariance, block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The block under a polynomial of V that stays small on [low, high] and grows beyond; scaled so that it is about 1 at ``top``."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = block, (v.times(block) - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (v.times(now) - centre * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def leading(v: _Covariance, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, eigenvectors and residuals of V's ``wanted`` leading pairs."""
    rng = np.random.default_rng(seed)
    columns = min(v.size, wanted + GUARDS)
    low = _lower_bound(v, STEPS, rng) if columns < v.size else 0.0
    block = np.linalg.qr(rng.standard_normal((v.size, columns)))[0]
    before, stalled = np.inf, 0
    while True:
        image = v.times(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residuals = np.linalg.norm(image - block * values, axis=0)[:wanted]
        top, worst = float(values[0]), float(residuals.max())
        stalled = stalled + 1 if worst > before / 2 else 0
        if top <= 0 or worst <= TOLERANCE * top or (worst <= ROUNDING * top and stalled >= 2):
            return np.maximum(values[:wanted], 0), block[:, :wanted], residuals
        before = min(before, worst)
        high = float(values[-1])
        if columns < v.size and low < high < top:
            block = _filtered(v, block, low, high, top, DEGREE)
        else:
            block = v.times(block)
        block = np.linalg.qr(block)[0]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the distinct integer vectors; None if there is no vector."""
    return _fit(integers(vectors), components)


def _fit(rows: DataFrame, components: int) -> Whitening | None:
    distinct = written(rows.select("x").distinct(), "distinct")
    n, sums = _exact_sums(distinct)
    if not sums:
        return None
    v = _Covariance(distinct, n, sums)
    trace = v.trace()
    values, found, residuals = leading(v, min(components, v.size))
    varied = values > NO_VARIANCE * trace
    error = v.identity_error(found[:, varied] / np.sqrt(values[varied])) if varied.any() else None
    return Whitening(n, sums, trace, values, found, residuals, v.passes, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)²."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [value if value < 1 << 63 else None for value in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each remaining row on each component."""
    rows = integers(vectors)
    fitted = _fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, mean, varied, error = fitted.n, fitted.sums, fitted.mean, fitted.varied, fitted.identity_error
    scaled = fitted.vectors / np.sqrt(np.where(varied, fitted.values, 1))
    explained = [float(e / fitted.trace) if fitted.trace > 0 else None for e in fitted.values]
    count = len(explained)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches):
            rows = len(x)
            at = np.repeat(np.arange(rows), count)
            whitened = ((x - mean) @ scaled).ravel()
            yield pa.record_batch(
                [
                    piece.column("vec_id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, n)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(at)),
                    pa.array(whitened, mask=~np.tile(varied, rows)),
                    pa.array(explained * rows, pa.float64()),
                    pa.array([error] * (rows * count), pa.float64()),
                ],
                schema=pa.schema([(name, kind) for name, kind in zip([f.split()[0] for f in schema.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3])]),
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)
