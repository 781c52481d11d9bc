"""Embedding whitening: leading principal components by spectrum slicing, every coordinate scaled to variance one.

Entries are taken as whole numbers (64ths, moved by ``OFFSET``), so Spark's sums over the fit list are exact and the
covariance is centred without rounding. What reaches the driver is one number per pair of dimensions, whatever
the number of rows. There the LDL' factors of shifted covariances count the eigenvalues above the shift; counts
cut the spectrum into intervals of one eigenvalue each, Rayleigh quotient iteration finds it, and two more counts
certify its number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.scratch import stored
from hazardlens.llm.vectors import matrix, of_usual_width, usable

#: x = floor(STEPS * c) + OFFSET
STEPS = 64
OFFSET = 1_000_000
#: Eigenvalues below this share of the trace count as zero and give no component.
LEAST_SHARE = 1e-10
#: Entries of more than this size are beyond exact arithmetic.
LARGEST = 1 << 53


# Spectrum slicing of a symmetric matrix. ----------------------------------------------------------------------

@dataclass
class Factors:
    """P A P' = L D L' of a symmetric matrix, D of blocks of one or two rows (``two`` marks the first row of two)."""

    order: np.ndarray
    lower: np.ndarray
    blocks: np.ndarray
    two: np.ndarray

    @property
    def positive(self) -> int:
        """Number of positive eigenvalues, by Sylvester's law; a block of two rows always has one of each sign."""
        single = ~self.two & ~np.concatenate(([False], self.two[:-1]))
        return int((np.diagonal(self.blocks)[single] > 0).sum() + self.two.sum())

    def solve(self, right: np.ndarray) -> np.ndarray:
        n = len(right)
        y = right[self.order].astype(float)
        for j in range(n):
            y[j + 1:] -= self.lower[j + 1:, j] * y[j]
        j = 0
        while j < n:
            size = 2 if self.two[j] else 1
            y[j:j + size] = np.linalg.solve(self.blocks[j:j + size, j:j + size], y[j:j + size])
            j += size
        for j in range(n - 1, -1, -1):
            y[j] -= self.lower[j + 1:, j] @ y[j + 1:]
        out = np.empty(n)
        out[self.order] = y
        return out


def factorized(matrix: np.ndarray) -> Factors:
    """LDL' with symmetric pivoting: the larger of the best diagonal entry and the best entry of its column decides.

    A pivot of nothing at all is moved off zero by rounding's own size, which shifts eigenvalues by no more.
    """
    a = np.array(matrix, float)
    n = len(a)
    order, lower, blocks, two = np.arange(n), np.eye(n), np.zeros((n, n)), np.zeros(n, bool)
    tiny = np.finfo(float).eps * max(float(np.abs(a).max(initial=0.0)), np.finfo(float).tiny)
    growth = (1 + 17 ** 0.5) / 8

    def swap(i: int, j: int, done: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            order[[i, j]] = order[[j, i]]
            lower[[i, j], :done] = lower[[j, i], :done]

    k = 0
    while k < n:
        rest = a[k:, k:]
        best = int(np.abs(np.diagonal(rest)).argmax())
        size, at = 1, best
        if abs(rest[best, best]) < growth * np.abs(rest).max() and k + 1 < n:
            off = np.abs(rest - np.diag(np.diagonal(rest)))
            p, q = sorted(divmod(int(off.argmax()), n - k))
            size, at = 2, p
        swap(k, k + at, k)
        if size == 1:
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            blocks[k, k] = a[k, k]
            column = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= np.outer(column, a[k, k + 1:])
            lower[k + 1:, k] = column
        else:
            swap(k + 1, k + q, k)
            block = a[k:k + 2, k:k + 2].copy()
            blocks[k:k + 2, k:k + 2], two[k] = block, True
            columns = np.linalg.solve(block, a[k:k + 2, k + 2:]).T
            a[k + 2:, k + 2:] -= columns @ a[k:k + 2, k + 2:]
            lower[k + 2:, k:k + 2] = columns
        k += size
    return Factors(order, lower, blocks, two)


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the leading eigenvalues above ``LEAST_SHARE`` of the trace, largest first.

    Equal eigenvalues get vectors at right angles. A number that two counts do not certify is an error.
    """
    n, trace = len(matrix), float(np.trace(matrix))
    if n == 0 or trace <= 0:
        return np.empty(0), np.empty((n, 0))
    a = matrix / trace
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = factorized(a - shift * np.eye(n)).positive
        return counts[shift]

    finest = 64 * np.finfo(float).eps
    values, vectors = [], np.empty((n, 0))
    for number in range(1, min(most, n, above(LEAST_SHARE)) + 1):
        # Counts known so far bound the eigenvalue of this number; bisection goes on until it is alone.
        low = max((s for s, c in counts.items() if c >= number), default=LEAST_SHARE)
        high = min((s for s, c in counts.items() if c < number), default=1 + 1e-9)
        above(high)

        def narrower(low: float, high: float, number: int = number) -> tuple[float, float]:
            middle = (low + high) / 2
            return (middle, high) if above(middle) >= number else (low, middle)

        while high - low > finest and (above(low) > number or above(high) < number - 1):
            low, high = narrower(low, high)
        while True:
            value, vector = _quotient_iteration(a, (low + high) / 2, vectors, number)
            if low - finest <= value <= high + finest or high - low <= finest:
                break
            low, high = narrower(low, high)  # drawn to a neighbour: start nearer
        slack = max(finest, 1e-12 * value)
        if not (above(value + slack) < number <= above(value - slack)):
            raise ArithmeticError(f"eigenvalue {number} is not certified by the counts at its two sides")
        values.append(value)
        vectors = np.column_stack((vectors, vector))
    return np.array(values) * trace, vectors


def _quotient_iteration(a: np.ndarray, shift: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """An eigenpair near ``shift`` whose vector is at right angles to those found: two steps of inverse iteration, then
    the shift follows the Rayleigh quotient until the residual is rounding."""
    n = len(a)

    def unit(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found @ (found.T @ v)
        return v / np.linalg.norm(v)

    vector = unit(np.random.default_rng(seed).standard_normal(n))
    best = (np.inf, shift, vector)
    for step in range(40):
        vector = unit(factorized(a - shift * np.eye(n)).solve(vector))
        value = float(vector @ a @ vector)
        error = float(np.linalg.norm(a @ vector - value * vector))
        if error >= best[0] and step > 4:
            break
        if error < best[0]:
            best = (error, value, vector)
        if error < 4 * np.finfo(float).eps * abs(value):
            break
        if step > 0:
            shift = value
    return best[1], best[2]


# The fit on Spark. --------------------------------------------------------------------------------------------

@dataclass
class Whitening:
    """n fit vectors, sums per dimension, trace of the covariance, eigenvalues and components (as columns)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python's integers where a long might not hold it."""
        if len(x) and self.n * int(np.abs(x).max(initial=0)) * 2 >= 1 << 62:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n @ self.vectors / np.sqrt(self.values)


def whole_numbers(vector: str) -> Column:
    """The x vector of a usable embedding."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + OFFSET)


def _products(y: np.ndarray) -> np.ndarray:
    """y' y without rounding."""
    most = int(np.abs(y).max(initial=0)) ** 2 * max(len(y), 1)
    if most < LARGEST:
        return np.rint(y.astype(float).T @ y.astype(float)).astype(np.int64)
    return y.T @ y if most < 1 << 62 else y.astype(object).T @ y.astype(object)


def fit_list(embeddings: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """Each distinct x vector once, as a stored table of column x."""
    rows = of_usual_width(embeddings.where(usable(vector_column)).select(F.col(vector_column).alias("v")), "v")
    return stored(rows.select(whole_numbers("v").alias("x")).distinct(), "fit-list")


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening:
    """Components of the vectors x of ``fit``. No row, or rows without spread, give a model without components."""
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = matrix(batch.column("x"), np.int64) - OFFSET
            if not len(y):
                continue
            if int(np.abs(y).max(initial=0)) >= LARGEST:
                raise ValueError("an entry is too large for exact sums")
            wide = np.column_stack((np.ones(len(y), np.int64), y))
            total = _products(wide).astype(object) + (0 if total is None else total)
        if total is not None:
            cells = [(i, j) for i in range(len(total)) for j in range(i, len(total))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
                 pa.array([str(total[c]) for c in cells])], names=["i", "j", "value"])

    cells = (fit.select("x").mapInArrow(sums, "i int, j int, value string")
             .groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    if not cells:
        return Whitening(0, [], 0.0, np.empty(0), np.empty((0, 0)))
    width = max(c["j"] for c in cells)
    cell = {(c["i"], c["j"]): int(c["value"]) for c in cells}
    n, first = cell[0, 0], [cell[0, j] for j in range(1, width + 1)]
    covariance = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            exact = n * cell[i + 1, j + 1] - first[i] * first[j]
            covariance[i, j] = covariance[j, i] = float(Fraction(exact, n * n))
    values, vectors = leading_eigenpairs(covariance, components)
    return Whitening(n, [s + n * OFFSET for s in first], float(np.trace(covariance)), values, vectors)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the rows."""
    if not len(model.values):
        return 0.0

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = 0.0, len(model.values) + 1
        for batch in batches:
            wide = np.column_stack((np.ones(batch.num_rows), model.coordinates(matrix(batch.column("x"), np.int64))))
            total = total + wide.T @ wide
        if not np.isscalar(total):
            i, j = np.divmod(np.arange(size * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())],
                                             names=["i", "j", "value"])

    cells = (fit.select("x").mapInArrow(products, "i int, j int, value double")
             .groupBy("i", "j").agg(F.sum("value").alias("value")).collect())
    moments = np.zeros((len(model.values) + 1,) * 2)
    for c in cells:
        moments[c["i"], c["j"]] = c["value"] / model.n
    return float(np.abs(moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(len(model.values))).max())


def whitened(embeddings: DataFrame, components: int = 16, id_column: str = "vec_id",
             vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are left out; so are, where vectors
    differ in length, those of another length than the most frequent one (of several, the longest). Null and
    repeated ids are rows like any other; repeated vectors count once in the fit. Without spread (an empty
    table, one distinct vector) there is no component and so no row. ``deviation`` is exact, and null where
    a long cannot hold it; an entry of 2^53 64ths or more is an error.
    """
    fit = fit_list(embeddings, vector_column)
    model = fit_whitening(fit, components)
    error = identity_error(fit, model)
    kind = embeddings.schema[id_column].dataType.simpleString()
    rows = of_usual_width(embeddings.where(usable(vector_column)).select(
        F.col(id_column).alias("id"), F.col(vector_column).alias("v")), "v")
    count = len(model.values)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = matrix(batch.column("x"), np.int64)
            apart = model.deviations(x)
            most = int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1]
            squares = apart.astype(object) ** 2 if most >= 1 << 62 else apart ** 2
            deviation = [int(d) if d < 1 << 63 else None for d in squares.sum(axis=1).tolist()]
            rows_of = np.repeat(np.arange(batch.num_rows), count)
            size = len(rows_of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                 pa.array(np.full(size, model.n)), pa.array(deviation, pa.int64()).take(pa.array(rows_of)),
                 pa.array(model.coordinates(x).ravel()),
                 pa.array(np.tile(model.values / model.trace, batch.num_rows)), pa.array(np.full(size, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", whole_numbers("v").alias("x")).mapInArrow(
        project, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
                 "identity_error double").withColumnRenamed("id", id_column)
