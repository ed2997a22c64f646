"""Whitening of embeddings by principal components, from exact squares alone.

Entries become whole numbers, and everything up to the covariance matrix is exact. The matrix follows from variances
only (polarisation): Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), so it is enough to sum the squared centred values of
every dimension and of the sum of every two dimensions. Values are centred on the whole number below the mean, and
what is left of the mean, less than one, is taken out of the sums exactly.

Vectors are read in slices of bounded size. Tasks send one row for each dimension or pair of dimensions; those sums,
d(d + 1) / 2 of them whatever the number of vectors, are what the driver turns into the matrix and its eigenvectors.
Repeated vectors collapse in the tasks before the distinct ones shuffle, so a vector that a third of the rows hold
reaches no task more often than once per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from meterlens.session import cut

#: An entry c becomes floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Larger magnitudes of floor(STEPS * c) count as this one; from here on doubles have no halves.
LIMIT = 2**52
#: Entries that are worked on at a time.
SLICE = 1 << 20
_WHOLE = pa.decimal128(38, 0)
#: Sums below this stay in 64 bits.
_FITS = 2**62


@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list. ``mean`` is ``base`` + ``rest`` / ``n``, exactly."""

    n: int
    base: list[int]
    rest: list[int]
    #: Falling eigenvalues and their unit eigenvectors, one column each; at most as many as asked for.
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), NaN where a component has no spread beyond rounding."""
        least = self.trace * len(self.base) * np.finfo(np.float64).eps
        spread = self.values > least
        return np.where(spread, 1 / np.sqrt(np.where(spread, self.values, 1.0)), np.nan)


def _matrices(vectors: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers) of the usable vectors of a batch, a matrix per length and slice.

    Unusable are null vectors, those with a null, infinite or NaN entry, and empty ones.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes) if length is None else [length]:
        places = np.flatnonzero(sizes == size)
        step = max(1, SLICE // max(1, int(size)))
        for at in range(0, len(places) if size else 0, step):
            here = places[at : at + step]
            flat = vectors.take(pa.array(here)).flatten().cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False).reshape(len(here), size)
            good = np.isfinite(values).all(axis=1)
            whole = np.clip(np.floor(STEPS * values[good]), -LIMIT, LIMIT).astype(np.int64) + SHIFT
            yield here[good], whole


def _fixed(vectors: pa.Array, length: int) -> Iterator[np.ndarray]:
    """Matrices of vectors that are whole numbers already."""
    step = max(1, SLICE // length)
    for at in range(0, len(vectors), step):
        part = vectors.slice(at, step)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), length)


def fit_list(embeddings: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(x): every distinct vector of whole numbers once, written. All lengths; see ``whiten``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, whole in _matrices(batch.column(0)):
                ends = np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, whole.ravel())], ["x"])

    return cut(embeddings.select(F.col(vector_col).alias("v")).mapInArrow(run, "x array<bigint>").distinct())


def _summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    return {(r.i, r.j): int(r.s) for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}


def _rows(keys: list[tuple[int, int]], sums: list[int]) -> pa.RecordBatch:
    i, j = zip(*keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(s) for s in sums], _WHOLE)], ["i", "j", "s"]
    )


def _exact(matrix: np.ndarray, biggest: int) -> np.ndarray:
    """``matrix`` in a type in which numbers up to ``biggest`` do not wrap."""
    return matrix if biggest < _FITS else matrix.astype(object)


def _largest(matrix: np.ndarray) -> int:
    return max(int(matrix.max()), -int(matrix.min())) if matrix.size else 0


def column_sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * length
        for batch in batches:
            for whole in _fixed(batch.column(0), length):
                n += len(whole)
                part = _exact(whole, len(whole) * _largest(whole)).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, part)]
        if n:
            yield _rows([(-1, -1)] + [(i, i) for i in range(length)], [n, *sums])

    found = _summed(fit.mapInArrow(run, "i int, j int, s decimal(38,0)"))
    return found[-1, -1], [found[i, i] for i in range(length)]


def square_sums(fit: DataFrame, base: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of squares of x - ``base``: (i, i) of dimension i, (i, j) with i < j of the sum of i and j."""
    length = len(base)
    keys = [(i, j) for i in range(length) for j in range(i, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for whole in _fixed(batch.column(0), length):
                z = np.ascontiguousarray((whole - np.array(base, dtype=np.int64)).T)
                z = _exact(z, len(whole) * (2 * _largest(z)) ** 2)
                sums = sums or [0] * len(keys)
                at = 0
                for i in range(length):
                    pair = z[i:] + z[i]
                    pair[0] = z[i]
                    part = (pair * pair).sum(axis=1) if z.dtype == object else np.einsum("ij,ij->i", pair, pair)
                    for k, s in enumerate(part.tolist(), at):
                        sums[k] += s
                    at += length - i
        if sums:
            yield _rows(keys, sums)

    return _summed(fit.mapInArrow(run, "i int, j int, s decimal(38,0)"))


def fit(vectors: DataFrame, length: int, components: int) -> Whitening:
    """Components of the distinct vectors ``vectors`` (x, all of one length)."""
    n, sums = column_sums(vectors, length)
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base)]
    squares = square_sums(vectors, base)
    # n * n * variance, exactly; a quotient of whole numbers is rounded once.
    var = [n * squares[i, i] - rest[i] ** 2 for i in range(length)]
    cov = np.empty((length, length))
    for i in range(length):
        cov[i, i] = var[i] / n**2
        for j in range(i + 1, length):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            cov[i, j] = cov[j, i] = (both - var[i] - var[j]) / (2 * n**2)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    # Either sign is right; the entry of the largest size is made positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitening(n, base, rest, values[order], axes, sum(var) / n**2)


def _projected(whole: np.ndarray, model: Whitening) -> np.ndarray:
    centred = (whole - np.array(model.base, dtype=np.int64)) - np.array([r / model.n for r in model.rest])
    return (centred @ model.vectors) * model.scales


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of |covariance of the whitened fit list - identity|; components without spread left out."""
    length, held = len(model.base), np.flatnonzero(~np.isnan(model.scales))
    if not len(held):
        return None
    keys = [(i, j) for i in range(len(held)) for j in range(i, len(held))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in _fixed(batch.column(0), length):
                w = _projected(whole, model)[:, held]
                products = w.T @ w
                i, j = zip(*keys, *[(-1, k) for k in range(len(held))])
                s = [products[k] for k in keys] + w.sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.float64())], ["i", "j", "s"]
                )

    parts = vectors.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg((F.sum("s") / model.n).alias("s"))
    found = {(r.i, r.j): r.s for r in parts.collect()}
    return max(abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i, j in keys)


def _deviations(whole: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over the dimensions of (n x - S)^2 of every row, exactly; null beyond 38 digits."""
    n, rest = model.n, np.array(model.rest, dtype=np.int64)
    z = whole - np.array(model.base, dtype=np.int64)
    most, dims = _largest(z), len(rest)
    if dims * (n * (most + 1)) ** 2 < _FITS:
        away = n * z - rest
        return pa.array(np.einsum("ij,ij->i", away, away)).cast(_WHOLE)
    # n^2 z.z - 2 n z.r + r.r, with dot products in 64 bits as long as they fit.
    z = _exact(z, dims * most * max(most, n))
    squares, mixed = (z * z).sum(axis=1), (z * rest).sum(axis=1)
    last = sum(r * r for r in model.rest)
    exact = [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed)]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], _WHOLE)


def project(
    embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector of the fitted length and component: vec_id, component, n, deviation, whitened,
    explained."""
    id_type = embeddings.select(F.col(id_col)).schema[0].dataType.simpleString()
    length, k = len(model.base), len(model.values)
    share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, whole in _matrices(batch.column(1), length):
                if not len(places):
                    continue
                rows = len(places)
                each = pa.array(np.repeat(np.arange(rows), k))
                white, part = _projected(whole, model).ravel(), np.tile(share, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(places, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                        _deviations(whole, model).take(each),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(part, mask=np.isnan(part)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(
        run,
        f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double",
    )


def whiten(
    embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component, at most ``components`` of them: vec_id, component (from 1, falling
    eigenvalue), n (distinct vectors), deviation (decimal, exact), whitened, explained, identity_error (one value).

    Dropped are null vectors, those with null or non-finite entries, empty ones, and those whose length is not that of
    most distinct vectors (ties: the longer). Null and repeated ids are rows like any other; repeated vectors count
    once in the fit. Entries beyond 2^52 / 64 count as that size. A component without spread beyond rounding (a single
    vector, constant or dependent dimensions) has null ``whitened`` and is left out of ``identity_error``; without any
    spread ``explained`` is null too. A table without usable vectors gives an empty result, and other columns of any
    name are not read.
    """
    distinct = fit_list(embeddings, vector_col)
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        nothing = Whitening(1, [0], [0], np.zeros(1), np.ones((1, 1)), 0.0)
        return project(embeddings.where("false"), nothing, id_col, vector_col).withColumn(
            "identity_error", F.lit(None).cast("double")
        )
    vectors = distinct.where(F.size("x") == most.d)
    model = fit(vectors, most.d, components)
    error = identity_error(vectors, model)
    return project(embeddings, model, id_col, vector_col).withColumn("identity_error", F.lit(error).cast("double"))
