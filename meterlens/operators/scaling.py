"""Centre and spread of every design matrix column, without a row per value.

Quartiles are found by counting: every task drops its values of all columns into bins, the bins of all tasks are added
up, and only the bin that holds a wanted rank is cut into bins again. A bin is known by the least and the greatest
value in it, so it shrinks to what the data has, and a rank is found as soon as the two are equal, however many rows
share that value. No value is ever shuffled, and the way is the same for every number of rows.

Means and deviations come from two passes of sums per column, the second around the mean of the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlens import schema as S

#: Bins of a column in one pass.
BINS = 2048
#: Rows that are expanded at once.
SLICE_ROWS = 1024
Expand = Callable[[pa.Array], np.ndarray]
_COUNTED = f"{S.SEGMENT} string, i int, bin int, n long, low double, high double"


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_ROWS``."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(a, SLICE_ROWS)


def _parts(batches: Iterator[pa.RecordBatch], expand: Expand) -> Iterator[tuple[str, np.ndarray]]:
    """(segment, matrix rows) of each batch of (segment, base), some rows at a time: a matrix row is wide."""
    for batch in sliced(batches):
        segments = batch.column(0).to_numpy(zero_copy_only=False)
        x = expand(batch.column(1))
        for seg in pd.unique(segments):
            yield seg, x[segments == seg]


def _bin_of(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bins of values between ``low`` and ``high``, in their order; the ends never share one."""
    width = high / 2 - low / 2
    if not width > 0:
        return (x > low).astype(np.int64)
    share = (x / 2 - low / 2) / width
    return np.where(x == high, BINS - 1, np.minimum((share * BINS).astype(np.int64), BINS - 2))


def _counted(train: DataFrame, expand: Expand, open_: dict[str, list[tuple[int, float, float]]] | None) -> DataFrame:
    """(segment, i, bin, n, low, high): the bins of interval ``i`` of ``open_``, or of column ``i`` as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        for seg, x in _parts(batches, expand):
            spans = [(i, -np.inf, np.inf) for i in range(x.shape[1])] if open_ is None else open_.get(seg, [])
            size = 1 if open_ is None else BINS
            for k, (i, low, high) in enumerate(spans):
                v = x[:, i]
                if open_ is None:
                    at = np.zeros(len(v), dtype=np.int64)
                else:
                    v = v[(v >= low) & (v <= high)]
                    at = _bin_of(v, low, high)
                if (seg, k) not in held:
                    held[seg, k] = [np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)]
                n, least, most = held[seg, k]
                n += np.bincount(at, minlength=size)
                np.minimum.at(least, at, v)
                np.maximum.at(most, at, v)
        for (seg, k), (n, least, most) in held.items():
            full = np.flatnonzero(n)
            columns = [pa.array([seg] * len(full), pa.string()), pa.array(np.full(len(full), k, np.int32)), pa.array(full.astype(np.int32))]
            columns += [pa.array(a[full]) for a in (n, least, most)]
            yield pa.RecordBatch.from_arrays(columns, [S.SEGMENT, "i", "bin", "n", "low", "high"])

    return (
        train.select(S.SEGMENT, "base")
        .mapInArrow(run, _COUNTED)
        .groupBy(S.SEGMENT, "i", "bin")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    )


def column_quantiles(train: DataFrame, expand: Expand, probs: list[float]) -> dict[str, np.ndarray]:
    """Exact quantiles with linear interpolation, per segment an array of ``probs`` x columns.

    ``train`` has segment and ``base``, from which ``expand`` makes the matrix rows. What is kept between passes is a
    few numbers per segment and column.
    """
    columns: dict[str, int] = {}
    found: dict[tuple[str, int, int], float] = {}
    sizes: dict[str, int] = {}
    wanted: dict[tuple[str, int], tuple[int, list[int]]] = {}  # interval -> rows before it, its ranks
    open_: dict[str, list[tuple[int, float, float]]] = {}
    for r in _counted(train, expand, None).collect():
        seg = r[S.SEGMENT]
        sizes[seg], columns[seg] = r.n, max(columns.get(seg, 0), r.i + 1)
        ranks = sorted({k for q in probs for k in _ranks(r.n, q)})
        _settle(seg, r.i, r.low, r.high, 0, ranks, found, open_, wanted)
    spark = train.sparkSession
    earlier = Window.partitionBy(S.SEGMENT, "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while open_:
        now, asked = open_, wanted
        open_, wanted = {}, {}
        # A row per open interval: a few for each segment and column.
        places = spark.createDataFrame(
            [(seg, k, before, ranks) for (seg, k), (before, ranks) in asked.items()],
            f"{S.SEGMENT} string, i int, before long, ranks array<bigint>",
        )
        start = F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
        held = lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n"))
        hits = (
            _counted(train, expand, now)
            .join(places, [S.SEGMENT, "i"])
            .withColumn("start", start)
            .withColumn("ranks", F.filter("ranks", held))
            .where(F.size("ranks") > 0)
        )
        for r in hits.collect():
            column = now[r[S.SEGMENT]][r.i][0]
            _settle(r[S.SEGMENT], column, r.low, r.high, r.start, r.ranks, found, open_, wanted)
    out = {}
    for seg, width in columns.items():
        out[seg] = np.empty((len(probs), width))
        for a, q in enumerate(probs):
            low, high = _ranks(sizes[seg], q)
            share = (sizes[seg] - 1) * q - low
            for i in range(width):
                x, y = found[seg, i, low], found[seg, i, high]
                out[seg][a, i] = x if x == y else x + (y - x) * share
    return out


def _ranks(n: int, q: float) -> tuple[int, int]:
    low = int(np.floor((n - 1) * q))
    return low, min(low + 1, n - 1)


def _settle(seg, column, low, high, before, ranks, found, open_, wanted) -> None:
    """Note the value of ``ranks`` if the interval has only one, else leave the interval open."""
    if low == high:
        found.update({(seg, column, k): low for k in ranks})
    else:
        spans = open_.setdefault(seg, [])
        wanted[seg, len(spans)] = before, ranks
        spans.append((column, low, high))


def _sums(train: DataFrame, expand: Expand, around: dict[str, np.ndarray] | None) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per segment: rows, and per column the sum and the sum of squares of the distance to ``around``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for seg, x in _parts(batches, expand):
            d = x if around is None else x - around[seg]
            n, total, squares = held.get(seg, (0, 0.0, 0.0))
            held[seg] = [n + len(d), total + d.sum(axis=0), squares + np.einsum("ij,ij->j", d, d)]
        for seg, (n, total, squares) in held.items():
            i = np.arange(len(total), dtype=np.int32)
            columns = [pa.array([seg] * len(i), pa.string()), pa.array(i), pa.array(np.full(len(i), n)), pa.array(total), pa.array(squares)]
            yield pa.RecordBatch.from_arrays(columns, [S.SEGMENT, "i", "n", "a", "b"])

    parts = train.select(S.SEGMENT, "base").mapInArrow(run, f"{S.SEGMENT} string, i int, n long, a double, b double")
    rows = parts.groupBy(S.SEGMENT, "i").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    made = {}
    for seg, part in rows.sort_values("i").groupby(S.SEGMENT):
        made[seg] = int(part["n"].iloc[0]), part["a"].to_numpy(), part["b"].to_numpy()
    return made


def column_moments(train: DataFrame, expand: Expand) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation of every column per segment; values far from zero lose no digits."""
    first = {seg: total / n for seg, (n, total, _) in _sums(train, expand, None).items()}
    second = _sums(train, expand, first)
    return {
        seg: (first[seg] + off / n, np.sqrt(np.maximum(squares / n - (off / n) ** 2, 0.0)))
        for seg, (n, off, squares) in second.items()
    }
