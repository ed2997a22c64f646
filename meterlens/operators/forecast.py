"""Next-hour forecast: design matrix, scaling, elastic net, error measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterlens import schema as S
from meterlens.config import ForecastParams
from meterlens.operators import scaling
from meterlens.operators.blocks import segment_rows
from meterlens.operators.series import lag_names


@dataclass(frozen=True)
class Design:
    """Column layout of the design matrix: the lags, then the expansion of some of them."""

    base: tuple[str, ...]
    expanded: tuple[str, ...]

    @classmethod
    def of(cls, p: ForecastParams) -> Design:
        base = tuple(lag_names(p))
        if p.poly_degree <= 1:
            return cls(base, ())
        if p.poly_degree != 2:
            raise ValueError("poly_degree must be 1 or 2")
        chosen = {f"vf_lag{k}" for k in range(p.poly_v)} | {f"p_lag{k}" for k in range(p.poly_p)}
        chosen |= {f"t_lag{k}" for k in range(p.poly_t)}
        return cls(base, tuple(c for c in base if c in chosen))

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return list(combinations_with_replacement(self.expanded, 2))

    @property
    def names(self) -> list[str]:
        return [*self.base, *self.expanded, *[f"{a}*{b}" for a, b in self.pairs]]

    def matrix(self, base: np.ndarray) -> np.ndarray:
        """The full design matrix of a batch whose columns are ``base``."""
        if not self.expanded:
            return base
        at = {c: i for i, c in enumerate(self.base)}
        left = [at[a] for a, _ in self.pairs]
        right = [at[b] for _, b in self.pairs]
        linear = base[:, [at[c] for c in self.expanded]]
        return np.concatenate([base, linear, base[:, left] * base[:, right]], axis=1)


def _unnest(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nested(x: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel()))


def design_array(p: ForecastParams) -> Column:
    """The full design matrix row as an array over ``base``."""
    design = Design.of(p)
    width = len(design.base)

    @F.arrow_udf("array<double>")
    def expand(base: pa.Array) -> pa.Array:
        return _nested(design.matrix(_unnest(base, width)))

    return expand(F.col("base"))


def fit_scaler(train: DataFrame, p: ForecastParams) -> DataFrame:
    """One row per segment: ``center`` and ``scale`` arrays over the design matrix columns.

    Spreads of zero become one. Without rows the result is empty.
    """
    design = Design.of(p)
    expand = lambda base: design.matrix(_unnest(base, len(design.base)))
    if p.scaler == "robust":
        quartiles = scaling.column_quantiles(train, expand, [0.25, 0.5, 0.75])
        stats = {seg: (q[1], q[2] - q[0]) for seg, q in quartiles.items()}
    else:
        stats = scaling.column_moments(train, expand)
    rows = [(seg, m.tolist(), np.where(s == 0, 1.0, s).tolist()) for seg, (m, s) in stats.items()]
    return train.sparkSession.createDataFrame(rows, f"{S.SEGMENT} string, center array<double>, scale array<double>")


#: Columns of one page of co-moments: a page is ``PAGE`` rows of the matrix, laid end to end.
MOMENTS = f"{S.SEGMENT} string, page int, n double, mean array<double>, rows array<double>"
PAGE = 16


class _CoMoments:
    """Count, mean and centred products of the columns of all rows so far.

    Two parts are joined by their difference of means (pairwise update), so a level far above the spread costs no digits.
    """

    def __init__(self, n: float, mean: np.ndarray, products: np.ndarray, at: slice = slice(None)):
        self.n, self.mean, self.products, self.at = n, mean, products, at

    @classmethod
    def of(cls, x: np.ndarray) -> _CoMoments:
        mean = x.mean(axis=0)
        x = x - mean
        return cls(float(len(x)), mean, x.T @ x)

    def add(self, other: _CoMoments) -> None:
        n = self.n + other.n
        apart = other.mean - self.mean
        self.products += other.products + np.outer(apart[self.at], apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n


def _read_pages(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], _CoMoments]]:
    for r in batch.to_pylist():
        mean = np.asarray(r["mean"])
        at = slice(r["page"] * PAGE, (r["page"] + 1) * PAGE)
        products = np.asarray(r["rows"]).reshape(-1, len(mean))
        yield (r[S.SEGMENT], r["page"]), _CoMoments(r["n"], mean, products, at)


def _write_pages(pages: list[tuple[str, int, float, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    segment, page, n, mean, rows = zip(*pages)
    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_pydict(
        {
            S.SEGMENT: pa.array(segment, pa.string()),
            "page": pa.array(page, pa.int32()),
            "n": pa.array(n, pa.float64()),
            "mean": pa.array(list(mean), doubles),
            "rows": pa.array([r.ravel() for r in rows], doubles),
        }
    )


def _merge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the parts of each page as they come; one page per key is held, however many tasks sent parts."""
    held: dict[tuple[str, int], _CoMoments] = {}
    for batch in batches:
        for key, part in _read_pages(batch):
            if key in held:
                held[key].add(part)
            else:
                held[key] = part
    if held:
        yield _write_pages([(seg, page, m.n, m.mean, m.products) for (seg, page), m in held.items()])


def moment_rows(train: DataFrame, scaler: DataFrame, p: ForecastParams) -> DataFrame:
    """Centred products of (scaled features, target) per segment, one row per page of the matrix (``MOMENTS``).

    Each task joins the moments of its batches; the pages of all tasks are then joined, a few matrix rows per key.
    """
    design = Design.of(p)
    scales = {
        r[S.SEGMENT]: (np.asarray(r["center"]), np.asarray(r["scale"])) for r in segment_rows(scaler)
    }
    width, size = len(design.base), len(design.names) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, _CoMoments] = {}
        for batch in scaling.sliced(batches):
            segments = batch.column(0).to_numpy(zero_copy_only=False)
            x = design.matrix(_unnest(batch.column(1), width))
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for seg in pd.unique(segments):
                mine = segments == seg
                centre, scale = scales[seg]
                part = _CoMoments.of(np.column_stack([(x[mine] - centre) / scale, y[mine]]))
                if seg in sums:
                    sums[seg].add(part)
                else:
                    sums[seg] = part
        for seg, m in sums.items():
            starts = range(0, size, PAGE)
            yield _write_pages([(seg, i // PAGE, m.n, m.mean, m.products[i : i + PAGE]) for i in starts])

    parts = train.select(S.SEGMENT, "base", "volume_next").mapInArrow(partial, MOMENTS)
    return parts.repartition(S.SEGMENT, "page").mapInArrow(_merge_pages, MOMENTS)


def elastic_net(gram: np.ndarray, xy: np.ndarray, n: float, yy: float, p: ForecastParams) -> np.ndarray:
    """Minimise 1/(2n)|y-Xw|^2 + a*r|w|_1 + a*(1-r)/2|w|^2 by cyclic coordinate descent.

    Works on centred moments only. Stops on a duality gap far below ``tol`` times the variance, which
    is checked once a sweep moves no coefficient by more than ``tol``.
    """
    l1, l2 = p.alpha * p.l1_ratio * n, p.alpha * (1 - p.l1_ratio) * n
    w = np.zeros(len(xy))
    residual = xy.copy()  # X'(y - Xw)
    diagonal = np.diagonal(gram)
    for _ in range(p.max_iter):
        largest = step = 0.0
        for j in np.flatnonzero(diagonal > 0):
            old = w[j]
            pull = residual[j] + diagonal[j] * old
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (diagonal[j] + l2)
            if new != old:
                residual -= gram[:, j] * (new - old)
                w[j] = new
            largest, step = max(largest, abs(new)), max(step, abs(new - old))
        if largest == 0.0 or step <= 1e-9 * largest:
            break
        if step <= p.tol * largest and _gap(w, residual, gram, xy, yy, l1, l2) <= 1e-3 * p.tol * yy:
            break
    return w


def _gap(w, residual, gram, xy, yy, l1, l2) -> float:
    ww = w @ w
    rr = max(yy - 2 * w @ xy + w @ gram @ w, 0.0)  # |y - Xw|^2
    ry = yy - w @ xy
    bound = np.max(np.abs(residual - l2 * w))
    shrink = min(1.0, l1 / bound) if bound > 0 else 1.0
    primal_dual = 0.5 * rr * (1 + shrink**2) if shrink < 1 else rr
    return primal_dual + l1 * np.abs(w).sum() - shrink * ry + 0.5 * l2 * (1 + shrink**2) * ww


def fit_elastic_net(moments: DataFrame, p: ForecastParams) -> DataFrame:
    """One row per segment: ``coef`` over the scaled design matrix, ``intercept``, ``n_train``."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page")
        n, mean = rows["n"].iloc[0], rows["mean"].iloc[0]
        centred = np.concatenate([np.reshape(r, (-1, len(mean))) for r in rows["rows"]])
        w = elastic_net(centred[:-1, :-1], centred[:-1, -1], n, centred[-1, -1], p)
        return pd.DataFrame(
            {
                S.SEGMENT: rows[S.SEGMENT].iloc[:1].to_numpy(),
                "coef": [w],
                "intercept": [mean[-1] - mean[:-1] @ w],
                "n_train": [int(n)],
            }
        )

    layout = f"{S.SEGMENT} string, coef array<double>, intercept double, n_train bigint"
    return moments.groupBy(S.SEGMENT).applyInPandas(solve, layout)


def predictor(models: DataFrame, p: ForecastParams) -> Column:
    """The forecast as a column over ``segment`` and ``base``.

    ``models`` has one row per segment (a few hundred numbers), so it travels with the function. A
    model whose width fits the lags only is applied without the expansion.
    """
    design = Design.of(p)
    plain = Design(design.base, ())
    width = len(design.base)
    raw = {}
    for r in segment_rows(models):
        slope = np.asarray(r["coef"]) / np.asarray(r["scale"])
        layout = design if len(slope) == len(design.names) else plain
        if len(slope) != len(layout.names):
            raise ValueError(f"model of segment {r[S.SEGMENT]} has {len(slope)} coefficients")
        raw[r[S.SEGMENT]] = (layout, slope, r["intercept"] - slope @ np.asarray(r["center"]))

    @F.arrow_udf("double")
    def forecast(segment: pa.Array, base: pa.Array) -> pa.Array:
        x = _unnest(base, width)
        segments = segment.to_numpy(zero_copy_only=False)
        out = np.full(len(x), np.nan)
        for seg in pd.unique(segments):
            if seg in raw:
                mine = np.flatnonzero(segments == seg)
                layout, slope, constant = raw[seg]
                for a in range(0, len(mine), scaling.SLICE_ROWS):  # a matrix row is wide
                    some = mine[a : a + scaling.SLICE_ROWS]
                    out[some] = layout.matrix(x[some]) @ slope + constant
        return pa.array(out, from_pandas=True)

    return forecast(F.col(S.SEGMENT), F.col("base"))


def forecast_errors(
    df: DataFrame, keys: Sequence[str] = (S.SEGMENT,), y: str = "volume_next", hat: str = "volume_hat"
) -> DataFrame:
    """RMSE, MAE, MAPE, sMAPE and R2 per key. Rows without both values do not count."""
    yc, e = F.col(y), F.col(y) - F.col(hat)
    both = df.where(yc.isNotNull() & F.col(hat).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.greatest(F.abs(yc), F.lit(1e-8))) * 100).alias("mape"),
        F.avg(F.abs(e) * 200 / (F.abs(yc) + F.abs(F.col(hat)) + 1e-8)).alias("smape"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(yc) * F.count(yc))).alias("r2"),
    )
