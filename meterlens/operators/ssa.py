"""Singular spectrum smoothing of every client's series.

The smoothed value is a linear filter of the neighbouring readings. The filter follows from the
leading eigenvectors of a small matrix of lag products, so a series needs its lag products, one small
eigenproblem and one filter pass; the trajectory matrix is never built. A series that fits one task is
done in one step; a longer one adds up the products of its blocks first and is filtered block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens import schema as S
from meterlens.config import JobParams, SsaParams
from meterlens.operators.blocks import Blocks
from meterlens.operators.series import lag_arrays

#: Rows with lags that leave Python at once.
SLICE_ROWS = 4096


def lag_products(v: np.ndarray, pos: np.ndarray, core: np.ndarray, n: int, size: int) -> np.ndarray:
    """Sums of v[t]*v[t+d] over the trajectory columns, then both ends of the series, as one vector.

    ``v`` is a run of consecutive rows; only its ``core`` rows are counted, so the vectors of the
    blocks of a series add up to that of the series.
    """
    columns = n - size + 1
    out = np.zeros(3 * size - 2)
    first, last = np.flatnonzero(core)[[0, -1]]
    stop = min(last + 1, first + max(columns - int(pos[first]), 0))
    if stop > first:
        ahead = np.lib.stride_tricks.sliding_window_view(v[first : stop + size - 1], size)
        out[:size] = v[first:stop] @ ahead
    head = core & (pos < size - 1)
    out[size + pos[head]] = v[head]
    tail = core & (pos >= columns)
    out[2 * size - 1 + pos[tail] - columns] = v[tail]
    return out


def _gram(products: np.ndarray, size: int) -> np.ndarray:
    """Matrix of lag products from its first row and the two ends of the series."""
    sums, head, tail = np.split(products, [size, 2 * size - 1])
    # Moving both indices on by one drops the first product and gains one past the end.
    i, j, upper, lower = _diagonals(size)
    change = np.zeros((size, size))  # by row and diagonal
    change[0] = sums
    change[i + 1, j - i] = (np.outer(tail, tail) - np.outer(head, head))[i, j]
    g = np.zeros((size, size))
    g[upper, lower] = change.cumsum(axis=0)[upper, lower - upper]
    return g + np.triu(g, 1).T


@lru_cache(maxsize=8)
def _diagonals(size: int) -> tuple[np.ndarray, ...]:
    """Places on and above the diagonal of a matrix one smaller than ``size``, then of one of ``size``."""
    return *np.triu_indices(size - 1), *np.triu_indices(size)


def filter_taps(products: np.ndarray, n: int, size: int, rank: int) -> np.ndarray:
    """Filter weights: (2L-1 row kinds) x (2L-1 offsets).

    Kind r < L-1 is the r-th row of a series, kind L-1 any inner row, the rest count from the end.
    A series of at most 2L-1 rows has one kind per row.
    """
    _, vectors = np.linalg.eigh(_gram(products, size))
    lead = vectors[:, -rank:]
    projector = lead @ lead.T
    kinds = 2 * size - 1
    upto = np.zeros((size + 1, kinds))  # running sums over projector rows, by offset
    i = np.arange(size)[:, None]
    upto[i + 1, size - 1 - i + i.T] = projector
    upto = upto.cumsum(axis=0)
    kind = np.arange(kinds)
    final = np.minimum(kind, size - 1)
    first = np.maximum(0, kind - (n - size if n <= kinds else size - 1))
    first = np.minimum(first, final)  # kinds past the end of a short series are never used
    return (upto[final + 1] - upto[first]) / (final - first + 1)[:, None]


def apply_taps(v: np.ndarray, pos: np.ndarray, n: int, taps: np.ndarray) -> np.ndarray:
    """Filtered values of a run of consecutive rows (rows cut off from neighbours come out partial)."""
    kinds = len(taps)
    size = (kinds + 1) // 2
    padded = np.concatenate([np.zeros(size - 1), v, np.zeros(size - 1)])
    out = np.convolve(padded, taps[size - 1][::-1], mode="valid")
    edge = np.flatnonzero((pos < size - 1) | (pos > n - size))
    kind = np.where((n <= kinds) | (pos < size - 1), pos, pos - n + kinds)
    around = np.lib.stride_tricks.sliding_window_view(padded, kinds)[edge]
    out[edge] = np.einsum("ij,ij->i", taps[kind[edge]], around)
    return out


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    pos = table["pos"].to_numpy()
    if np.any(np.diff(pos) < 0):
        order = np.argsort(pos)
        return table.take(pa.array(order)), pos[order]
    return table, pos


def smooth(
    blocks: Blocks, p: SsaParams = SsaParams(), col: str = S.VOLUME, out: str = "v_filt"
) -> Blocks:
    """Add the smoothed series; a series of at most ``window`` rows passes through."""
    size, rank = p.window, p.rank
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.df.schema.fields)
    layout += f", {out} double"

    def filtered(table: pa.Table) -> pa.Table:
        table, pos = _in_order(table)
        v, n = table[col].to_numpy(), table["n_rows"][0].as_py()
        if n <= size:
            values = v
        elif "taps" in table.column_names:
            taps = np.asarray(table["taps"][0].as_py()).reshape(2 * size - 1, -1)
            values = apply_taps(v, pos, n, taps)
        else:
            products = lag_products(v, pos, np.ones(n, dtype=bool), n, size)
            values = apply_taps(v, pos, n, filter_taps(products, n, size, rank))
        if "taps" in table.column_names:
            table = table.drop_columns(["taps"])
        return table.append_column(out, pa.array(values))

    df = blocks.df
    if blocks.size:
        df = blocks.attach(_series_taps(blocks, col, p)).df.select(*df.columns, "taps")
    return blocks.using(size - 1, size - 1).on(df.groupBy(*blocks.group).applyInArrow(filtered, layout))


def smooth_lagged(blocks: Blocks, p: JobParams = JobParams()) -> Blocks:
    """``lag_arrays`` of the smoothed series, both in the one pass that has each series in order.

    The rows of a partition come series after series, many in a batch, so a short series costs no call of its own. No
    window has to shuffle and sort them again. Cut series go through the windows of their blocks.
    """
    f, out = p.forecast, "v_filt"
    if blocks.size:
        return lag_arrays(smooth(blocks, p.ssa), out, f)
    size, rank, first = p.ssa.window, p.ssa.rank, f.maxlag
    layout = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in blocks.df.schema.fields)
    layout += f", {out} double, base array<double>, volume_next double"

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows of whole series that lie one after the other."""
        table = table.combine_chunks()
        v, pos, length = (table[c].to_numpy() for c in (S.VOLUME, "pos", "n_rows"))
        values = v.copy()
        for a in np.flatnonzero(pos == 0).tolist():
            n = int(length[a])
            if n > size:
                mine, at = v[a : a + n], pos[a : a + n]
                taps = filter_taps(lag_products(mine, at, np.ones(n, dtype=bool), n, size), n, size, rank)
                values[a : a + n] = apply_taps(mine, at, n, taps)
        usable = np.flatnonzero((pos >= first) & (pos < length - 1))
        for a in range(0, len(usable), SLICE_ROWS):
            rows = usable[a : a + SLICE_ROWS]
            ago = lambda x, lags: x[rows[:, None] - np.arange(lags)]
            exo = [ago(table[c].to_numpy(), f.lags_exo) for c in (S.PRESSURE, S.TEMPERATURE)]
            base = np.hstack([ago(values, f.lags_v), np.stack(exo, axis=2).reshape(len(rows), -1)])
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * base.shape[1])
            used = table.take(pa.array(rows)).append_column(out, pa.array(values[rows]))
            used = used.append_column("base", pa.ListArray.from_arrays(offsets, pa.array(base.ravel())))
            yield from used.append_column("volume_next", pa.array(v[rows + 1])).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # begins with a series that may go on in the next batch
        for batch in batches:
            starts = np.flatnonzero(batch.column("pos").to_numpy() == 0)
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                yield from made(pa.Table.from_batches(held))
                held = []
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from made(pa.Table.from_batches(held))

    # The windows that numbered the rows left them in this order; where they did, nothing is sorted again.
    ordered = blocks.df.sortWithinPartitions(*blocks.group, *blocks.order)
    return blocks.on(ordered.mapInArrow(run, layout))


def _series_taps(blocks: Blocks, col: str, p: SsaParams) -> DataFrame:
    """Per series cut into blocks: its length and filter weights."""
    size, rank, keys = p.window, p.rank, list(blocks.keys)
    fields = {f.name: f.dataType.simpleString() for f in blocks.df.schema.fields}
    layout = ", ".join(f"{k} {fields[k]}" for k in keys) + ", n_rows bigint, products array<double>"

    def products(table: pa.Table) -> pa.Table:
        table, pos = _in_order(table)
        n = table["n_rows"][0].as_py()
        core = table["is_core"].to_numpy(zero_copy_only=False)
        made = np.zeros(3 * size - 2)
        if n > size and core.any():
            made = lag_products(table[col].to_numpy(), pos, core, n, size)
        return table.slice(0, 1).select([*keys, "n_rows"]).append_column("products", pa.array([made]))

    slim = blocks.df.select(*blocks.group, "pos", "n_rows", "is_core", col)
    per_block = slim.groupBy(*blocks.group).applyInArrow(products, layout)
    summed = (
        per_block.select(*keys, "n_rows", F.posexplode("products").alias("i", "x"))
        .groupBy(*keys, "n_rows", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy(*keys, "n_rows")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_p"))
    )

    @F.arrow_udf("array<double>")
    def solve(n: pa.Array, vectors: pa.Array) -> pa.Array:
        made = [
            filter_taps(np.asarray(x.as_py()), a.as_py(), size, rank).ravel() if a.as_py() > size else None
            for a, x in zip(n, vectors)
        ]
        return pa.array(made, type=pa.list_(pa.float64()))

    return summed.select(*keys, "n_rows", solve("n_rows", F.col("_p.x")).alias("taps"))
