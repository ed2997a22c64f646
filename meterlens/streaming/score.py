"""Scoring a stream of readings with stored models.

Per client the state holds the last readings, residuals and the last z-score, all of fixed length. A
reading is scored when the next one arrives. Smoothing sees the past only: the lags come from smoothing
the buffered readings, while batch scoring also looks ahead, so forecasts near a turn differ from those
of the batch job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meterlens import schema as S
from meterlens.config import JobParams
from meterlens.operators import flags, forest
from meterlens.operators.blocks import segment_rows
from meterlens.operators.forecast import Design
from meterlens.plans.train import Models

STATE = "last_ts timestamp_ntz, seen bigint, v array<double>, p array<double>, t array<double>, r array<double>, z double"
SCORED = (
    f"{S.CLIENT} string, {S.SEGMENT} string, {S.TS} timestamp_ntz, volume_next double, volume_hat double, "
    "resid double, r_mean double, r_std double, z_abs double, dz_abs double, dr_abs double"
)


def smooth_windows(windows: np.ndarray, size: int, rank: int, last: int) -> np.ndarray:
    """The ``last`` smoothed values of every window (rows of equal length), all in one set of matrices.

    The same values as ``ssa.smooth`` gives a series that is just the window.
    """
    n = windows.shape[1]
    if n <= size:
        return windows[:, n - last :]
    columns = n - size + 1
    trajectory = np.lib.stride_tricks.sliding_window_view(windows, columns, axis=1)  # windows x size x columns
    _, vectors = np.linalg.eigh(trajectory @ trajectory.transpose(0, 2, 1))
    lead = vectors[:, :, -rank:]
    rebuilt = lead @ (lead.transpose(0, 2, 1) @ trajectory)
    places, starts, counts = _late_diagonals(n, size, last)
    return np.add.reduceat(rebuilt.reshape(len(windows), -1)[:, places], starts, axis=1) / counts


@lru_cache(maxsize=256)
def _late_diagonals(n: int, size: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ``last`` antidiagonals of a trajectory matrix laid out flat, where each begins, and its length."""
    columns = n - size + 1
    rows = [np.arange(max(0, t - columns + 1), min(size, t + 1)) for t in range(n - last, n)]
    counts = np.array([len(i) for i in rows])
    places = np.concatenate([i * columns + t - i for i, t in zip(rows, range(n - last, n))])
    return places, np.cumsum(counts) - counts, counts


def rolling_spread(resid: np.ndarray, m: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of up to ``width`` values up to each of the last ``m``; zeros below five values."""
    mean, std = np.zeros(m), np.zeros(m)
    first = len(resid) - m
    for k in range(min(m, max(0, width - 1 - first))):
        some = resid[: first + k + 1]
        if len(some) >= 5:
            mean[k], std[k] = some.mean(), some.std()
    whole = max(0, width - 1 - first)
    if whole < m:
        rows = np.lib.stride_tricks.sliding_window_view(resid, width)[first + whole - width + 1 :]
        mean[whole:], std[whole:] = rows.mean(axis=1), rows.std(axis=1)
    return mean, std


def stream_residuals(readings: DataFrame, models: Models, p: JobParams = JobParams()) -> DataFrame:
    """Forecast residuals and their features, one row per reading that has a successor."""
    f, design = p.forecast, Design.of(p.forecast)
    size, rank = p.ssa.window, p.ssa.rank
    keep, width = max(2 * size - 1, f.lags_v), max(5, p.anomaly.roll_window)
    raw = {}
    for row in segment_rows(models.forecast):
        slope = np.asarray(row["coef"]) / np.asarray(row["scale"])
        raw[row[S.SEGMENT]] = (slope, row["intercept"] - slope @ np.asarray(row["center"]))

    def forecasts(segment: str, seen: int, v: np.ndarray, pr: np.ndarray, te: np.ndarray, m: int) -> np.ndarray:
        """Forecasts of the last ``m`` values of ``v`` from those before each; NaN where too few stand before."""
        hats = np.full(m, np.nan)
        at = np.arange(len(v) - m, len(v))
        start = np.maximum(0, at - keep)
        able = np.flatnonzero(seen + np.arange(m) > f.maxlag)
        if not len(able):
            return hats
        lags, reach = np.empty((m, f.lags_v)), at - start
        for n in np.unique(reach[able]):
            ks = able[reach[able] == n]
            windows = v[at[ks, None] - n + np.arange(n)]
            lags[ks] = smooth_windows(windows, size, rank, f.lags_v)[:, ::-1]
        ago = at[able, None] - len(v) - 1 - np.arange(f.lags_exo)  # from the end: the buffers differ in length
        exo = np.stack([pr[ago], te[ago]], axis=2).reshape(len(able), -1)
        slope, constant = raw[segment]
        hats[able] = design.matrix(np.hstack([lags[able], exo])) @ slope + constant
        return hats

    def advance(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        client, segment = key
        batch = pd.concat(list(frames)).sort_values(S.TS, kind="stable").drop_duplicates(S.TS)
        last_ts, seen, *buffers, z = state.get if state.exists else (None, 0, [], [], [], [], None)
        if last_ts is not None:
            batch = batch[batch[S.TS] > last_ts]  # the successors of late readings are scored already
        m = len(batch)
        v, pr, te = (
            np.concatenate([np.asarray(old, dtype=float), batch[c].to_numpy(dtype=float)])
            for old, c in zip(buffers, (S.VOLUME, S.PRESSURE, S.TEMPERATURE))
        )
        rs, out = list(buffers[3]), []
        if m and segment in raw:
            hats = forecasts(segment, seen, v, pr, te, m)
            known = np.flatnonzero(~np.isnan(hats))
            if len(known):
                before_ts = [last_ts, *batch[S.TS].iloc[:-1]]
                vol, hat = v[len(v) - m :][known], hats[known]
                resid = vol - hat
                every = np.concatenate([rs, resid])
                mean, std = rolling_spread(every, len(known), width)
                std = np.where(std > 0, std, 1e-6)
                now = (resid - mean) / std
                was = np.concatenate([[now[0] if z is None else z], now[:-1]])
                before = np.concatenate([[rs[-1] if rs else resid[0]], resid[:-1]])
                made = (vol, hat, resid, mean, std, np.abs(now), np.abs(now - was), np.abs(resid - before))
                out = [(client, segment, before_ts[k], *row) for k, *row in zip(known, *(x.tolist() for x in made))]
                rs, z = every[-width:].tolist(), float(now[-1])
        if m:
            last_ts, seen = batch[S.TS].iloc[-1], seen + m
        tail = lambda x, n: x[max(0, len(x) - n) :].tolist()
        state.update((last_ts, seen, tail(v, keep), tail(pr, f.lags_exo), tail(te, f.lags_exo), rs, z))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])

    slim = readings.select(S.CLIENT, S.SEGMENT, S.TS, *S.MEASURES)
    return slim.groupBy(S.CLIENT, S.SEGMENT).applyInPandasWithState(
        advance, SCORED, STATE, "append", GroupStateTimeout.NoTimeout
    )


def score_stream(readings: DataFrame, models: Models, p: JobParams = JobParams()) -> DataFrame:
    """Flags of a stream, with the score range and cut-off stored at training time."""
    made = stream_residuals(readings, models, p)
    used = {r[S.SEGMENT]: r["forest_samples"] for r in segment_rows(models.thresholds)}
    # The join comes first: the scoring function cannot read the rows of the stateful step directly.
    limits = models.thresholds.drop("forest_samples")
    limited = made.join(limits, S.SEGMENT, "left")
    scored = limited.withColumn("score", forest.scorer(limited, forest.load_forests(models.forest, used)))
    flagged = flags.flag(scored, None, p.anomaly)
    return flagged.drop("score").withColumn("severity", flags.severity(p=p.severity))
