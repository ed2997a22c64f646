"""Statistics against plain numpy."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.operators import explore
from meterlens.operators.blocks import series_blocks


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(4)
    n = 400
    sets = {
        "walk": rng.normal(size=n).cumsum(),
        "noise": rng.normal(size=n),
        "wave": np.sin(np.arange(n) * 2 * np.pi / 24) + 0.1 * rng.normal(size=n),
        "short": rng.normal(size=12),
    }
    rows = [(k, i, float(x)) for k, v in sets.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "client_id string, o int, volume double")
    return sets, series_blocks(df, 60, 60, order=["o"]), df


def ols(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    ssr = ((y - x @ beta) ** 2).sum()
    return beta, ssr, np.linalg.inv(x.T @ x)


def plain_adf(x):
    n, dx = len(x), np.diff(x)
    p = explore.adf_max_lag(n)

    def fit(lag, start):
        t = np.arange(start, n)
        z = np.column_stack([np.ones(len(t)), x[t - 1], *[dx[t - 1 - k] for k in range(1, lag + 1)]])
        return dx[t - 1], z

    best = min(range(p + 1), key=lambda k: (lambda y, z: len(y) * math.log(ols(y, z)[1] / len(y)) + 2 * z.shape[1])(*fit(k, p + 1)))
    y, z = fit(best, best + 1)
    beta, ssr, inv = ols(y, z)
    return best, beta[1] / math.sqrt(ssr / (len(y) - z.shape[1]) * inv[1, 1])


def test_adf(walk):
    sets, blocks, _ = walk
    got = {r.client_id: r for r in explore.adf(blocks, "volume").collect()}
    for name in ("walk", "noise", "wave"):
        lag, stat = plain_adf(sets[name])
        assert got[name].used_lag == lag and got[name].adf_stat == pytest.approx(stat, rel=1e-6)
    assert got["noise"].adf_stationary and not got["walk"].adf_stationary
    assert got["short"].adf_stat is None
    assert got["noise"].adf_crit["5%"] == pytest.approx(-2.87, abs=0.02)


def test_kpss(walk):
    sets, blocks, _ = walk
    got = {r.client_id: r for r in explore.kpss(blocks, "volume").collect()}
    for name in ("walk", "noise", "wave"):
        e = sets[name] - sets[name].mean()
        n, lags = len(e), got[name].lags
        spread = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))) / n
        assert got[name].kpss_stat == pytest.approx((e.cumsum() ** 2).sum() / n**2 / spread, rel=1e-9)
    assert got["noise"].kpss_stationary and not got["walk"].kpss_stationary
    assert got["short"].kpss_stat is None


@pytest.mark.parametrize("own, margin, lags", [(1, 0, 1), (30, 7, 401), (5000, 400, 401), (3000, 0, 401), (2500, 60, 1500)])
def test_lag_products_by_pieces(own, margin, lags):
    x = np.random.default_rng(own).normal(size=own + margin)
    got = explore._lag_products_of(x[:own], x, lags)
    want = [x[: min(own, len(x) - k)] @ x[k : k + min(own, len(x) - k)] if k < len(x) else 0.0 for k in range(lags)]
    assert np.allclose(got, want, atol=1e-9)


def test_period_and_partial_correlations(walk):
    sets, blocks, _ = walk
    sums = explore.lag_sums(blocks, "volume", 40)
    periods = {r.client_id: r.period for r in explore.seasonal_period(sums, ["client_id"]).collect()}
    assert periods["wave"] == 1 and periods["noise"] is None and periods["short"] is None
    acf = explore.autocorrelation(sums, ["client_id"])
    pacf = {(r.client_id, r.lag): r.pacf for r in explore.partial_autocorrelation(acf, ["client_id"]).collect()}
    x = sets["walk"] - sets["walk"].mean()
    rho = np.array([x[k:] @ x[: len(x) - k] for k in range(6)]) / (x @ x)
    for k in range(1, 6):
        toeplitz = rho[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert pacf[("walk", k)] == pytest.approx(np.linalg.solve(toeplitz, rho[1 : k + 1])[-1])


@pytest.mark.parametrize("period", [7, 24])
def test_decomposition(walk, period):
    sets, blocks, _ = walk
    out = explore.decompose(blocks, "volume", period).core().toPandas()
    x, half = sets["wave"], period // 2
    w = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(len(x), np.nan)
    trend[half : len(x) - half] = np.convolve(x, w, "valid")
    front, back = half, len(x) - half - 1
    a = np.arange(front, front + period)
    trend[:front] = np.polyval(np.polyfit(a, trend[a], 1), np.arange(front))
    b = np.arange(back - period, back)
    trend[back + 1 :] = np.polyval(np.polyfit(b, trend[b], 1), np.arange(back + 1, len(x)))
    means = np.array([(x - trend)[i::period].mean() for i in range(period)])
    g = out[out.client_id == "wave"].sort_values("pos")
    assert np.allclose(g.trend, trend)
    assert np.allclose(g.seasonal, np.resize(means - means.mean(), len(x)))
    assert np.allclose(g.trend + g.seasonal + g.resid, x)
    assert "short" not in set(out.client_id)


def test_anderson_darling(walk, spark):
    _, _, df = walk
    tied = df.withColumn("volume", F.round("volume", 1))
    for frame in (df, tied):
        x = np.sort(frame.toPandas().volume.to_numpy())
        n, z = len(x), NormalDist(x.mean(), x.std(ddof=1))
        i = np.arange(1, n + 1)
        cdf = np.array([z.cdf(v) for v in x])
        want = -n - ((2 * i - 1) / n * (np.log(cdf) + np.log(1 - cdf[::-1]))).sum()
        got = explore.anderson_darling(frame, ["volume"]).first()
        assert got.anderson_stat == pytest.approx(want, rel=1e-6)
    assert got.anderson_crit == pytest.approx([0.576, 0.656, 0.787, 0.918, 1.092], abs=0.01)


def test_jarque_bera_formula(spark):
    one = spark.createDataFrame([(847946, -0.130866420309569, -0.13302427261597893)], "n long, skew double, kurtosis double")
    assert explore.jarque_bera(one).first().jarque_bera == pytest.approx(3045.523, abs=1e-3)
    assert explore.dagostino(one).first().dagostino_k2 == pytest.approx(3118.3826, abs=1e-3)


def test_tail_of_the_normal(spark):
    from meterlens.functions.normal import normal_logcdf, normal_quantile

    df = spark.createDataFrame([(-40.0,), (-9.9,), (-10.1,), (0.0,), (6.0,)], "z double").select(normal_logcdf(F.col("z")).alias("l"))
    got = [r.l for r in df.collect()]
    assert got[0] == pytest.approx(-804.608, abs=1e-2) and got[3] == pytest.approx(math.log(0.5))
    assert got[1] == pytest.approx(-52.2264, abs=1e-4)
    assert got[4] == pytest.approx(-9.8659e-10, rel=1e-3)
    q = spark.range(1).select(normal_quantile(F.lit(0.975)).alias("q")).first().q
    assert q == pytest.approx(1.959964, abs=1e-6)


def test_qq_and_boxplot(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(500.0,)], "volume double")
    box = explore.boxplot(df, ["volume"]).first()
    assert (box.median, box.whisker_high, box.n_outliers) == (51.0, 100.0, 1)
    points = explore.qq_points(df, ["volume"]).toPandas().sort_values("i")
    assert len(points) == 99 and points.theory.is_monotonic_increasing and points["sample"].is_monotonic_increasing
