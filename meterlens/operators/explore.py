"""Distribution, correlation and seasonality statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens import schema as S
from meterlens.functions.normal import normal_logcdf, normal_quantile
from meterlens.operators.blocks import Blocks, series_blocks
from meterlens.operators.columns import categorical_columns
from meterlens.operators.ordering import running_totals
from meterlens.operators.quantiles import exact_quantiles
from meterlens.session import cut

ALPHA = 0.05
MIN_POINTS = 20
# Published critical values of the tests.
ANDERSON_LEVELS = [15.0, 10.0, 5.0, 2.5, 1.0]
ANDERSON_BASE = [0.576, 0.656, 0.787, 0.918, 1.092]
KPSS_P = [0.10, 0.05, 0.025, 0.01]
KPSS_CRIT = [0.347, 0.463, 0.574, 0.739]


def null_counts(df: DataFrame) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column", "n_null")


def top_values(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The most frequent values of a column, null included."""
    counted = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)


def top_values_all(df: DataFrame, k: int = 20) -> DataFrame:
    """``top_values`` of every non-numeric column in one table."""
    cols = categorical_columns(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counted = (
        df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    # The ranking holds one row per distinct value: keep the k best of each slice of values first.
    order = [F.desc("n"), F.asc_nulls_first("value")]
    salted = counted.withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(64)))
    part = Window.partitionBy("column", "_s").orderBy(*order)
    whole = Window.partitionBy("column").orderBy(*order)
    best = salted.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= k)
    ranked = best.withColumn("_k", F.row_number().over(whole)).where(F.col("_k") <= k)
    return ranked.select("column", "value", "n")


def correlation(df: DataFrame, cols: Sequence[str] = (S.PRESSURE, S.TEMPERATURE, S.VOLUME)) -> DataFrame:
    """Pearson matrix, one row per variable, over the rows where both variables are known."""
    pairs = list(combinations_with_replacement(cols, 2))
    known = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))
    one = df.agg(*[F.corr(known(a, b), known(b, a)).alias(f"{a}:{b}") for a, b in pairs])
    cell = lambda a, b: F.col(f"`{a}:{b}`" if (a, b) in pairs else f"`{b}:{a}`").alias(b)
    rows = [F.struct(F.lit(a).alias("variable"), *[cell(a, b) for b in cols]) for a in cols]
    return one.select(F.inline(F.array(*rows)))


def median_profile(
    df: DataFrame, part: str, keys: Sequence[str] = (), col: str = S.VOLUME, *, max_values: int | None = None
) -> DataFrame:
    """Median volume by ``hour`` of day or ``weekday`` (0 = Monday)."""
    slot = F.hour(S.TS) if part == "hour" else F.weekday(S.TS)
    sliced = df.select(*keys, slot.alias(part), col)
    q = exact_quantiles(sliced, [*keys, part], [col], [0.5], max_values=max_values)
    return q.select(*keys, part, F.get(col, F.lit(0)).alias("median_volume"))


def sample_rows(df: DataFrame, n: int, key: Sequence[str] = (S.CLIENT, S.TS, S.ORD), seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows: those with the smallest seeded MD5 of their key's text."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))), *key).limit(n)


# --- normality -------------------------------------------------------------------------------


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, mean, standard deviations, skewness and excess kurtosis, one row per variable."""
    one = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.stddev_pop(c).alias("std_pop"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"),
            ).alias(c)
            for c in cols
        ]
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), f"{c}.*") for c in cols])))


def jarque_bera(m: DataFrame) -> DataFrame:
    stat = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4)
    p = F.exp(-stat / 2)  # chi-square with two degrees of freedom
    return m.withColumns({"jarque_bera": stat, "jarque_bera_p": p, "jarque_bera_normal": p > ALPHA})


def dagostino(m: DataFrame) -> DataFrame:
    """Omnibus K2 from the transformed skewness and kurtosis (D'Agostino-Pearson, Anscombe-Glynn).

    Null for variables of fewer than 8 values, which keep their other columns.
    """
    n, skew, kurt = F.when(F.col("n") >= 8, F.col("n").cast("double")), F.col("skew"), F.col("kurtosis")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z_skew = delta * F.asinh(y / alpha)
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / F.sqrt(variance)
    root = 6 * (n**2 - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / root**2))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - F.signum(inner) * F.abs(inner) ** (1 / 3.0)) / F.sqrt(2 / (9 * a))
    stat = z_skew**2 + z_kurt**2
    p = F.exp(-stat / 2)
    return m.withColumns({"dagostino_k2": stat, "dagostino_p": p, "dagostino_normal": p > ALPHA})


def _unpivot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(F.inline(pairs)).where(F.col("x").isNotNull())


def anderson_darling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2 against the normal with estimated mean and deviation, and its critical values.

    Equal values are counted together, so the ranks come from one running total over the distinct
    values. The i-th smallest of n weighs (2i-1) in log cdf and (2(n-i)+1) in log survival.
    """
    stats = df.agg(
        *[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in cols]
    ).select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), f"{c}.*") for c in cols])))
    counts = _unpivot(df, cols).groupBy("variable", "x").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_totals(counts, ["variable"], ["x"], {"upto": F.col("c")})
    z = (F.col("x") - F.col("mean")) / F.col("std")
    # Ranks upto-c+1 .. upto: their weights 2i-1 add up to upto^2 - (upto-c)^2.
    upto, before, n = F.col("upto").cast("double"), (F.col("upto") - F.col("c")).cast("double"), F.col("n").cast("double")
    weigh_low = upto**2 - before**2
    weigh_high = (n - before) ** 2 - (n - upto) ** 2
    term = weigh_low * normal_logcdf(z) + weigh_high * normal_logcdf(-z)
    total = (
        ranked.join(F.broadcast(stats), "variable")
        .select("variable", "n", (term / n).alias("_t"))
        .groupBy("variable", "n")
        .agg(F.sum("_t").alias("_s"))
    )
    nd = F.col("n").cast("double")
    shrink = 1 + 4 / nd - 25 / nd / nd
    crit = F.array(*[F.round(F.lit(v) / shrink, 3) for v in ANDERSON_BASE])
    return total.select(
        "variable",
        (-nd - F.col("_s")).alias("anderson_stat"),
        crit.alias("anderson_crit"),
        F.array(*[F.lit(v) for v in ANDERSON_LEVELS]).alias("anderson_sig"),
    )


def normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per variable: moments, Jarque-Bera, D'Agostino and Anderson-Darling."""
    tested = dagostino(jarque_bera(moments(df, cols)))
    return tested.join(anderson_darling(df, cols), "variable", "left")


# --- distribution ----------------------------------------------------------------------------


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included."""
    ends = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), f"{c}.*") for c in cols]))
    )
    # A constant variable gets the unit interval around its value.
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        "variable",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    slot = F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins).cast("long"))
    counted = (
        _unpivot(df, cols)
        .join(F.broadcast(ends), "variable")
        .groupBy("variable", slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = (F.col("hi") - F.col("lo")) / bins
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))))
    return every.join(counted, ["variable", "bin"], "left").select(
        "variable",
        "bin",
        (F.col("lo") + step * (F.col("bin") - 1)).alias("from_value"),
        (F.col("lo") + step * F.col("bin")).alias("to_value"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def boxplot(df: DataFrame, cols: Sequence[str], *, max_values: int | None = None) -> DataFrame:
    """Quartiles, whiskers at the outermost points within 1.5 IQR, and the count beyond them."""
    q = exact_quantiles(df, [], cols, [0.25, 0.5, 0.75], max_values=max_values)
    part = lambda c, i: F.get(c, F.lit(i))
    quartiles = q.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("variable"), part(c, 0).alias("q1"), part(c, 1).alias("median"), part(c, 2).alias("q3")
                    )
                    for c in cols
                ]
            )
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high, x = F.col("q1") - reach, F.col("q3") + reach, F.col("x")
    return (
        _unpivot(df, cols)
        .join(F.broadcast(quartiles), "variable")
        .groupBy("variable", "q1", "median", "q3")
        .agg(
            F.least(F.min(F.when(x >= low, x)), F.col("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(x <= high, x)), F.col("q3")).alias("whisker_high"),
            F.count_if((x < low) | (x > high)).alias("n_outliers"),
        )
    )


def qq_points(df: DataFrame, cols: Sequence[str], points: int = 99, *, max_values: int | None = None) -> DataFrame:
    """Sample quantiles against normal quantiles, and the line through mean and deviation."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    q = exact_quantiles(df, [], cols, probs, max_values=max_values)
    m = moments(df, cols).select("variable", "mean", "std")
    grids = [
        F.transform(F.col(c), lambda v, i: F.struct(i.alias("i"), v.alias("sample"))) for c in cols
    ]
    sets = [F.struct(F.lit(c).alias("variable"), g.alias("pts")) for c, g in zip(cols, grids)]
    rows = q.select(F.inline(F.array(*sets))).select("variable", F.inline("pts"))
    theory = normal_quantile((F.col("i") + 1) / F.lit(float(points + 1)))
    return rows.join(F.broadcast(m), "variable").select(
        "variable", "i", theory.alias("theory"), "sample", (F.col("mean") + F.col("std") * theory).alias("line")
    )


# --- series ----------------------------------------------------------------------------------


def lag_sums(blocks: Blocks, col: str, lags: int) -> DataFrame:
    """Per series and lag: what the correlation of x[t] and x[t+lag] needs.

    Each block (a bounded run of consecutive rows plus its margin) gives the sums of its own rows;
    the sums of all blocks are added per series and lag.
    """
    keys, group = list(blocks.keys), blocks.group
    kinds = {f.name: f.dataType.simpleString() for f in blocks.df.schema.fields if f.name in keys}
    layout = ", ".join(f"{k} {kinds[k]}" for k in keys)
    layout += ", lag int, n bigint, sx double, sy double, sxx double, syy double, sxy double"

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x, core = rows["x"].to_numpy(), rows["is_core"].to_numpy()
        first, last = np.flatnonzero(core)[[0, -1]]
        lag = np.arange(lags + 1)
        stop = np.minimum(last + 1, len(x) - lag)
        lag, stop = lag[stop > first], stop[stop > first]
        upto, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
        made = pd.DataFrame(
            {
                "lag": lag,
                "n": stop - first,
                "sx": upto[stop] - upto[first],
                "sy": upto[stop + lag] - upto[first + lag],
                "sxx": squares[stop] - squares[first],
                "syy": squares[stop + lag] - squares[first + lag],
                "sxy": _lag_products_of(x[first : last + 1], x[first:], len(lag)),
            }
        )
        for k in reversed(keys):
            made.insert(0, k, rows[k].iloc[0])
        return made

    if not group:
        raise ValueError("series need a key")
    blocks.using(0, lags)
    # Centring first keeps the sums of squares well conditioned.
    mean = blocks.core().groupBy(*keys).agg(F.avg(col).alias("_mean"), F.max("n_rows").alias("n_rows"))
    centred = blocks.attach(mean).df.withColumn("x", F.col(col) - F.col("_mean"))
    slim = centred.select(*group, "pos", "is_core", "x")
    parts = slim.groupBy(*group).applyInPandas(sums, layout)
    return parts.groupBy(*keys, "lag").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )


def _lag_products_of(own: np.ndarray, longer: np.ndarray, lags: int) -> np.ndarray:
    """Sum of ``own[i] * longer[i + k]`` for each lag ``k``, all lags at once.

    Runs through ``own`` in pieces of a few lags' length: each is multiplied in the frequency domain with its piece of
    ``longer`` and the margin after it, so time grows with the logarithm of the lags and memory not with the series.
    """
    size = 1 << max(10, (4 * lags - 1).bit_length())  # of a transform
    step = size - lags  # rows whose products of all lags fit without wrapping round
    total = np.zeros(size // 2 + 1, dtype=complex)
    for i in range(0, len(own), step):
        here = np.fft.rfft(own[i : i + step], size)
        total += np.conj(here) * np.fft.rfft(longer[i : i + size], size)
    return np.fft.irfft(total, size)[:lags]


def lag_correlation(sums: DataFrame) -> DataFrame:
    """Pearson correlation of the series with itself ``lag`` rows later."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    return sums.withColumn("r", F.when((n > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)))


def seasonal_period(sums: DataFrame, keys: Sequence[str], threshold: float = 0.25) -> DataFrame:
    """The first lag whose correlation exceeds the threshold; null if none or under 20 points."""
    r = lag_correlation(sums)
    size = F.max(F.when(F.col("lag") == 0, F.col("n")))
    hit = F.min(F.when((F.col("lag") > 0) & (F.col("r") > threshold), F.col("lag")))
    return r.groupBy(*keys).agg(F.when(size >= MIN_POINTS, hit).alias("period"))


def autocorrelation(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ACF: lag products over the full-sample variance (the series is centred already)."""
    # A series has one row per lag here.
    per = Window.partitionBy(*keys)
    at_zero = lambda c: F.max(F.when(F.col("lag") == 0, F.col(c))).over(per)
    whole = sums.withColumns({"_v": at_zero("sxx"), "n_rows": at_zero("n")})
    return whole.select(*keys, "lag", "n_rows", F.when(F.col("_v") > 0, F.col("sxy") / F.col("_v")).alias("acf"))


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PACF by the Durbin-Levinson recursion on the ACF, one short array per series."""
    pairs = F.sort_array(F.collect_list(F.struct("lag", "acf")))
    arrays = acf.groupBy(*keys).agg(F.transform(pairs, lambda p: p["acf"]).alias("rho"))

    @F.pandas_udf("array<double>")
    def solve(rho: pd.Series) -> pd.Series:
        return rho.map(_durbin_levinson)

    return arrays.select(*keys, F.posexplode(solve("rho")).alias("lag", "pacf"))


def _durbin_levinson(rho: np.ndarray) -> list[float]:
    rho = np.asarray(rho, dtype=float)
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(rho)):
        last = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / (1 - phi @ rho[1:k]) if k > 1 else rho[1]
        phi = np.r_[phi - last * phi[::-1], last]
        out.append(float(last))
    return out


def kpss(blocks: Blocks, col: str, sums: DataFrame | None = None) -> DataFrame:
    """Level-stationarity test per series: squared partial sums over the long-run variance.

    The bandwidth follows Hobijn et al. (1998); p is read off the published table between its ends.
    ``sums`` may bring lag sums already made; they are made anew where a bandwidth is wider.
    """
    keys = list(blocks.keys)
    longest = blocks.df.agg(F.max("n_rows")).first()[0] or 1
    have = int(longest ** (2.0 / 9.0))
    if sums is None:
        sums = lag_sums(blocks, col, have)
    else:
        have = max(have, sums.agg(F.max("lag")).first()[0] or 0)
    gamma = cut(_lag_products(sums, keys))
    widest = gamma.agg(F.max(_bandwidth("n", "gamma"))).first()[0] or 0
    if widest > have:
        wide = blocks
        if blocks.size and widest > blocks.ahead:
            # The bandwidth reaches past the margins: cut the series anew with wider ones.
            rows = blocks.core().drop("pos", "n_rows")
            wide = series_blocks(rows, 0, widest, keys=keys, order=blocks.order, max_rows=4 * blocks.size)
        gamma = _lag_products(lag_sums(wide, col, widest), keys)
    # Running sums inside blocks, then the total of the earlier blocks on top.
    mean = blocks.core().groupBy(*keys).agg(F.avg(col).alias("_mean"), F.max("n_rows").alias("n_rows"))
    centred = blocks.attach(mean)
    e = F.col(col) - F.col("_mean")
    local = centred.df.where("is_core") if blocks.size else centred.df
    inside = blocks.window.rowsBetween(Window.unboundedPreceding, 0)
    per_block = (
        local.withColumn("_s", F.sum(e).over(inside))
        .groupBy(*keys, "block")
        .agg(
            F.sum(e).alias("t"), F.sum("_s").alias("s1"), F.sum(F.col("_s") ** 2).alias("s2"), F.count(F.lit(1)).alias("m")
        )
    )
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_block.withColumn("o", F.coalesce(F.sum("t").over(before), F.lit(0.0)))
    eta = shifted.groupBy(*keys).agg(
        F.sum(F.col("s2") + 2 * F.col("o") * F.col("s1") + F.col("m") * F.col("o") ** 2).alias("eta")
    )

    @F.pandas_udf("lags int, kpss_stat double, kpss_p double")
    def test(n: pd.Series, eta: pd.Series, gamma: pd.Series) -> pd.DataFrame:
        rows = [_kpss(int(a), b, np.asarray(c)) for a, b, c in zip(n, eta, gamma)]
        return pd.DataFrame(rows, columns=["lags", "kpss_stat", "kpss_p"])

    solved = gamma.join(eta, keys).select(*keys, "n", test("n", "eta", "gamma").alias("t"))
    long = lambda c: F.when(F.col("n") >= MIN_POINTS, c)
    return solved.select(
        *keys,
        "n",
        long(F.col("t.lags")).alias("lags"),
        long(F.col("t.kpss_stat")).alias("kpss_stat"),
        long(F.col("t.kpss_p")).alias("kpss_p"),
        long(F.col("t.kpss_p") > ALPHA).alias("kpss_stationary"),
    )


def _lag_products(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("lag", "sxy")))
    return sums.groupBy(*keys).agg(
        F.max(F.when(F.col("lag") == 0, F.col("n"))).alias("n"), F.transform(ordered, lambda p: p["sxy"]).alias("gamma")
    )


def _kpss_lags(n: int, gamma: np.ndarray) -> int | None:
    reach = min(int(n ** (2.0 / 9.0)), len(gamma) - 1)
    s0, s1 = gamma[0] / n, 0.0
    for i in range(1, reach + 1):
        product = 2.0 * gamma[i] / n
        s0, s1 = s0 + product, s1 + i * product
    if s0 == 0:
        return None
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1)


def _bandwidth(n: str, gamma: str) -> Column:
    @F.pandas_udf("int")
    def lags(n: pd.Series, gamma: pd.Series) -> pd.Series:
        return pd.Series([_kpss_lags(int(a), np.asarray(b)) or 0 for a, b in zip(n, gamma)], dtype="int32")

    return lags(n, gamma)


def _kpss(n: int, eta: float, gamma: np.ndarray) -> tuple:
    lags = _kpss_lags(n, gamma)
    if lags is None:
        return (None, None, None)
    weights = 1 - np.arange(1, lags + 1) / (lags + 1.0)
    spread = (gamma[0] + 2 * weights @ gamma[1 : lags + 1]) / n
    if spread <= 0:
        return (lags, None, None)
    stat = eta / n**2 / spread
    return (lags, float(stat), float(np.interp(stat, KPSS_CRIT, KPSS_P)))


# MacKinnon's published p-value surface and critical values, constant, one series.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_CRIT = {
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}


def adf_max_lag(n: int) -> int:
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def adf(blocks: Blocks, col: str) -> DataFrame:
    """Augmented Dickey-Fuller test per series, lag count by AIC; under 20 points all null.

    Each block adds up the products of (1, level, lagged differences, difference); the sums of a
    series are all the regressions need. ``blocks`` must reach back ``adf_max_lag(n) + 1`` rows.
    """
    keys, group = list(blocks.keys), blocks.group
    kinds = {f.name: f.dataType.simpleString() for f in blocks.df.schema.fields if f.name in keys}
    layout = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, parts array<double>"
    mean = blocks.core().groupBy(*keys).agg(F.avg(col).alias("_mean"), F.max("n_rows").alias("n_rows"))
    centred = blocks.attach(mean).df.withColumn("x", F.col(col) - F.col("_mean"))

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n, pos, x = int(rows["n_rows"].iloc[0]), rows["pos"].to_numpy(), rows["x"].to_numpy()
        p = adf_max_lag(n)
        gram, head = np.zeros((p + 3, p + 3)), np.zeros(p + 2)
        core = np.flatnonzero(rows["is_core"].to_numpy() & (pos >= p + 1))
        for a in range(0, len(core), 20_000):
            z = _adf_rows(x, core[a : a + 20_000], p)
            gram += z.T @ z
        early = rows["is_core"].to_numpy() & (pos < p + 2)
        head[pos[early]] = x[early]
        out = rows[keys].iloc[:1].copy()
        out["n"] = n
        out["parts"] = [np.concatenate([gram.ravel(), head])]
        return out

    parts = centred.select(*group, "pos", "n_rows", "is_core", "x").groupBy(*group).applyInPandas(products, layout)
    if blocks.size:
        parts = (
            parts.select(*keys, "n", F.posexplode("parts").alias("i", "v"))
            .groupBy(*keys, "n", "i")
            .agg(F.sum("v").alias("v"))
            .groupBy(*keys, "n")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda q: q["v"]).alias("parts"))
        )

    @F.pandas_udf("used_lag int, adf_stat double, adf_p double")
    def solve(n: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = [_adf(int(a), np.asarray(b)) for a, b in zip(n, parts)]
        return pd.DataFrame(rows, columns=["used_lag", "adf_stat", "adf_p"])

    solved = parts.select(*keys, "n", solve("n", "parts").alias("t"))
    obs = F.col("n") - F.col("t.used_lag") - 1
    crit = F.create_map(
        *[
            x
            for level, (b0, b1, b2, b3) in ADF_CRIT.items()
            for x in (F.lit(level), b0 + b1 / obs + b2 / obs**2 + b3 / obs**3)
        ]
    )
    return solved.select(
        *keys,
        "n",
        F.col("t.used_lag").alias("used_lag"),
        F.col("t.adf_stat").alias("adf_stat"),
        F.col("t.adf_p").alias("adf_p"),
        (F.col("t.adf_p") < ALPHA).alias("adf_stationary"),
        F.when(F.col("t.adf_stat").isNotNull(), crit).alias("adf_crit"),
    )


def _adf_rows(x: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """Rows (1, x[t-1], dx[t-1] .. dx[t-p], dx[t]) for every t in ``at``."""
    dx = np.diff(x)
    lagged = [dx[at - 1 - k] for k in range(1, p + 1)]
    return np.column_stack([np.ones(len(at)), x[at - 1], *lagged, dx[at - 1]])


def _ols(gram: np.ndarray, k: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse for the first ``k`` regressors."""
    inverse = np.linalg.pinv(gram[:k, :k], hermitian=True)
    beta = inverse @ gram[:k, -1]
    return beta, float(gram[-1, -1] - beta @ gram[:k, -1]), inverse


def _adf(n: int, parts: np.ndarray) -> tuple:
    if n < MIN_POINTS:
        return (None, None, None)
    p = adf_max_lag(n)
    gram, head = parts[: (p + 3) ** 2].reshape(p + 3, p + 3), parts[(p + 3) ** 2 :]
    obs = n - p - 1
    criteria = []
    for lag in range(p + 1):
        _, ssr, _ = _ols(gram, lag + 2)
        if ssr <= 0:
            return (None, None, None)
        criteria.append(obs * math.log(ssr / obs) + 2 * (lag + 2))
    used = int(np.argmin(criteria))
    # With fewer lags the regression gains the rows near the start.
    early = np.arange(used + 1, p + 1)
    keep = np.r_[0 : used + 2, p + 2]
    total = gram[np.ix_(keep, keep)]
    if len(early):
        z = _adf_rows(head, early, used)
        total = total + z.T @ z
    beta, ssr, inverse = _ols(total, used + 2)
    rows = n - used - 1
    error = ssr / (rows - used - 2) * inverse[1, 1]
    if error <= 0:
        return (used, None, None)
    stat = float(beta[1] / math.sqrt(error))
    if stat > ADF_MAX:
        return (used, stat, 1.0)
    if stat < ADF_MIN:
        return (used, stat, 0.0)
    curve = ADF_SMALL_P if stat <= ADF_STAR else ADF_LARGE_P
    z = sum(c * stat**i for i, c in enumerate(curve))
    return (used, stat, 0.5 * math.erfc(-z / math.sqrt(2)))


def decompose(blocks: Blocks, col: str, period: int) -> Blocks:
    """Additive decomposition: ``trend``, ``seasonal`` and ``resid``.

    The trend is a centred moving average; at both ends it goes on along the least-squares line
    through the nearest ``period`` trend points. Series of less than two periods drop out. ``blocks``
    must reach ``period // 2`` rows both ways.
    """
    keys, half = list(blocks.keys), period // 2
    blocks = blocks.on(blocks.df.where(F.col("n_rows") >= 2 * period))
    pos, n, x = F.col("pos"), F.col("n_rows"), F.col(col)
    w = blocks.window
    if period % 2:
        smooth = F.avg(x).over(w.rowsBetween(-half, half))
    else:
        inner = F.sum(x).over(w.rowsBetween(1 - half, half - 1))
        smooth = (inner + (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2) / period
    front, back = F.lit(half), n - 1 - half  # first and last row with a full average
    inside = (pos >= front) & (pos <= back)
    df = blocks.on(blocks.df.withColumn("trend", F.when(inside, smooth)))

    own = df.df.where("is_core") if blocks.size else df.df
    at_front = (pos >= front) & (pos < F.least(front + period, back))
    at_back = (pos >= F.greatest(front, back - period)) & (pos < back)
    t = F.col("trend")
    ends = own.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        *[
            f(F.when(where, t), F.when(where, from_end)).alias(name)
            for where, from_end, tag in ((at_front, pos, "f"), (at_back, pos - n, "b"))
            for f, name in ((F.regr_slope, f"_{tag}k"), (F.regr_intercept, f"_{tag}n"))
        ],
    )
    line = F.when(pos < front, F.col("_fk") * pos + F.col("_fn")).otherwise(F.col("_bk") * (pos - n) + F.col("_bn"))
    full = df.attach(ends)
    full = full.on(full.df.withColumn("trend", F.coalesce(t, line)).drop("_fk", "_fn", "_bk", "_bn"))

    own = full.df.where("is_core") if blocks.size else full.df
    phases = own.groupBy(*keys, (pos % period).alias("phase")).agg(
        F.max("n_rows").alias("n_rows"), F.avg(x - t).alias("m")
    )
    seasons = phases.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.avg("m").alias("_level"),
        F.transform(F.array_sort(F.collect_list(F.struct("phase", "m"))), lambda q: q["m"]).alias("_season"),
    )
    done = full.attach(seasons)
    seasonal = F.get("_season", (pos % period).cast("int")) - F.col("_level")
    out = done.df.withColumn("seasonal", seasonal).withColumn("resid", x - t - F.col("seasonal"))
    return blocks.on(out.drop("_season", "_level"))
