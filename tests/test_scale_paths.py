"""The paths for huge clients and groups give the same rows as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.catalog.views import readings
from meterlens.config import ForecastParams
from meterlens.operators import clean, explore, forecast, forest, ordering, scaling, segment, series
from meterlens.operators.blocks import series_blocks
from meterlens.operators.ordering import running_totals
from meterlens.operators.quantiles import exact_quantiles
from meterlens.operators.ssa import smooth
from meterlens.plans.train import number_rows


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """Event readings with a third of all rows under one client."""
    df = readings(spark, sf, "readings_e")
    return df.withColumn("client_id", F.when(F.col("src_ord") % 3 == 0, "hot").otherwise(F.col("client_id"))).cache()


def table(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("max_rows", [200, 70])
def test_series_operators(skewed, max_rows):
    def made(limit):
        b = smooth(series_blocks(skewed, series.HISTORY_REACH, series.FUTURE_REACH, max_rows=limit))
        p = ForecastParams()
        lagged = series.lag_arrays(b, "v_filt", p)
        lagged = lagged.on(lagged.df.withColumn("resid", F.col("volume_next") - F.get("base", F.lit(0))))
        out = series.residual_features(lagged, first_pos=p.maxlag).core()
        return table(out.select("client_id", "ts", "src_ord", "pos", "v_filt", "volume_next", "base", "r_mean", "r_std", "z_abs", "dz_abs", "dr_abs"), "client_id", "src_ord")

    plain, cut = made(None), made(max_rows)
    assert list(plain.src_ord) == list(cut.src_ord) and list(plain.pos) == list(cut.pos)
    for c in ("v_filt", "volume_next", "r_mean", "r_std", "z_abs", "dz_abs", "dr_abs"):
        assert np.allclose(plain[c], cut[c], atol=1e-8), c
    assert np.allclose(np.stack(plain.base), np.stack(cut.base), atol=1e-8)


def test_training_positions(skewed):
    keyed = ("segment", "client_id")
    skewed = skewed.withColumn("segment", F.lit("x"))

    def made(limit):
        b = series_blocks(skewed, series.HISTORY_REACH, series.FUTURE_REACH, keys=keyed, max_rows=limit)
        return table(number_rows(series.lag_arrays(b, "volume", ForecastParams()), ForecastParams()).core().select("src_ord", "train_pos", "is_train"), "src_ord")

    pd.testing.assert_frame_equal(made(None), made(100))


def test_time_lookback(skewed):
    made = lambda limit: table(clean.prior_mean(skewed, max_rows=limit).select("client_id", "src_ord", "prior_mean"), "src_ord")
    pd.testing.assert_frame_equal(made(None), made(60))


def test_time_lookback_of_a_burst(spark, monkeypatch):
    """All rows of a client within one look-back, many at one time: even tasks, the same means."""
    rng = np.random.default_rng(8)
    second = [*rng.integers(0, 9000, 2000).tolist(), *[4000] * 1500, *rng.integers(0, 10**6, 2500).tolist()]
    value = rng.normal(5, 2, len(second)).tolist()
    odd = {3: float("nan"), 9: float("inf"), 11: float("-inf"), 20: 1e18, 21: -1e9, 30: None, 31: 0.0}
    rows = [("burst", t, x, i) for i, (t, x) in enumerate(zip(second, value))]
    rows += [("late", 50000 + 400 * i, odd.get(i, 1.5), i) for i in range(300)] + [("few", 7, 1.0, 0), ("burst", None, 2.0, -1)]
    df = spark.createDataFrame(rows, "client_id string, s long, pressure double, src_ord long")
    df = df.withColumn("ts", F.timestamp_seconds("s")).withColumn("_at", F.lit("kept"))
    sizes, plain_cut = [], ordering.cut

    def watched(table):
        made = plain_cut(table)
        sizes.append([r["count"] for r in made.groupBy("_part").count().collect()])
        return made

    monkeypatch.setattr(ordering, "cut", watched)
    got = table(clean.prior_mean(df, max_rows=200), "client_id", "src_ord")
    assert len(sizes) == 1 and len(sizes[0]) > 4 and max(sizes[0]) < 2.5 * sum(sizes[0]) / len(sizes[0])
    want = table(clean.prior_mean(df, max_rows=10**6), "client_id", "src_ord")
    pd.testing.assert_frame_equal(got, want[got.columns], rtol=1e-9)
    assert got.prior_mean.isna().any() and np.isinf(got.prior_mean).any()
    # By hand: the late client's window of 10,800 s holds the 26 or 27 readings before.
    late = got[got.client_id == "late"].prior_mean
    assert np.isnan(late.iloc[0]) and np.allclose(late.iloc[100:], 1.5)
    assert clean.prior_mean(df.limit(0), max_rows=1).count() == 0


def test_interpolation(skewed):
    grid = series.hourly_grid(skewed, truncate=True)
    made = lambda limit: table(series.interpolate(series_blocks(grid, 0, 0, order=("ts",), max_rows=limit)).core().select("client_id", "ts", "volume", "pressure"), "client_id", "ts")
    pd.testing.assert_frame_equal(made(None), made(100))


def test_quantiles_by_narrowing(skewed):
    probs = [0.0, 0.25, 0.5, 0.9, 0.97, 1.0]
    plain = exact_quantiles(skewed, ["client_id"], ["volume", "pressure"], probs)
    narrow = exact_quantiles(skewed, ["client_id"], ["volume", "pressure"], probs, max_values=60)
    a, b = table(plain, "client_id"), table(narrow, "client_id")
    assert list(a.client_id) == list(b.client_id)
    for c in ("volume", "pressure"):
        assert np.allclose(np.stack(a[c]), np.stack(b[c]))
    whole = exact_quantiles(skewed, [], ["volume"], probs, max_values=10).first()[0]
    assert np.allclose(whole, np.quantile(skewed.toPandas().volume, probs))


def test_running_totals(skewed):
    got = running_totals(skewed, ["segment"], ["volume", "src_ord"], {"n": F.lit(1), "s": F.col("pressure")}).toPandas()
    for _, g in got.groupby("segment"):
        g = g.sort_values(["volume", "src_ord"])
        assert list(g.n) == list(range(1, len(g) + 1))
        assert np.allclose(g.s, g.pressure.cumsum())


def test_seasonality_statistics(skewed):
    slim = skewed.select("client_id", "ts", "src_ord", "volume")

    def made(limit):
        b = series_blocks(slim, 60, 60, max_rows=limit)
        sums = explore.lag_sums(b, "volume", 40)
        out = explore.lag_correlation(sums).where("n > 3").select("client_id", "lag", "r")
        tests = explore.adf(b, "volume").drop("adf_crit").join(explore.kpss(b, "volume").drop("n"), "client_id")
        parts = explore.decompose(b, "volume", 6).core().select("client_id", "src_ord", "trend", "seasonal", "resid")
        return table(out, "client_id", "lag"), table(tests, "client_id"), table(parts, "src_ord")

    for a, b in zip(made(None), made(120)):
        pd.testing.assert_frame_equal(a, b, rtol=1e-6, atol=1e-8)


def test_scaler_by_counting(skewed, monkeypatch):
    """Few bins, many passes, the same quartiles as numpy."""
    p = ForecastParams()
    b = series_blocks(skewed.withColumn("segment", F.lit("x")), 64, 24, keys=("segment", "client_id"))
    train = series.lag_arrays(b, "volume", p).core()
    x = forecast.Design.of(p).matrix(np.stack([r.base for r in train.select("base").collect()]))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for bins in (2048, 3):
        monkeypatch.setattr(scaling, "BINS", bins)
        got = forecast.fit_scaler(train, p).first()
        assert np.allclose(got["center"], q[1], rtol=1e-12) and np.allclose(got["scale"], np.where(q[2] == q[0], 1, q[2] - q[0]))
    got = forecast.fit_scaler(train, ForecastParams(scaler="standard")).first()
    assert np.allclose(got["center"], x.mean(0)) and np.allclose(got["scale"], np.where(x.std(0) == 0, 1, x.std(0)))


def test_columns_of_any_shape(spark):
    """Ties, one row, huge and tiny values, values far from zero; several segments at once."""
    rng = np.random.default_rng(5)
    tied = np.where(rng.random(500) < 0.8, 3.0, rng.random(500))
    data = {
        "a": np.column_stack([tied, rng.normal(size=500) * 1e300, rng.random(500) * 5e-320, rng.normal(size=500) + 1e9]),
        "b": np.array([[1.0, -2.0, 0.0, 4.0]]), "c": np.tile([7.0, 7.0, -1e308, 1e308], (9, 1)),
        "d": np.array([[1e308, 0.0, 1.0, 2.0], [-1e308, 1.0, 1.0, 2.5], [0.0, 2.0, 1.0, 2.5]]),
    }
    rows = [(s, r.tolist()) for s, x in data.items() for r in x]
    df = spark.createDataFrame(rows, "segment string, base array<double>").repartition(5)
    expand = lambda base: forecast._unnest(base, 4)
    got = scaling.column_quantiles(df, expand, [0.0, 0.25, 0.5, 0.99, 1.0])
    assert set(got) == set(data)
    for s, x in data.items():
        with np.errstate(over="ignore"):
            want = np.quantile(x, [0.0, 0.25, 0.5, 0.99, 1.0], axis=0)
        fine = np.isfinite(want) & np.isfinite(got[s])
        assert np.allclose(got[s][fine], want[fine], rtol=1e-9, atol=0) and fine[:, 1:3].all()
    near = scaling.column_moments(df.where("segment = 'a'"), expand)["a"]
    assert np.allclose(near[1][3], data["a"][:, 3].std(), rtol=1e-9)
    assert scaling.column_quantiles(df.limit(0), expand, [0.5]) == {}


def test_forests_of_many_segments(spark):
    """Rows meet their segment's forest in a shuffle; scores equal the broadcast way, and none is lost."""
    rng = np.random.default_rng(6)
    names = [f"s{i}" for i in range(5000)]
    rows = [(s, i, *map(float, rng.normal(size=6))) for i, s in enumerate(names + ["s0"] * 3000 + ["unknown"] * 3)]
    df = spark.createDataFrame(rows, "segment string, id long, " + ", ".join(f"{c} double" for c in forest.FEATURES))
    # Two trees a segment: a split on a feature of its own, and one leaf.
    nodes = [
        n for i, s in enumerate(names)
        for n in ((s, 0, 0, i % 6, 0.1 * (i % 7 - 3), 1, 2, 0.0), (s, 0, 1, -1, 0.0, -1, -1, 5.0), (s, 0, 2, -1, 0.0, -1, -1, 2.0), (s, 1, 0, -1, 0.0, -1, -1, 3.0))
    ]
    trees = spark.createDataFrame(nodes, forest.NODES)
    samples = spark.createDataFrame([(s, 256) for s in names], "segment string, forest_samples int")
    got = {r.id: r.score for r in forest.with_scores(df, trees, samples, slice_rows=500).select("id", "score").collect()}
    unit = float(forest.average_path(256))
    assert len(got) == len(rows)
    for s, i, *x in rows:
        if s == "unknown":
            assert got[i] is None
            continue
        k = int(s[1:])
        path = (2.0 if x[k % 6] > 0.1 * (k % 7 - 3) else 5.0) + 3.0
        assert np.isclose(got[i], 2 ** (-path / 2 / unit))
    few = samples.where("segment in ('s0', 's1')")
    small = df.where("segment in ('s0', 's1')")
    wide = forest.with_scores(small, trees.join(few.select("segment"), "segment", "left_semi"), few).select("id", "score")
    assert {r.id: r.score for r in wide.collect()} == {r[1]: got[r[1]] for r in rows if r[0] in ("s0", "s1")}


def test_points_without_a_place_do_not_hold_up_the_rest(spark, monkeypatch):
    """NaN and infinite coordinates are nearest to nothing, however many centres there are."""
    inf, nan = float("inf"), float("nan")
    xs = ", ".join(f"x{i} double" for i in range(4))
    centres = spark.createDataFrame(
        [(float(i), 0.0, 0.0, 0.0, i, f"s{i}") for i in range(8)] + [(nan, 0.0, 0.0, 0.0, 9, "bad")],
        f"{xs}, cluster int, segment string",
    )
    points = spark.createDataFrame(
        [("a", 0.2, 0.0, 0.0, 0.0), ("b", nan, 0.0, 0.0, 0.0), ("c", 1.0, inf, 0.0, 0.0), ("d", 6.9, 0.0, 0.0, 0.0)],
        f"client_id string, {xs}",
    )
    for most in (5000, 3):
        monkeypatch.setattr(segment, "CENTRES_PER_ROW", most)
        got = segment.nearest_centre(points, centres).collect()
        assert {(r.client_id, r.segment) for r in got} == {("a", "s0"), ("d", "s7")}


@pytest.mark.parametrize("limit", [None, 20])
def test_quantiles_of_any_doubles(spark, limit):
    """Infinite and huge values, NaN, columns and groups without values; every size switch gives the same."""
    inf, nan = float("inf"), float("nan")
    values = {
        "a": [1.0, inf, 2.0, -inf, 5.0] * 10, "b": [None] * 30, "c": [1e308, -1e308, 0.0, 5e-324] * 10,
        "d": [nan, 1.0, 2.0, inf] * 10, "e": [7.0] * 40, "f": [3.0],
    }
    rows = [(k, v, 1.0 if k != "f" else None) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in exact_quantiles(df, ["k"], ["x", "y"], probs, max_values=limit).collect()}
    want = {r.k: r for r in exact_quantiles(df, ["k"], ["x", "y"], probs).collect()}
    assert {k: str(r) for k, r in got.items()} == {k: str(r) for k, r in want.items()}
    assert got["b"].x is None and got["b"].y == [1.0] * 5 and got["a"].x[-1] == inf and set(got) == set(values)


def test_wide_windows_on_cut_clients(skewed):
    """Margins follow from the parameters, so wider windows change nothing for clients that are cut."""
    from meterlens.config import AnomalyParams, JobParams, SsaParams

    p = JobParams(ssa=SsaParams(window=48), anomaly=AnomalyParams(roll_window=168))

    def made(limit):
        b = smooth(series_blocks(skewed, *series.reach(p), max_rows=limit), p.ssa)
        lagged = series.lag_arrays(b, "v_filt", p.forecast)
        lagged = lagged.on(lagged.df.withColumn("resid", F.col("volume_next") - F.get("base", F.lit(0))))
        out = series.residual_features(lagged, roll_window=168, first_pos=p.forecast.maxlag).core()
        return table(out.select("client_id", "src_ord", "v_filt", "r_mean", "r_std", "z_abs", "dz_abs"), "client_id", "src_ord")

    plain, cut = made(None), made(300)
    assert list(plain.src_ord) == list(cut.src_ord)
    for c in ("v_filt", "r_mean", "r_std", "z_abs", "dz_abs"):
        assert np.allclose(plain[c], cut[c], atol=1e-8), c


def test_margins_that_are_too_narrow_are_refused(skewed):
    narrow = series_blocks(skewed, 5, 5, max_rows=100)
    with pytest.raises(ValueError, match="margins"):
        series.lag_arrays(narrow, "volume", ForecastParams())


def test_kpss_reaches_past_the_margins(spark):
    walk = np.cumsum(np.random.default_rng(0).normal(size=6000))
    df = spark.createDataFrame(pd.DataFrame({"series": 0, "i": range(6000), "x": walk}))

    def made(limit):
        blocks = series_blocks(df, 12, 12, keys=("series",), order=("i",), max_rows=limit)
        return explore.kpss(blocks, "x").first()

    plain, cut = made(None), made(800)
    assert plain.lags > 12 and cut.lags == plain.lags and abs(cut.kpss_stat - plain.kpss_stat) < 1e-9


@pytest.mark.parametrize("max_rows", [None, 200])
def test_smoothing_and_lags_in_one_pass(skewed, max_rows):
    from meterlens.config import JobParams
    from meterlens.operators.ssa import smooth_lagged

    p = JobParams()
    cols = ["client_id", "src_ord", "ts", "pos", "n_rows", "v_filt", "volume_next", "base"]
    one = table(smooth_lagged(series_blocks(skewed, *series.reach(p), max_rows=max_rows), p).core().select(*cols), "client_id", "src_ord")
    b = smooth(series_blocks(skewed, *series.reach(p)), p.ssa)
    two = table(series.lag_arrays(b, "v_filt", p.forecast).core().select(*cols), "client_id", "src_ord")
    assert list(one.src_ord) == list(two.src_ord) and list(one.ts) == list(two.ts) and list(one.pos) == list(two.pos)
    assert np.allclose(one.v_filt, two.v_filt, atol=1e-8) and np.allclose(one.volume_next, two.volume_next)
    assert np.allclose(np.stack(one.base), np.stack(two.base), atol=1e-8)
