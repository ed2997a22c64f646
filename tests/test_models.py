"""Smoothing, regression, forest, flags and metrics against small references."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.catalog.views import readings
from meterlens.config import AnomalyParams, ForecastParams, JobParams, SeverityParams
from meterlens.operators import evaluate, flags, forecast, forest, series
from meterlens.operators.blocks import series_blocks
from meterlens.operators.ssa import smooth
from meterlens.plans.score import evaluate_labelled, score
from meterlens.plans.train import train
from meterlens.sources import writers


def dense_smooth(v, size=24, rank=5):
    n = len(v)
    if n <= size:
        return v
    x = np.lib.stride_tricks.sliding_window_view(v, size).T
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    low = (u[:, :rank] * s[:rank]) @ vt[:rank]
    total, count = np.zeros(n), np.zeros(n)
    for i, row in enumerate(low):
        total[i : i + len(row)] += row
        count[i : i + len(row)] += 1
    return total / count


@pytest.mark.parametrize("max_rows", [None, 150])
def test_smoothing_equals_dense_svd(spark, max_rows):
    rng = np.random.default_rng(1)
    lengths = (1, 24, 25, 30, 46, 47, 48, 60, 500)
    want, rows = {}, []
    for n in lengths:
        v = 5 * np.sin(np.arange(n) * 2 * np.pi / 24) + rng.normal(size=n) + 10
        want[f"c{n}"] = dense_smooth(v)
        rows += [(f"c{n}", i, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "client_id string, o int, volume double")
    got = smooth(series_blocks(df, 64, 24, order=["o"], max_rows=max_rows)).core().toPandas()
    for c, g in got.groupby("client_id"):
        assert np.allclose(g.sort_values("pos").v_filt, want[c], atol=1e-8)


def test_residual_edges(spark):
    rng = np.random.default_rng(2)
    sets = {"a": rng.normal(size=4), "b": rng.normal(size=5), "c": rng.normal(size=13), "d": np.full(12, 3.0)}
    rows = [(k, i, float(x)) for k, v in sets.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "client_id string, o int, resid double")
    got = series.residual_features(series_blocks(df, 16, 0, order=["o"]), first_pos=0).core().toPandas()
    for c, g in got.groupby("client_id"):
        g, r = g.sort_values("pos"), pd.Series(sets[c])
        mean = r.rolling(12, min_periods=5).mean().fillna(0)
        std = r.rolling(12, min_periods=5).std(ddof=0)
        std = std.where(std.notna() & (std.abs() > 1e-12), 1e-6)
        z = (r - mean) / std
        assert np.allclose(g.r_mean, mean) and np.allclose(g.z_abs, z.abs(), rtol=1e-6)
        assert np.allclose(g.dz_abs, z.diff().fillna(0).abs(), rtol=1e-6) and np.allclose(g.dr_abs, r.diff().fillna(0).abs())


def test_moments_of_a_distant_level(spark):
    """A level far above the spread changes no coefficient, however the rows lie in tasks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 3)) * [1.0, 5.0, 0.2] + [0.0, 1e6, 40.0]
    y = x @ [2.0, -0.5, 3.0] + rng.normal(size=5000)
    p = ForecastParams(lags_v=3, lags_exo=0, poly_degree=1)
    found = {}
    for level in (0.0, 1e8):
        for parts in (1, 7):
            rows = [("a" if i % 4 else "b", r.tolist(), float(t + level)) for i, (r, t) in enumerate(zip(x, y))]
            df = spark.createDataFrame(rows, "segment string, base array<double>, volume_next double").repartition(parts)
            moments = forecast.moment_rows(df, forecast.fit_scaler(df, p), p)
            for r in forecast.fit_elastic_net(moments, p).collect():
                found.setdefault(r.segment, []).append([*r.coef, r.intercept - level])
                assert r.n_train == (1250 if r.segment == "b" else 3750)
    assert sorted(found) == ["a", "b"]
    for fits in found.values():
        assert np.ptp(fits, axis=0).max() < 1e-6
    empty = df.limit(0)
    assert forecast.fit_elastic_net(forecast.moment_rows(empty, forecast.fit_scaler(df, p), p), p).count() == 0


def test_elastic_net_is_optimal(spark, sf):
    """Subgradient conditions of the penalised problem at the fitted coefficients."""
    p = ForecastParams()
    df = readings(spark, sf, "readings_e")
    rows = series.lag_arrays(series_blocks(df, 64, 24, keys=("segment", "client_id")), "volume", p).core()
    scaler = forecast.fit_scaler(rows, p)
    model = forecast.fit_elastic_net(forecast.moment_rows(rows, scaler, p), p).toPandas()
    design = forecast.Design.of(p)
    data = rows.select("segment", "base", "volume_next").toPandas()
    scales = {r.segment: r for r in scaler.collect()}
    for m in model.itertuples():
        part = data[data.segment == m.segment]
        x = design.matrix(np.stack(part.base))
        assert x.shape[1] == 48 + 119 == len(m.coef)
        q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        width = np.where(q[2] == q[0], 1, q[2] - q[0])
        assert np.allclose(q[1], scales[m.segment].center) and np.allclose(width, scales[m.segment].scale)
        z, y = (x - q[1]) / width, part.volume_next.to_numpy()
        w = np.asarray(m.coef)
        assert np.isclose(m.intercept, (y - z @ w).mean())
        grad = (z - z.mean(0)).T @ (y - z @ w - m.intercept) / len(y) - p.alpha * (1 - p.l1_ratio) * w
        at = np.abs(w) > 0
        assert np.abs(grad[at] - p.alpha * p.l1_ratio * np.sign(w[at])).max() < 1e-2
        assert np.abs(grad[~at]).max(initial=0) <= p.alpha * p.l1_ratio + 1e-2


def test_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(3)
    n, planted = 2000, 30
    x = rng.normal(size=(n, 6))
    x[:planted] += 9
    rows = [("s", i, *map(float, r)) for i, r in enumerate(x)]
    cols = ", ".join(f"{c} double" for c in forest.FEATURES)
    df = spark.createDataFrame(rows, f"segment string, train_pos long, {cols}")
    p = AnomalyParams(n_estimators=100)
    sizes = spark.createDataFrame([("s", n)], "segment string, n_train long")
    samples = forest.draw_samples(df, sizes, p, 7)
    per_tree = samples.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("train_pos").alias("d")).toPandas()
    assert len(per_tree) == 100 and (per_tree.n == 256).all() and (per_tree.d == 256).all()
    nodes = forest.fit_forest(samples, p, 7)
    assert nodes.toPandas().equals(forest.fit_forest(samples, p, 7).toPandas())
    scored = df.withColumn("score", forest.scorer(df, forest.load_forests(nodes, {"s": 256}))).toPandas()
    assert scored.score.between(0, 1).all()
    assert set(scored.nlargest(planted, "score").train_pos) == set(range(planted))


def test_average_path():
    assert list(forest.average_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert np.isclose(forest.average_path(256), 10.2448, atol=1e-3)


def test_training_result(trained, spark, sf):
    params, result = trained
    got = result.flags.toPandas()
    df = readings(spark, sf, "readings_e").toPandas()
    usable = df.groupby("client_id").size().sub(25).clip(lower=0).sum()
    assert len(got) == usable
    assert got.groupby("segment").proba.agg(["min", "max"]).to_numpy().tolist() == [[0, 1]] * 2
    # The alarm rate is the contamination, up to one row.
    for _, g in got.groupby("segment"):
        assert abs(g.flag_final.sum() - 0.03 * len(g)) <= 1.5
    metrics = result.metrics.toPandas()
    assert set(metrics.segment) == {"Comercial", "Industrial"}
    assert (metrics.rmse >= metrics.mae).all()


def test_stored_models_reproduce_training_flags(trained, spark, sf, tmp_path):
    params, result = trained
    writers.save_models(result.models, str(tmp_path / "m"))
    loaded = writers.load_models(spark, str(tmp_path / "m"))
    again = score(readings(spark, sf, "readings_e"), loaded, params, thresholds="stored")
    a = result.flags.toPandas().sort_values(["client_id", "ts"]).reset_index(drop=True)
    b = again.toPandas().sort_values(["client_id", "ts"]).reset_index(drop=True)
    assert np.allclose(a.volume_hat, b.volume_hat) and np.allclose(a.proba, b.proba)
    assert list(a.flag_final) == list(b.flag_final)
    with pytest.raises(FileNotFoundError):
        writers.load_models(spark, str(tmp_path / "m"), ["Otro"])


def test_training_survives_a_huge_client(trained, spark, sf):
    params, result = trained
    cut = train(readings(spark, sf, "readings_e"), params, max_rows=40)
    a = result.flags.toPandas().sort_values(["client_id", "ts"])
    b = cut.flags.toPandas().sort_values(["client_id", "ts"])
    assert np.allclose(a.volume_hat, b.volume_hat, atol=1e-6) and np.allclose(a.proba, b.proba, atol=1e-6)


def test_evaluation(trained, spark, sf):
    params, result = trained
    ev = evaluate_labelled(readings(spark, sf, "readings_e"), result.models, params)
    m = ev.metrics.toPandas().set_index("segment")
    assert set(m.index) == {"Comercial", "Industrial", "__all__"}
    pred = ev.predictions.toPandas()
    label = readings(spark, sf, "readings_e").toPandas().sort_values(["client_id", "ts"])
    label["next"] = label.groupby("client_id").label.shift(-1)
    both = pred.merge(label[["client_id", "ts", "next"]], on=["client_id", "ts"])
    assert (both.label_next == both.next.fillna(0)).all()
    tp = ((pred.flag_final == 1) & (pred.label_next == 1)).sum()
    assert np.isclose(m.loc["__all__", "precision"], tp / pred.flag_final.sum())
    assert m.loc["__all__", "n_eval"] == len(pred)
    curve = ev.curve.where("segment = '__all__'").toPandas().sort_values(["fpr", "tpr"])
    assert np.isclose(np.trapezoid(curve.tpr, curve.fpr), m.loc["__all__", "roc_auc"])


def test_metrics_edges(spark):
    ties = [("s", 1, 0.5, 1), ("s", 0, 0.5, 1), ("s", 1, 0.9, 1), ("s", 0, 0.1, 0), ("t", 0, 0.3, 0), ("t", 0, 0.7, 0)]
    df = spark.createDataFrame(ties, "segment string, label_next int, proba double, flag_final int")
    auc = {r.segment: r.roc_auc for r in evaluate.roc_auc(df).collect()}
    assert auc["s"] == pytest.approx(0.875) and auc["t"] is None
    m = {r.segment: r for r in evaluate.confusion_metrics(df).collect()}
    assert (m["t"].precision, m["t"].recall, m["t"].f1, m["t"].accuracy) == (0, 0, 0, 1)
    assert m["s"].precision == pytest.approx(2 / 3) and m["s"].recall == 1


def test_flat_scores_and_grades(spark):
    df = spark.createDataFrame([("s", 0.4, 1.0), ("s", 0.4, 9.0)], "segment string, score double, z_abs double")
    p = AnomalyParams(z_threshold=5.0, fusion="and")
    out = flags.flag(df, flags.score_thresholds(df, flags.score_range(df), p), p).collect()
    assert [r.proba for r in out] == [0, 0] and sorted(r.flag_final for r in out) == [0, 1]
    grades = spark.createDataFrame([(x,) for x in (0.69, 0.7, 0.85, 0.95)], "proba double").select(flags.severity())
    assert [r[0] for r in grades.collect()] == ["", "Leve", "Media", "Crítica"]
    with pytest.raises(ValueError):
        SeverityParams(0.9, 0.8, 0.95)


def test_short_segments_are_skipped(spark):
    rows = [("a", i, float(i % 7), "x") for i in range(30)]
    df = spark.createDataFrame(rows, "client_id string, h int, volume double, segment string").selectExpr(
        "client_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h, 0, 0) AS ts", "volume",
        "volume + 1 AS pressure", "volume * 2 AS temperature", "segment", "CAST(h AS BIGINT) AS src_ord",
    )
    assert train(df, JobParams(anomaly=AnomalyParams(n_estimators=5))).flags.count() == 0
