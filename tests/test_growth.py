"""Steps whose cost must not grow with what is asked, carried along or held at once."""

import numpy as np
import pandas as pd
import pytest
from meterlens.config import AnomalyParams, ForecastParams, JobParams
from meterlens.operators import quantiles, scaling, series, ssa
from meterlens.operators.blocks import series_blocks
from meterlens.plans.train import KEYS, number_rows
from meterlens.streaming.score import rolling_spread


def _readings(spark, lengths):
    rng = np.random.default_rng(5)
    parts = []
    for c, n in enumerate(lengths):
        day = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h")
        part = pd.DataFrame({"client_id": f"c{c}", "segment": "AB"[c % 2], "ts": day, "src_ord": np.arange(n) + 1000 * c})
        for m in ("volume", "pressure", "temperature"):
            part[m] = rng.normal(50, 10, n)
        parts.append(part)
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))
    return df.withColumn("ts", df.ts.cast("timestamp_ntz"))


def test_a_value_meets_one_interval_however_many_ranks_are_wanted(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.lognormal(0, 4, 6000), np.repeat(3.0, 500), [np.inf, -np.inf, 1e300, -1e300]])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)) % 2, "x": x, "y": -x}))
    probs = [(i + 1) / 100 for i in range(99)]
    met = []

    def recorded(intervals, rows):
        met.append(intervals)
        return intervals

    monkeypatch.setattr(quantiles, "checked_broadcast", recorded)
    made = quantiles.exact_quantiles(df, [], ["x", "y"], probs, max_values=100).first()
    assert met[0].count() == 2  # one a column, though 99 quantiles are between its bounds
    assert all(m.count() == m.select([c for c in m.columns if c != "_hi"]).distinct().count() for m in met)
    assert np.allclose(made.x, np.quantile(x, probs), rtol=1e-12)
    assert np.allclose(made.y, np.quantile(-x, probs), rtol=1e-12)
    per_key = quantiles.exact_quantiles(df, ["k"], ["x"], probs, max_values=100).collect()
    for r in per_key:
        assert np.allclose(r.x, np.quantile(x[np.arange(len(x)) % 2 == r.k], probs), rtol=1e-12)


def test_training_rows_are_numbered_without_moving_them(spark):
    p = ForecastParams(split="time")
    blocks = series_blocks(_readings(spark, [40, 27, 60, 33, 20, 26]), *series.reach(JobParams(forecast=p)), keys=KEYS)
    numbered = number_rows(series.lag_arrays(blocks, "volume", p), p).core()
    rows = numbered.select("segment", "client_id", "ts", "is_train", "draw_pos").toPandas()
    train = rows[rows.is_train].sort_values(["segment", "client_id", "ts"])
    assert len(train) and not rows[~rows.is_train].draw_pos.notna().any()
    for _, part in train.groupby("segment"):
        assert part.draw_pos.tolist() == list(range(len(part)))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_series_need_no_python_call_each(spark, batch):
    p = JobParams()
    readings = _readings(spark, [70, 3, 24, 25, 26, 120, 48, 1])
    blocks = series_blocks(readings, *series.reach(p), keys=KEYS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = ssa.smooth_lagged(blocks, p).df
        assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
        made = made.orderBy("src_ord").toPandas()
        plain = series.lag_arrays(ssa.smooth(blocks, p.ssa), "v_filt", p.forecast).df.orderBy("src_ord").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(made) and made.src_ord.tolist() == plain.src_ord.tolist()
    assert np.allclose(np.stack(made.base), np.stack(plain.base)) and np.allclose(made.volume_next, plain.volume_next)


def test_wide_rows_are_expanded_some_at_a_time(spark):
    x = np.arange(6000.0)
    df = spark.createDataFrame([("A", [v, -v]) for v in x.tolist()], "segment string, base array<double>").coalesce(1)

    def expand(base):
        assert len(base) <= 1024
        return base.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)

    assert np.allclose(scaling.column_quantiles(df, expand, [0.5])["A"], [[2999.5, -2999.5]])
    assert np.allclose(scaling.column_moments(df, expand)["A"][0], [2999.5, -2999.5])


@pytest.mark.parametrize("held", [0, 3, 11, 12])
def test_rolling_spread_is_that_of_each_reading(held):
    x, width = np.random.default_rng(held).normal(size=held + 30), AnomalyParams().roll_window
    mean, std = rolling_spread(x, 30, width)
    for k in range(30):
        some = x[max(0, held + k + 1 - width) : held + k + 1]
        want = (some.mean(), some.std()) if len(some) >= 5 else (0.0, 0.0)
        assert np.allclose((mean[k], std[k]), want)
