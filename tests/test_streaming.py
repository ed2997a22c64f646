"""Streams give what the batch operators give on the same files."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens import schema as S
from meterlens.catalog.views import readings
from meterlens.operators import report
from meterlens.sources.writers import ReadingsStore
from meterlens.streaming.ingest import daily_stream, ingest, read_stream, upsert_stream
from meterlens.streaming.score import score_stream


@pytest.fixture(scope="module")
def files(spark, sf):
    """The readings in three time-ordered Parquet files, each with some rows of the one before."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = readings(spark, sf, "readings_e").drop("label", "src_ord")
    cuts = ["2023-12-31", "2024-01-10", "2024-01-20", "2024-02-03"]
    for a, b in zip(cuts, cuts[1:]):
        part = df.where(F.col("ts").between(F.expr(f"timestamp_ntz'{a} 00:00:00' - interval 12 hours"), F.expr(f"timestamp_ntz'{b} 00:00:00'")))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return folder, df


def drain(df, name, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, files):
    folder, df = files
    return ingest(read_stream(spark, f"{folder}/in", df.schema, "parquet", 1), delay="40 days")


def test_ingest_drops_repeats(spark, files):
    got = drain(stream(spark, files), "ingested")
    assert got.count() == files[1].count()
    assert got.select(S.CLIENT, S.TS).distinct().count() == got.count()


def test_daily_rollup_equals_batch(spark, files):
    folder, df = files
    short = ingest(read_stream(spark, f"{folder}/in", df.schema, "parquet", 100), delay="1 hour")
    got = {(r.client_id, r.day): r.volume for r in drain(daily_stream(short), "daily").collect()}
    want = {(r.client_id, r.day): r.volume for r in report.daily(df).collect()}
    last = max(d for _, d in want)
    closed = {k: v for k, v in want.items() if k[1] < last}
    assert set(closed) <= set(got) | {k for k in closed if k[1] == max(d for _, d in closed)}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_upsert_stream_keeps_one_row_per_key(spark, files):
    folder, df = files
    path, mark = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    raw = read_stream(spark, f"{folder}/in", df.schema, "parquet", 1)
    upsert_stream(raw, path, mark).awaitTermination()
    stored = ReadingsStore(spark, path).current()
    assert stored.count() == df.count()
    assert stored.agg(F.round(F.sum("volume"), 3)).first()[0] == df.agg(F.round(F.sum("volume"), 3)).first()[0]


def test_stream_scoring(spark, files, trained):
    params, result = trained
    got = drain(score_stream(stream(spark, files), result.models, params), "scored").toPandas()
    batch = result.flags.toPandas()
    keys = set(zip(batch.client_id, batch.ts))
    assert {(a, b) for a, b in zip(got.client_id, got.ts)} == keys
    joined = got.merge(batch, on=["client_id", "ts"], suffixes=("", "_b"))
    # The target is the same reading; residuals follow from the forecast.
    assert np.allclose(joined.volume_next, joined.volume_next_b)
    assert np.allclose(joined.resid, joined.volume_next - joined.volume_hat)
    assert set(got.flag_final) <= {0, 1}
    assert got.r_std.gt(0).all()


def test_smoothing_of_many_windows_at_once():
    """The same as the filter of a series that is just the window."""
    from meterlens.operators.ssa import apply_taps, filter_taps, lag_products
    from meterlens.streaming.score import smooth_windows

    rng = np.random.default_rng(1)
    for n in (20, 24, 25, 30, 47, 60):
        windows = rng.normal(size=(7, n)).cumsum(axis=1) + 20
        got = smooth_windows(windows, 24, 5, 20)
        for v, mine in zip(windows, got):
            pos = np.arange(n)
            want = v
            if n > 24:
                products = lag_products(v, pos, np.ones(n, dtype=bool), n, 24)
                want = apply_taps(v, pos, n, filter_taps(products, n, 24, 5))
            assert np.allclose(mine, want[-20:], atol=1e-8)


def test_days_do_not_move_with_the_session_zone(spark, files):
    folder, df = files
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
        short = ingest(read_stream(spark, f"{folder}/in", df.schema, "parquet", 100), delay="1 hour")
        got = {(r.client_id, r.day): r.volume for r in drain(daily_stream(short), "zoned").collect()}
        want = {(r.client_id, r.day): r.volume for r in report.daily(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got and all(abs(got[k] - want[k]) < 1e-9 for k in got)
