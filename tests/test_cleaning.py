"""Edge tables of the cleaning operators."""

import datetime as dt

import pytest

from meterlens import schema as S
from meterlens.operators import clean, columns
from meterlens.operators.timestamps import parse_fixed_timestamp, parse_timestamp

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.mark.parametrize(
    "text, want",
    [
        ("31-12-2023 11:05:00 PM", dt.datetime(2023, 12, 31, 23, 5)),
        ("31-12-2023 12:05 am", dt.datetime(2023, 12, 31, 0, 5)),
        ("31-12-23 23:05", dt.datetime(2023, 12, 31, 23, 5)),
        ("01-02-99 03:04", dt.datetime(1999, 2, 1, 3, 4)),
        ("13/02/2024 11:00", dt.datetime(2024, 2, 13, 11)),
        ("13/02/2024 11:00:07", dt.datetime(2024, 2, 13, 11, 0, 7)),
        ("2024-03-05", dt.datetime(2024, 3, 5)),
        ("2024-03-05T01:02:03", dt.datetime(2024, 3, 5, 1, 2, 3)),
        ("  2024-03-05   01:02 ", dt.datetime(2024, 3, 5, 1, 2)),
        ("5/3/2024", dt.datetime(2024, 3, 5)),
        ("2024-13-05", None),
        ("32-01-2024 10:00", None),
        ("31-12-2023 13:05:00 PM", None),
        ("zz", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string").select(
        parse_timestamp("s").alias("a"), parse_fixed_timestamp("s").alias("b")
    )
    assert df.first() == (want, want)


def test_headers(spark):
    df = spark.createDataFrame([("c", "2024-01-01", "1", "2", "3")], ["id_cliente", " FECHA ", "Volumen", "PRESION", "Temperatura"])
    assert columns.normalise_headers(df).columns == ["client_id", "ts", "volume", "pressure", "temperature"]
    hinted = spark.createDataFrame([("a", "b")], ["Medidor", "Punto"])
    assert columns.normalise_headers(hinted, client_hint="punto").columns == ["Medidor", "client_id"]
    with pytest.raises(S.MissingColumns):
        columns.require_date_column(spark.createDataFrame([(1,)], ["when"]))
    with pytest.raises(S.MissingColumns, match="volume"):
        columns.require_columns(spark.createDataFrame([("c", T0)], "client_id string, ts timestamp_ntz"))


def test_label_discovery(spark):
    named = spark.createDataFrame([(0, 7)], ["is_anom", "other"])
    assert columns.find_label_column(named) == "is_anom"
    found = spark.createDataFrame([("a", 3, 0), ("b", 1, 1), ("c", 2, None)], "name string, k int, mark int")
    assert columns.find_label_column(found) == "mark"
    with pytest.raises(S.MissingColumns):
        columns.find_label_column(spark.createDataFrame([(5,)], ["k"]))


def test_duplicates_keep_first_and_last(spark):
    rows = [("a", T0, 1.0, 2), ("a", T0, 2.0, 1), ("a", T0, 3.0, 3), ("b", T0, 4.0, 9), ("b", at(1), 5.0, 8)]
    df = spark.createDataFrame(rows, "client_id string, ts timestamp_ntz, volume double, src_ord long")
    first = {(r.client_id, r.ts): r.volume for r in clean.keep_first(df).collect()}
    last = {(r.client_id, r.ts): r.volume for r in clean.keep_last(df).collect()}
    assert first == {("a", T0): 2.0, ("b", T0): 4.0, ("b", at(1)): 5.0}
    assert last[("a", T0)] == 3.0
    assert clean.duplicate_count(df).first()[0] == 2


LOOKBACK = "client_id string, ts timestamp_ntz, pressure double, volume double, src_ord long"


def test_lookback_edges(spark):
    rows = [
        ("a", at(0), 4.0, 1.0, 0),  # no earlier reading
        ("a", at(3), 0.0, 1.0, 1),  # the reading exactly 3 h before counts
        ("a", at(6.5), 0.0, 1.0, 2),  # nothing within 3 h
        ("a", at(7), 0.0, 0.0, 3),  # no volume: stays
        ("a", at(8), 0.0, 2.0, 4),  # zeros count in the mean, imputed values do not
        ("b", at(0), -2.0, 1.0, 5),
        ("b", at(1), 0.0, 1.0, 6),  # a negative neighbour enters the mean
    ]
    df = spark.createDataFrame(rows, LOOKBACK)
    for max_rows in (None, 2):
        out = {r.src_ord: (r.pressure, r.imputed) for r in clean.impute_pressure(df, max_rows=max_rows).collect()}
        assert out == {
            0: (4.0, False), 1: (4.0, True), 2: (0.0, False), 3: (0.0, False), 4: (0.0, True), 5: (-2.0, False), 6: (-2.0, True),
        }
    report = {r.client_id: (r.n_imputed, r.mean_imputed) for r in clean.imputation_report(clean.impute_pressure(df)).collect()}
    assert report == {"a": (2, 2.0), "b": (1, -2.0)}


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0, None, -5.0), (2.0, -3.0, 1.0)], "volume double, pressure double, temperature double")
    assert clean.clamp_negatives(df).collect() == [(0.0, None, -5.0), (2.0, 0.0, 1.0)]
    assert clean.negative_counts(df).first() == (1, 1)


def test_upsert_newest_wins(spark):
    cols = "client_id string, ts timestamp_ntz, volume double, src_ord long"
    old = spark.createDataFrame([("a", T0, 1.0, 5), ("b", T0, 2.0, 6), (None, None, None, None)], cols)
    new = spark.createDataFrame([("a", T0, 9.0, 0), ("a", T0, 10.0, 1), ("c", T0, 3.0, 2)], cols)
    got = sorted((r.client_id, r.volume) for r in clean.upsert(old, new).collect())
    assert got == [("a", 10.0), ("b", 2.0), ("c", 3.0)]


def test_null_order_and_few_values(spark):
    """A row without an order loses against one that has it, and keeps its values if it is alone."""
    rows = [("a", 1, 1.0, None), ("a", 1, 2.0, 5), ("b", 1, 3.0, None)]
    df = spark.createDataFrame(rows, "client_id string, ts int, volume double, src_ord long")
    for keep in (clean.keep_first, clean.keep_last):
        assert sorted((r.client_id, r.volume) for r in keep(df).collect()) == [("a", 2.0), ("b", 3.0)]
