"""Readers and writers."""

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from meterlens.sources import readers, writers

TEXT = "Fecha{s}Cliente{s}Segmento{s}Presion{s}Temperatura{s}Volumen\n01-02-2024 11:00:00 PM{s}A ñ{s}Comercial{s}1.5{s}20{s}7\n2024-02-03{s}B{s}Industrial{s}x{s}21{s}8.5\n"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "latin-1"])
def test_any_csv(spark, tmp_path, sep, encoding):
    path = tmp_path / "in.csv"
    path.write_bytes(TEXT.format(s=sep).encode(encoding))
    rows = readers.typed_readings(readers.read_any(spark, str(path))).orderBy("src_ord").collect()
    assert [r.client_id for r in rows] == ["A ñ", "B"]
    assert [r.ts for r in rows] == [dt.datetime(2024, 2, 1, 23), dt.datetime(2024, 2, 3)]
    assert [r.pressure for r in rows] == [1.5, None] and [r.volume for r in rows] == [7.0, 8.5]


def test_unreadable_inputs(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "e.xyz"))
    with pytest.raises(ValueError):
        readers.union_sources([])
    assert readers.empty_readings(spark).count() == 0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_one_file_per_client(spark, tmp_path, fmt):
    import pandas as pd

    for name, extra in (("uno", {}), ("dos tres", {"Temperatura": [3.0]})):
        frame = pd.DataFrame({"Fecha": ["2024-01-01"], "Volumen": [1.0], **(extra if fmt == "parquet" else {})})
        getattr(frame, f"to_{fmt}")(tmp_path / f"{name}.{fmt}", index=False)
    df = readers.read_client_files(spark, str(tmp_path), fmt)
    assert sorted(r.client_id for r in df.collect()) == ["dos tres", "uno"]
    if fmt == "parquet":
        assert "Temperatura" in df.columns


def test_csv_and_segment_folders(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1), "In/dus trial", 1.0), ("b", dt.datetime(2024, 1, 2), "Comercial", 2.0)]
    df = spark.createDataFrame(rows, "client_id string, ts timestamp_ntz, segment string, volume double")
    writers.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == ["Cliente", "Fecha", "Segmento", "Volumen"] and back.count() == 2
    writers.write_by_segment(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"seg=In_dus_trial", "seg=Comercial"}


def test_metrics_json(spark, tmp_path):
    df = spark.createDataFrame([("__all__", 0.5, None), ("A", 0.4, 0.9), ("B", 0.6, 0.8)], "segment string, f1 double, thr_if double")
    writers.write_metrics_json(df, str(tmp_path / "m"))
    text = next(p for p in (tmp_path / "m").iterdir() if p.suffix == ".json").read_text()
    got = json.loads(text)
    assert got["overall"] == {"f1": 0.5} and [r["segment"] for r in got["by_segment"]] == ["A", "B"]


def test_store_versions(spark, tmp_path):
    cols = "client_id string, ts timestamp_ntz, volume double, src_ord long"
    day = dt.datetime(2024, 1, 1)
    store = writers.ReadingsStore(spark, str(tmp_path))
    assert store.current() is None
    store.upsert(spark.createDataFrame([("a", day, 1.0, 0), ("b", day, 2.0, 1)], cols))
    store.upsert(spark.createDataFrame([("a", day, 5.0, 0)], cols))
    assert sorted((r.client_id, r.volume) for r in store.current().collect()) == [("a", 5.0), ("b", 2.0)]


def test_run_log(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5, 3)], "segment string, rmse double, n long")
    for run in ("r1", "r2"):
        writers.log_run(df, str(tmp_path / "log"), run, "train")
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert {(r.run_id, r.key, r.value) for r in rows} == {(r, k, v) for r in ("r1", "r2") for k, v in (("rmse", "1.5"), ("n", "3"))}


def test_an_update_writes_only_the_months_it_touches(spark, tmp_path):
    rows = [("a", f"2024-{m:02d}-05 00:00:00", 1.0, m) for m in range(1, 7)]
    schema = "client_id string, ts string, volume double, src_ord long"
    make = lambda r: spark.createDataFrame(r, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    store = writers.ReadingsStore(spark, str(tmp_path))
    assert store.current() is None
    store.upsert(make(rows))
    store.upsert(make([("a", "2024-03-05 00:00:00", 9.0, 1), ("b", "2024-03-06 00:00:00", 2.0, 2), ("c", None, 3.0, 3)]))
    versions = sorted((p.name, sorted(m.name for m in p.iterdir() if m.is_dir())) for p in (tmp_path / "data").iterdir())
    assert sorted(len(months) for _, months in versions) == [2, 6]
    got = {(r.client_id, r.ts and r.ts.month): r.volume for r in store.current().collect()}
    assert got == {("a", m): 1.0 for m in (1, 2, 4, 5, 6)} | {("a", 3): 9.0, ("b", 3): 2.0, ("c", None): 3.0}
    store.write(make(rows[:1]))
    assert store.current().count() == 1


ROW = "client_id string, ts timestamp_ntz, volume double, src_ord long"


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Both read the same state and write: in one month the later one merges again, in another it only takes the next number."""
    store = writers.ReadingsStore(spark, str(tmp_path))
    store.upsert(spark.createDataFrame([("old", dt.datetime(2024, 1, 1), 0.0, 0)], ROW))
    for months in ((1, 1), (1, 2), (1, 1)):
        meet, plain = Barrier(2), writers.ReadingsStore._written
        calls = []

        def together(self, df):
            calls.append(1)
            made = plain(self, df)
            if len(calls) <= 2:
                meet.wait(60)
            return made

        monkeypatch.setattr(writers.ReadingsStore, "_written", together)
        before = store.current().count()
        batches = [
            spark.createDataFrame([(f"{before}-{i}", dt.datetime(2024, m, 2 + i), 1.0, 0)], ROW) for i, m in enumerate(months)
        ]
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(lambda b: writers.ReadingsStore(spark, str(tmp_path)).upsert(b), batches))
        monkeypatch.undo()
        assert store.current().count() == before + 2
        assert len(calls) == (3 if months[0] == months[1] else 2)
    assert [e.n for e in store.log.entries()] == list(range(7))


def test_an_entry_is_written_once(spark, tmp_path):
    log = writers.CommitLog(spark, str(tmp_path / "log"))
    assert log.last().n == -1 and log.entries() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.put(writers.Entry(0, {"202401": str(i)})), range(32)))
    assert sum(won) == 1 and log.last().state == {"202401": str(won.index(True))}
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["000000000000.json"]


def test_store_stays_small(spark, tmp_path):
    store = writers.ReadingsStore(spark, str(tmp_path), keep=2)
    first = [("a", dt.datetime(2024, m, 1), 1.0, 0) for m in (1, 2, 3)]
    store.upsert(spark.createDataFrame(first, ROW))
    again = spark.createDataFrame([("b", dt.datetime(2024, 3, 1), -1.0, 0)], ROW)
    for i in range(50):
        store.upsert(spark.createDataFrame([("b", dt.datetime(2024, 2, 1), float(i), 0)], ROW), "s", i)
        store.upsert(again, "s", i)  # its number is taken, so it is left out
    assert len(list((tmp_path / "log").iterdir())) <= 4
    months = [p for v in (tmp_path / "data").iterdir() for p in v.iterdir() if p.is_dir()]
    assert len(months) <= 3 + 4
    got = sorted((r.client_id, r.ts.month, r.volume) for r in store.current().collect())
    assert got == [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 2, 49.0)]


def test_an_empty_table_empties_the_store(spark, tmp_path):
    store = writers.ReadingsStore(spark, str(tmp_path))
    store.write(spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0, 0)], ROW))
    store.write(spark.createDataFrame([], ROW))
    assert store.current().count() == 0
    assert store.log.last().n == 1
