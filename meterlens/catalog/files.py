"""Source and sink queries: the given readings written out and read back."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from meterlens.catalog.registry import query
from meterlens.catalog.views import cte, readings
from meterlens.operators import evaluate, explore
from meterlens.operators.clean import keep_last
from meterlens.session import shared_dir
from meterlens.sources import readers, writers

O = "readings_o"
_FIELDS = "client_id, ts, segment, pressure, temperature, round(volume, 5) AS volume"


def _folder(spark, ending: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}{ending}"


def _fields(df):
    return df.select("client_id", "ts", "segment", "pressure", "temperature", F.round("volume", 5).alias("volume"))


@query("csv_round_trip", f"WITH {cte(O)} SELECT {_FIELDS} FROM {O}")
def _(spark, sf):
    """Exchange headers and plain timestamps out, sniffed separator and typed columns back."""
    path = _folder(spark, ".csv")
    writers.write_csv(readings(spark, sf, O).drop("src_ord", "label"), path)
    return _fields(readers.typed_readings(readers.read_any(spark, path)))


@query("csv_fractional_seconds", f"WITH {cte('readings_e')} SELECT {_FIELDS}, label FROM readings_e")
def _(spark, sf):
    """Timestamps with fractions of a second survive the library's own CSV."""
    path = _folder(spark, ".csv")
    writers.write_csv(readings(spark, sf, "readings_e").drop("src_ord"), path)
    back = readers.typed_readings(readers.read_any(spark, path))
    return back.select(*_fields(back).columns, F.col("label").cast("int").alias("label")).withColumn("volume", F.round("volume", 5))


_PARTS = 3


@query(
    "client_files_union",
    f"""WITH {cte(O)} SELECT CASE WHEN src_ord % {_PARTS} = 2 THEN 'c 2' ELSE concat('c', src_ord % {_PARTS}) END AS client_id, ts,
        round(volume, 5) AS volume, pressure, CASE WHEN src_ord % {_PARTS} = 2 THEN NULL ELSE temperature END AS temperature
        FROM {O}""",
)
def _(spark, sf):
    """One file per client, with columns in two orders and one missing; read by name."""
    folder, df = _folder(spark, ""), readings(spark, sf, O)
    orders = (
        ("c0", ["ts", "volume", "pressure", "temperature"]),
        ("c1", ["temperature", "pressure", "ts", "volume"]),
        ("c 2", ["volume", "ts", "pressure"]),
    )
    for i, (client, columns) in enumerate(orders):
        writers.write_csv(df.where(f"src_ord % {_PARTS} = {i}").select(*columns).coalesce(1), f"{folder}/{client}.csv")
    back = readers.typed_readings(readers.read_client_files(spark, folder))
    return back.select("client_id", "ts", F.round("volume", 5).alias("volume"), "pressure", "temperature")


_MOMENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, 5 AS n_crit FROM {O}"
    for c in ("volume", "temperature")
)


@query("normality_csv_round_trip", f"WITH {cte(O)} {_MOMENTS}")
def _(spark, sf):
    """The normality table, critical values and all, as CSV and back."""
    path = _folder(spark, ".csv")
    writers.write_csv(explore.normality(readings(spark, sf, O), ["volume", "temperature"]), path, external=False)
    return readers.read_any(spark, path).selectExpr(
        "variable", "CAST(n AS BIGINT) AS n", "round(CAST(mean AS DOUBLE), 4) AS mean", "round(CAST(std AS DOUBLE), 4) AS std",
        "size(from_json(anderson_crit, 'array<double>')) AS n_crit",
    )


@query(
    "run_log_round_trip",
    f"""WITH {cte(O)} SELECT 'r1' AS run_id, 'count' AS phase, segment, 'n' AS key, CAST(count(*) AS VARCHAR) AS value
        FROM {O} GROUP BY segment UNION ALL SELECT 'r2', 'count', segment, 'n', CAST(count(*) AS VARCHAR) FROM {O}
        WHERE src_ord % 2 = 0 GROUP BY segment""",
)
def _(spark, sf):
    """Two runs appended to the log."""
    path, df = _folder(spark, ""), readings(spark, sf, O)
    for run, part in (("r1", df), ("r2", df.where("src_ord % 2 = 0"))):
        writers.log_run(part.groupBy("segment").agg(F.count(F.lit(1)).alias("n")), path, run, "count")
    return readers.read_parquet(spark, path)


@query(
    "metrics_json_round_trip",
    f"""WITH {cte(O)}, c AS (SELECT coalesce(segment, '__all__') AS segment, count(*) AS n_eval, count(*) FILTER (label = 1) AS positives_true
        FROM {O} GROUP BY GROUPING SETS ((segment), ())) SELECT * FROM c""",
)
def _(spark, sf):
    """Evaluation records as nested JSON and back."""
    path = _folder(spark, ".json")
    flagged = readings(spark, sf, O).withColumn("flag_final", F.lit(0))
    writers.write_metrics_json(evaluate.confusion_metrics(flagged, truth="label"), path)
    back = spark.read.json(path)
    parts = F.concat(
        F.array(F.struct(F.lit("__all__").alias("segment"), "overall.n_eval", "overall.positives_true")),
        F.transform("by_segment", lambda r: F.struct(r["segment"].alias("segment"), r["n_eval"].alias("n_eval"), r["positives_true"].alias("positives_true"))),
    )
    return back.select(F.inline(parts))


@query("segment_folders_round_trip", f"WITH {cte(O)} SELECT {_FIELDS} FROM {O} WHERE segment = 'Industrial'")
def _(spark, sf):
    """One folder per segment; reading one segment prunes the others."""
    path = _folder(spark, "")
    writers.write_by_segment(readings(spark, sf, O).drop("label"), path, "parquet")
    back = readers.read_parquet(spark, path).where("seg = 'Industrial'").drop("seg")
    return _fields(readers.typed_readings(back))


@query("store_upsert", f"WITH {cte(O)} SELECT {_FIELDS}, src_ord FROM {O} QUALIFY row_number() OVER (PARTITION BY client_id, ts ORDER BY src_ord % 2 DESC, src_ord DESC) = 1")
def _(spark, sf):
    """Two batches into the readings store; the newest row of a key stays."""
    store = writers.ReadingsStore(spark, _folder(spark, ""))
    df = readings(spark, sf, O).drop("label")
    store.upsert(keep_last(df.where("src_ord % 2 = 0")))
    store.upsert(df.where("src_ord % 2 = 1"))
    return store.current().select(*_fields(df).columns, "src_ord").withColumn("volume", F.round("volume", 5))


@query("store_two_writers", f"WITH {cte(O)} SELECT {_FIELDS}, src_ord FROM {O} QUALIFY row_number() OVER (PARTITION BY client_id, ts ORDER BY src_ord DESC) = 1")
def _(spark, sf):
    """Two writers at once on the same months, and a batch whose number the store already has; nothing is lost."""
    path = _folder(spark, "")
    df = readings(spark, sf, O).drop("label")
    half = F.pmod(F.xxhash64("client_id"), F.lit(2))
    batches = [keep_last(df.where(half == i)) for i in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda i: writers.ReadingsStore(spark, path).upsert(batches[i], f"writer{i}", 7), range(2)))
    store = writers.ReadingsStore(spark, path)
    store.upsert(df.withColumn("volume", F.lit(0.0)), "writer0", 7)
    return store.current().select(*_fields(df).columns, "src_ord").withColumn("volume", F.round("volume", 5))
