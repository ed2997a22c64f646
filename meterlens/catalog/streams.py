"""Streaming queries: the given tables read as a stream to its end, the result read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meterlens.catalog.jobs import trained_models
from meterlens.catalog.registry import query
from meterlens.catalog.views import EVENTS, LINEITEM, cte, table
from meterlens.config import JobParams
from meterlens.session import shared_dir
from meterlens.sources.writers import ReadingsStore
from meterlens.streaming.ingest import daily_stream, ingest, read_stream, upsert_stream
from meterlens.streaming.score import score_stream


def _stream(spark: SparkSession, sf: str, name: str, columns: dict[str, str]) -> DataFrame:
    schema = table(spark, sf, name).schema
    raw = read_stream(spark, sf, schema, "parquet", pattern=f"{name}.parquet")
    return raw.selectExpr(*[f"{expr} AS {c}" for c, expr in columns.items() if c not in ("src_ord", "label")])


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _drain(df: DataFrame) -> DataFrame:
    """Run a stream over all there is and read its output table."""
    spark = df.sparkSession
    out, mark = _new_folder(spark), _new_folder(spark)
    running = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
    running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(
    "stream_unique_readings",
    f"WITH {cte('readings_l')} SELECT DISTINCT client_id, ts FROM readings_l",
)
def _(spark, sf):
    return _drain(ingest(_stream(spark, sf, "lineitem", LINEITEM)).select("client_id", "ts"))


@query(
    "stream_daily_rollup",
    f"""WITH {cte('readings_e')}, d AS (SELECT client_id, date_trunc('day', ts)::TIMESTAMP AS day, sum(volume) AS volume,
            avg(pressure) AS pressure, avg(temperature) AS temperature FROM readings_e GROUP BY 1, 2)
        SELECT client_id, day, round(volume, 4) AS volume, round(pressure, 4) AS pressure, round(temperature, 4) AS temperature FROM d
        WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM readings_e)""",
)
def _(spark, sf):
    daily = _drain(daily_stream(ingest(_stream(spark, sf, "events", EVENTS), "1 hour")))
    return daily.selectExpr(
        "client_id", "day", "round(volume, 4) AS volume", "round(pressure, 4) AS pressure", "round(temperature, 4) AS temperature"
    )


@query(
    "stream_upsert",
    f"WITH {cte('readings_e')} SELECT client_id, ts, segment, volume, pressure, temperature FROM readings_e",
)
def _(spark, sf):
    store = _new_folder(spark)
    upsert_stream(_stream(spark, sf, "events", EVENTS), store, _new_folder(spark)).awaitTermination()
    kept = ReadingsStore(spark, store).current()
    return kept.select("client_id", "ts", "segment", "volume", "pressure", "temperature")


@query("stream_scores")
def _(spark, sf):
    return _drain(score_stream(ingest(_stream(spark, sf, "events", EVENTS)), trained_models(spark, sf), JobParams()))
