"""Streams of readings: ingest, daily rollup, upsert into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from meterlens import schema as S
from meterlens.operators.clean import drop_missing, keep_last
from meterlens.operators.columns import coerce_measures, normalise_headers, require_columns
from meterlens.operators.timestamps import parse_timestamp
from meterlens.sources.writers import ReadingsStore

CLOCK = "event_time"
EPOCH = "1970-01-01 00:00:00"


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "csv",
    files_per_batch: int = 100,
    pattern: str | None = None,
) -> DataFrame:
    """New files of a folder, optionally only those whose name fits ``pattern``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(fmt).load(folder)


def ingest(raw: DataFrame, delay: str = "2 days") -> DataFrame:
    """Typed, complete readings of a stream; the first of a (client, timestamp) is kept.

    ``event_time`` carries the watermark: a reading more than ``delay`` behind the newest one is
    dropped, and duplicates are remembered that long.
    """
    df = normalise_headers(raw)
    if isinstance(df.schema[S.TS].dataType, T.StringType):
        df = df.withColumn(S.TS, parse_timestamp(S.TS))
    df = drop_missing(require_columns(coerce_measures(df)))
    # A watermark needs an instant: the one at which a clock in UTC shows the reading's own time, whatever the
    # session's zone, so that days and watermarks never move with it.
    since = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(S.TS))
    marked = df.withColumn(CLOCK, F.timestamp_micros(since)).withWatermark(CLOCK, delay)
    return marked.dropDuplicatesWithinWatermark([S.CLIENT, S.TS])


def _own_time(instant: Column) -> Column:
    """The time that a clock in UTC shows at an instant."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(EPOCH).cast("timestamp_ntz"))


def daily_stream(readings: DataFrame) -> DataFrame:
    """Volume sum and mean pressure and temperature per client and day, emitted once a day is closed."""
    day = F.window(CLOCK, "1 day")
    return (
        readings.groupBy(S.CLIENT, day)
        .agg(
            F.sum(S.VOLUME).alias(S.VOLUME),
            F.avg(S.PRESSURE).alias(S.PRESSURE),
            F.avg(S.TEMPERATURE).alias(S.TEMPERATURE),
        )
        .select(S.CLIENT, _own_time(F.col("window.start")).alias("day"), *S.MEASURES)
    )


def upsert_stream(readings: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into the readings store, newest row wins.

    A later batch beats an earlier one; within a batch the later row wins, and ``src_ord`` is its place there. The store
    remembers the last batch of each ``checkpoint``, so one that runs again is left out.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in S.READINGS.names if c in batch.columns and c != S.ORD]
        placed = batch.select(*cols, F.monotonically_increasing_id().alias(S.ORD))
        ReadingsStore(batch.sparkSession, store_path).upsert(keep_last(placed), checkpoint, batch_id)

    return (
        readings.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
