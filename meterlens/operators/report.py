"""Consumption reports over readings and flags."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, functions as F

from meterlens import schema as S
from meterlens.operators.blocks import beside, series_blocks, task_count
from meterlens.operators.quantiles import exact_quantiles
from meterlens.operators.series import hourly_grid, interpolate


def one_client(df: DataFrame, client: str) -> DataFrame:
    return df.where(F.col(S.CLIENT) == client)


def one_segment(df: DataFrame, segment: str) -> DataFrame:
    return df.where(F.col(S.SEGMENT) == segment)


def date_range(df: DataFrame, first: date, last: date) -> DataFrame:
    """Readings from ``first`` 00:00 to ``last`` 00:00, both included."""
    midnight = lambda d: F.lit(datetime.combine(d, time.min).isoformat(sep=" ")).cast("timestamp_ntz")
    return df.where(F.col(S.TS).between(midnight(first), midnight(last)))


def source_counts(df: DataFrame, source: str = S.CLIENT) -> DataFrame:
    """Rows per source and whether they add up to the total."""
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    sums = per.agg(F.sum("n").alias("summed"))
    check = beside(total, sums).select("total", (F.col("total") == F.col("summed")).alias("ok"))
    return beside(per, check)


def daily(df: DataFrame, keys: Sequence[str] = (S.CLIENT,)) -> DataFrame:
    """Volume sum and mean pressure and temperature per key and calendar day."""
    day = F.to_date(S.TS).cast("timestamp_ntz").alias("day")  # the reading's own day, whatever the session's zone
    return df.groupBy(*keys, day).agg(
        F.sum(S.VOLUME).alias(S.VOLUME),
        F.avg(S.PRESSURE).alias(S.PRESSURE),
        F.avg(S.TEMPERATURE).alias(S.TEMPERATURE),
    )


def daily_calendar(df: DataFrame, keys: Sequence[str] = (S.CLIENT,)) -> DataFrame:
    """``daily`` with a row for every day between a key's first and last: sum 0, means null."""
    per_day = daily(df, keys)
    ends = per_day.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    ends = ends.repartition(task_count(df), *keys, "_a")  # every row becomes many: spread them first
    slots = ends.select(*keys, F.expr("explode(sequence(_a, _b, interval 1 day))").alias("day"))
    return slots.join(per_day, [*keys, "day"], "left").withColumn(
        S.VOLUME, F.coalesce(S.VOLUME, F.lit(0.0))
    )


def history_kpis(df: DataFrame, keys: Sequence[str] = (S.CLIENT,)) -> DataFrame:
    """Total volume, means over days, and the 90th percentile of the daily volume.

    A key has at most one row per calendar day here, so its percentile buffer stays small.
    """
    return daily_calendar(df, keys).groupBy(*keys).agg(
        F.sum(S.VOLUME).alias("total_volume"),
        F.avg(S.VOLUME).alias("avg_daily_volume"),
        F.avg(S.PRESSURE).alias("avg_daily_pressure"),
        F.avg(S.TEMPERATURE).alias("avg_daily_temperature"),
        F.percentile(S.VOLUME, F.lit(0.9)).alias("p90_daily_volume"),
    )


def client_history(df: DataFrame, keys: Sequence[str] = (S.CLIENT,)) -> DataFrame:
    """``history_kpis`` over full hours: readings on the hourly grid of their client, gaps filled linearly."""
    grid = hourly_grid(df, truncate=True).drop("is_filled")
    filled = interpolate(series_blocks(grid, 0, 0, keys=(S.CLIENT,), order=(S.TS,)))
    return history_kpis(filled.core(), keys)


def describe(
    df: DataFrame,
    cols: Sequence[str] = (S.VOLUME, S.TEMPERATURE, S.PRESSURE),
    *,
    max_values: int | None = None,
) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per variable."""
    quartiles = exact_quantiles(df, [], cols, [0.25, 0.5, 0.75], max_values=max_values)
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"), F.max(c).alias("max"),
            ).alias(f"m_{c}")
            for c in cols
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("variable"), f"m_{c}.count", f"m_{c}.mean", f"m_{c}.std", f"m_{c}.min",
            F.get(c, F.lit(0)).alias("q25"), F.get(c, F.lit(1)).alias("q50"), F.get(c, F.lit(2)).alias("q75"),
            f"m_{c}.max",
        )
        for c in cols
    ]
    return beside(moments, quartiles).select(F.inline(F.array(*rows)))


def volume_by_client(df: DataFrame) -> DataFrame:
    return df.groupBy(S.CLIENT).agg(F.sum(S.VOLUME).alias("total_volume"))


def top_clients(df: DataFrame, k: int = 10) -> DataFrame:
    return volume_by_client(df).orderBy(F.desc("total_volume"), S.CLIENT).limit(k)


def busiest_clients(df: DataFrame, k: int = 5) -> DataFrame:
    counted = df.groupBy(S.CLIENT).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), S.CLIENT).limit(k)


def latest_rows(df: DataFrame, k: int = 300, order: Sequence[str] = (S.TS, S.CLIENT, S.ORD)) -> DataFrame:
    """The last ``k`` rows, in ascending order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k).orderBy(*order)


def segment_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(S.SEGMENT).agg(
        F.sum(S.VOLUME).alias("total_volume"), F.avg(S.VOLUME).alias("avg_volume")
    )


def segment_shares(df: DataFrame) -> DataFrame:
    """Rows per segment, their share of all rows, and the distinct clients."""
    per_client = df.groupBy(S.SEGMENT, S.CLIENT).agg(F.count(F.lit(1)).alias("n"))
    per = per_client.groupBy(S.SEGMENT).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_clients")
    )
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return beside(per, total).select(
        S.SEGMENT, "n_rows", (F.col("n_rows") / F.col("_total")).alias("share"), "n_clients"
    )


def clients_per_segment(df: DataFrame) -> DataFrame:
    return df.groupBy(S.SEGMENT).agg(F.countDistinct(S.CLIENT).alias("n_clients"))


def global_kpis(df: DataFrame) -> DataFrame:
    """Distinct clients, total and mean volume, by way of one row per client."""
    per = df.groupBy(S.CLIENT).agg(F.sum(S.VOLUME).alias("_s"), F.count(S.VOLUME).alias("_n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_clients"),
        F.sum("_s").alias("total_volume"),
        (F.sum("_s") / F.sum("_n")).alias("avg_volume"),
    )


def modal_segment(df: DataFrame) -> DataFrame:
    """The most frequent segment of each client; the first in order wins a tie."""
    counted = df.where(F.col(S.SEGMENT).isNotNull()).groupBy(S.CLIENT, S.SEGMENT).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.min_by(S.SEGMENT, F.struct(-F.col("n"), F.col(S.SEGMENT)))
    return counted.groupBy(S.CLIENT).agg(best.alias(S.SEGMENT))


def date_extent(df: DataFrame) -> DataFrame:
    """First and last day; without dates, the last 30 days."""
    first, last = F.to_date(F.min(S.TS)), F.to_date(F.max(S.TS))
    return df.agg(
        F.coalesce(first, F.date_sub(F.current_date(), 30)).alias("first_day"),
        F.coalesce(last, F.current_date()).alias("last_day"),
    )


def zero_share(df: DataFrame) -> DataFrame:
    return df.groupBy(S.CLIENT).agg(
        F.avg((F.col(S.VOLUME) == 0).cast("double")).alias("zero_share")
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.trim(F.col(col).cast("string")).alias(col)).na.drop().distinct().orderBy(col)


def long_series(df: DataFrame) -> DataFrame:
    """Real and forecast volume as two rows per reading."""
    renamed = df.withColumnsRenamed({"volume_next": "volume_real", "volume_hat": "volume_pred"})
    return renamed.unpivot(
        [S.CLIENT, S.TS], ["volume_real", "volume_pred"], "series", "value"
    )


def friendly_number(col: Column | str, dp: int = 2) -> Column:
    """Text with thousands separators: ``N/A`` for null, no decimals for large whole numbers."""
    c = F.col(col) if isinstance(col, str) else col
    whole = (F.abs(c) >= 1000) & (F.floor(c) == c)
    return F.when(c.isNull() | F.isnan(c), "N/A").when(whole, F.format_number(c, 0)).otherwise(
        F.format_number(c, dp)
    )
