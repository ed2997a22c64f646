"""Exploration job: distribution, correlation and seasonality of readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from meterlens import schema as S
from meterlens.operators import explore, report
from meterlens.operators.blocks import Blocks, series_blocks
from meterlens.session import cut

MAX_LAG = 400
MIN_REPORT_POINTS = 50


@dataclass(frozen=True)
class ColumnReport:
    normality: DataFrame
    nulls: DataFrame
    top_values: DataFrame
    correlation: DataFrame


def column_report(df: DataFrame, cols: list[str] = list(S.MEASURES)) -> ColumnReport:
    return ColumnReport(
        explore.normality(df, cols), explore.null_counts(df), explore.top_values_all(df), explore.correlation(df)
    )


def seasonal_series(df: DataFrame, keys: list[str], order: list[str], *, max_rows: int | None = None) -> Blocks:
    """Blocks whose margins reach as far as the seasonality statistics look."""
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = max(MAX_LAG, explore.adf_max_lag(longest) + 1, int(4 * longest ** (1 / 3)))
    return series_blocks(df, reach, reach, keys=keys, order=order, max_rows=max_rows)


def series_statistics(
    df: DataFrame, keys: list[str], order: list[str], col: str = S.VOLUME, *, max_rows: int | None = None
) -> DataFrame:
    """Per series: seasonal period, ADF and KPSS, zero share, ACF and PACF to 40 lags.

    Series of fewer than 50 points are left out.
    """
    clean = cut(df.where(F.col(col).isNotNull()).select(*keys, *order, col))
    blocks = seasonal_series(clean, keys, order, max_rows=max_rows)
    blocks = blocks.on(blocks.df.where(F.col("n_rows") >= MIN_REPORT_POINTS))
    sums = cut(explore.lag_sums(blocks, col, MAX_LAG))
    acf = explore.autocorrelation(sums.where("lag <= 40"), keys)
    pacf = explore.partial_autocorrelation(acf, keys)
    lists = (
        acf.join(pacf, [*keys, "lag"])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("lag", "acf", "pacf"))).alias("_l"))
        .select(*keys, F.col("_l.acf").alias("acf"), F.col("_l.pacf").alias("pacf"))
    )
    zeros = clean.groupBy(*keys).agg(F.avg((F.col(col) == 0).cast("double")).alias("zero_share"))
    return (
        explore.adf(blocks, col)
        .join(explore.kpss(blocks, col, sums).drop("n"), keys)
        .join(explore.seasonal_period(sums, keys), keys)
        .join(lists, keys)
        .join(zeros, keys)
    )


def client_report(df: DataFrame, top: int = 5, *, max_rows: int | None = None) -> DataFrame:
    """``series_statistics`` of the clients with most readings, with their hour and weekday medians."""
    chosen = cut(report.busiest_clients(df, top).select(S.CLIENT))
    mine = cut(df.join(F.broadcast(chosen), S.CLIENT, "left_semi"))
    stats = series_statistics(mine, [S.CLIENT], [S.TS, S.ORD], max_rows=max_rows)
    for part in ("hour", "weekday"):
        medians = explore.median_profile(mine, part, [S.CLIENT])
        packed = medians.groupBy(S.CLIENT).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(part, "median_volume")))).alias(f"median_by_{part}")
        )
        stats = stats.join(packed, S.CLIENT, "left")
    return stats


def all_series(df: DataFrame) -> DataFrame:
    """The readings of all clients as one series (``series`` is its key), in time order."""
    return df.withColumn("series", F.lit(0))
