"""Cleaning: required fields, duplicates, pressure imputation, negative values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens import schema as S
from meterlens.operators.blocks import checked_broadcast, hot_keys, task_count
from meterlens.operators.ordering import trailing_mean

HOUR = 3_600_000_000  # microseconds
BURST_ROWS = 100_000


def micros(ts: str = S.TS) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def drop_missing(df: DataFrame, subset: Sequence[str] = tuple(S.REQUIRED)) -> DataFrame:
    return df.na.drop(subset=list(subset))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def unparseable(df: DataFrame, ts: str = S.TS) -> DataFrame:
    return df.agg(F.count_if(F.col(ts).isNull()).alias("n_unparseable"))


def _pick(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row of each key in ``order``; one shuffle and one sort."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def keep_first(df: DataFrame, keys: Sequence[str] = (S.CLIENT, S.TS), order: str = S.ORD) -> DataFrame:
    """One row per key, the first in input order; a null order comes last."""
    return _pick(df, list(keys), F.col(order).asc_nulls_last())


def keep_last(df: DataFrame, keys: Sequence[str] = (S.CLIENT, S.TS), order: str = S.ORD) -> DataFrame:
    """One row per key, the last in input order; a null order comes first."""
    return _pick(df, list(keys), F.col(order).desc_nulls_last())


def duplicate_count(df: DataFrame, keys: Sequence[str] = (S.CLIENT, S.TS)) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"))


def prior_mean(
    df: DataFrame, lookback: int = 3 * HOUR, col: str = S.PRESSURE, *, max_rows: int | None = None
) -> DataFrame:
    """Add ``prior_mean``: the client's mean of ``col`` over ``[ts - lookback, ts)``, null if empty or without time.

    Spark's own sliding window reads the whole look-back for every row and holds a client in one task, so clients with
    more than ``max_rows`` readings, who may have sent them in one burst, go through running totals.
    """
    max_rows = max_rows or BURST_ROWS
    timed = df.withColumn("_us", micros())
    w = Window.partitionBy(S.CLIENT).orderBy("_us").rangeBetween(-lookback, -1)
    slide = F.when(F.col("_us").isNotNull(), F.avg(col).over(w))
    hot, n_hot, rows = hot_keys(timed, [S.CLIENT], max_rows)
    if n_hot == 0:
        return timed.withColumn("prior_mean", slide).drop("_us")
    side = checked_broadcast(hot.select(S.CLIENT), n_hot)
    few = timed.join(side, S.CLIENT, "left_anti").withColumn("prior_mean", slide)
    many = trailing_mean(
        timed.join(side, S.CLIENT, "left_semi"), [S.CLIENT], "_us", lookback, col, "prior_mean", parts=task_count(df, rows)
    )
    return few.unionByName(many).drop("_us")


def impute_pressure(
    df: DataFrame, lookback: int = 3 * HOUR, *, max_rows: int | None = None
) -> DataFrame:
    """Zero pressure with positive volume takes the mean of the look-back; ``imputed`` marks it.

    The mean is over the readings as they came: imputed values do not feed later ones.
    """
    base = drop_missing(df, [S.TS, S.CLIENT, S.VOLUME, S.PRESSURE])
    found = prior_mean(base, lookback, max_rows=max_rows)
    fix = (F.col(S.PRESSURE) == 0) & (F.col(S.VOLUME) > 0) & F.col("prior_mean").isNotNull()
    return (
        found.withColumn("imputed", fix)
        .withColumn(S.PRESSURE, F.when(fix, F.col("prior_mean")).otherwise(F.col(S.PRESSURE)))
        .drop("prior_mean")
    )


def imputation_report(imputed: DataFrame) -> DataFrame:
    """Per client: how many pressures were imputed and their mean."""
    return (
        imputed.where("imputed")
        .groupBy(S.CLIENT)
        .agg(F.count(F.lit(1)).alias("n_imputed"), F.avg(S.PRESSURE).alias("mean_imputed"))
    )


def clamp_negatives(df: DataFrame, cols: Sequence[str] = (S.VOLUME, S.PRESSURE)) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in cols})


def negative_counts(df: DataFrame, cols: Sequence[str] = (S.VOLUME, S.PRESSURE)) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in cols])


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str] = (S.CLIENT, S.TS)) -> DataFrame:
    """Stored readings plus a newer batch; the newest row of a key wins, empty rows go."""
    cols = stored.columns
    both = stored.withColumn("_batch", F.lit(0)).unionByName(
        batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    latest = _pick(both.withColumn("_age", F.struct("_batch", S.ORD)), list(keys), F.desc("_age"))
    return drop_empty_rows(latest.select(*cols))
