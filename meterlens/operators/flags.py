"""From raw scores to flags and grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterlens import schema as S
from meterlens.config import AnomalyParams, SeverityParams
from meterlens.operators.quantiles import exact_quantiles


def score_range(df: DataFrame, keys: Sequence[str] = (S.SEGMENT,), score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"))


def score_thresholds(
    df: DataFrame,
    ranges: DataFrame,
    p: AnomalyParams,
    keys: Sequence[str] = (S.SEGMENT,),
    score: str = "score",
    *,
    max_values: int | None = None,
) -> DataFrame:
    """``ranges`` plus ``thr_if``, the 1-contamination quantile of the normalised score.

    Normalising is monotone and linear, so the quantile is taken on the raw score.
    """
    q = exact_quantiles(df, keys, [score], [1.0 - p.contamination], max_values=max_values)
    cutoff = q.select(*keys, F.get(score, F.lit(0)).alias("_q"))
    return ranges.join(cutoff, list(keys)).select(
        *keys, "score_min", "score_max", normalised("_q").alias("thr_if")
    )


def normalised(score: str = "score") -> Column:
    """Score on [0,1] between ``score_min`` and ``score_max``; a flat range divides by 1."""
    width = F.col("score_max") - F.col("score_min")
    return (F.col(score) - F.col("score_min")) / F.when(width > 1e-9, width).otherwise(F.lit(1.0))


def flag(
    df: DataFrame,
    thresholds: DataFrame | None,
    p: AnomalyParams,
    keys: Sequence[str] = (S.SEGMENT,),
    score: str = "score",
) -> DataFrame:
    """Add ``proba``, ``flag_if``, ``flag_z`` and their fusion ``flag_final``.

    ``thresholds`` has one row per segment, taken from this batch or stored at training time; None
    where ``df`` carries its columns already.
    """
    if thresholds is not None:
        df = df.join(thresholds, list(keys), "left")
    joined = df.withColumn("proba", normalised(score))
    by_score = F.col("proba") >= F.col("thr_if")
    by_z = F.col("z_abs") >= p.z_threshold
    fused = (by_score | by_z) if p.fusion == "or" else (by_score & by_z)
    return joined.withColumns(
        {
            "flag_if": by_score.cast("int"),
            "flag_z": by_z.cast("int"),
            "flag_final": fused.cast("int"),
        }
    ).drop("score_min", "score_max")


def severity(score: Column | str = "proba", p: SeverityParams = SeverityParams()) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return (
        F.when(c >= p.critical, "Crítica")
        .when(c >= p.medium, "Media")
        .when(c >= p.mild, "Leve")
        .otherwise("")
    )


def severity_counts(flagged: DataFrame, p: SeverityParams = SeverityParams()) -> DataFrame:
    """Counts of the three grades over final flags; a grade nobody got shows 0."""
    grades = [F.lit(g) for g in ("Leve", "Media", "Crítica")]
    counted = (
        flagged.where("flag_final = 1")
        .groupBy(severity(p=p).alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    three = flagged.sparkSession.range(1).select(F.explode(F.array(*grades)).alias("severity"))
    return three.join(counted, "severity", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bands(
    df: DataFrame,
    tolerance: float = 0.8,
    *,
    with_flag: bool = False,
    real: str = "volume_next",
    pred: str = "volume_hat",
) -> DataFrame:
    """Add ``upper``/``lower`` around the forecast and ``out_of_band``; optionally also flagged."""
    both = df.where(F.col(real).isNotNull() & F.col(pred).isNotNull())
    up, down = F.col(pred) * (1 + tolerance), F.col(pred) * (1 - tolerance)
    out = (F.col(real) > up) | (F.col(real) < down)
    if with_flag:
        out = out & (F.col("flag_final") == 1)
    return both.withColumns({"upper": up, "lower": down, "out_of_band": out.cast("int")})


def out_of_band_points(banded: DataFrame) -> DataFrame:
    wanted = [S.CLIENT, S.TS, "volume_next", "volume_hat", "upper", "lower", "flag_final", "proba"]
    return banded.where("out_of_band = 1").select(*[c for c in wanted if c in banded.columns])


def alarm_summary(flagged: DataFrame, keys: Sequence[str] = (S.SEGMENT,)) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.avg(F.col("flag_final").cast("double")).alias("alarm_rate"), F.avg("proba").alias("mean_proba")
    )
