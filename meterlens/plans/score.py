"""Scoring and evaluation jobs with stored models."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from meterlens import schema as S
from meterlens.config import JobParams
from meterlens.operators import clean, evaluate, flags, forest, report, series
from meterlens.operators import forecast as fc
from meterlens.operators.blocks import series_blocks
from meterlens.operators.columns import find_label_column
from meterlens.operators.segment import attach_segments
from meterlens.plans.train import OUTPUT, Models, lagged_series, prepare
from meterlens.session import cut


def residuals(readings: DataFrame, models: Models, p: JobParams, *, max_rows: int | None = None) -> DataFrame:
    """Forecasts, residuals and residual features of clean readings. Segments without a model drop out."""
    known = models.forecast.select(S.SEGMENT)
    mine = readings.join(known, S.SEGMENT, "left_semi")
    rows = lagged_series(mine, p, max_rows=max_rows)
    predicted = rows.df.withColumn("volume_hat", fc.predictor(models.forecast, p.forecast)).drop("base")
    predicted = predicted.withColumn("resid", F.col("volume_next") - F.col("volume_hat"))
    made = series.residual_features(
        rows.on(predicted), roll_window=p.anomaly.roll_window, first_pos=p.forecast.maxlag
    )
    return made.core()


def score(
    readings: DataFrame,
    models: Models,
    p: JobParams = JobParams(),
    *,
    thresholds: str = "batch",
    max_rows: int | None = None,
) -> DataFrame:
    """Flags of every scored reading.

    ``thresholds="batch"`` takes score range and cut-off from this batch, per segment;
    ``"stored"`` takes those of the training run.
    """
    base = cut(prepare(readings))
    features = residuals(base, models, p, max_rows=max_rows)
    scored = cut(forest.with_scores(features, models.forest, models.thresholds))
    if thresholds == "stored":
        limits = models.thresholds.drop("forest_samples")
    else:
        limits = flags.score_thresholds(scored, flags.score_range(scored), p.anomaly)
    flagged = flags.flag(scored, limits, p.anomaly)
    return flagged.select(*OUTPUT, "thr_if").withColumn("severity", flags.severity(p=p.severity))


def score_client(
    readings: DataFrame,
    client: str,
    models: Models,
    p: JobParams = JobParams(),
    *,
    first: date | None = None,
    last: date | None = None,
    filter_after: bool = False,
) -> DataFrame:
    """One client's flags over a date range, on the hourly grid its first reading starts.

    Missing measures of hours with a reading are filled along the grid; hours without one are not scored. The range is applied before scoring, so lags start
    inside it, unless ``filter_after``.
    """
    mine = report.one_client(readings, client).where(F.col(S.TS).isNotNull())
    modal = report.modal_segment(mine)
    hours = series_blocks(series.hourly_grid(mine), 0, 0, keys=(S.CLIENT,), order=(S.TS,))
    grid = series.interpolate(hours).core().where(~F.col("is_filled")).drop("is_filled", "pos", "n_rows")
    ranged = first is not None and last is not None
    if ranged and not filter_after:
        grid = report.date_range(grid, first, last)
    out = score(attach_segments(grid, modal), models, p)
    return report.date_range(out, first, last) if ranged and filter_after else out


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame
    metrics: DataFrame  # one record per segment and the overall one
    curve: DataFrame  # ROC points per segment and overall


def evaluate_labelled(
    readings: DataFrame,
    models: Models,
    p: JobParams = JobParams(),
    label: str | None = None,
    *,
    max_rows: int | None = None,
) -> Evaluation:
    """Score labelled readings and compare each flag with the label of the next reading."""
    label = label or find_label_column(readings)
    base = cut(clean.keep_first(clean.drop_missing(readings, [*S.REQUIRED, S.SEGMENT])))
    slim = base.select(S.SEGMENT, S.CLIENT, S.TS, S.ORD, F.col(label).alias("label"))
    labels = series.next_label(series_blocks(slim, 0, 1, keys=(S.SEGMENT, S.CLIENT), max_rows=max_rows), "label")
    flagged = score(base, models, p, max_rows=max_rows)
    joined = evaluate.join_labels(
        flagged, labels.core().select(S.SEGMENT, S.CLIENT, S.TS, "label_next"), (S.SEGMENT, S.CLIENT, S.TS)
    )
    joined = cut(joined)
    limits = joined.groupBy(S.SEGMENT).agg(F.first("thr_if").alias("thr_if"))
    metrics = evaluate.metrics_record(
        evaluate.confusion_metrics(joined),
        evaluate.roc_auc(joined),
        limits,
        p.anomaly.contamination,
        p.anomaly.fusion,
        p.anomaly.z_threshold,
    )
    return Evaluation(joined.drop("thr_if"), metrics, evaluate.roc_points(joined, overall=True))
