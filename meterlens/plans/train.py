"""Training job: readings in, models, metrics and flags out, all segments at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from meterlens import schema as S
from meterlens.config import ForecastParams, JobParams
from meterlens.operators import clean, flags, forest, series
from meterlens.operators import forecast as fc
from meterlens.operators.blocks import Blocks, series_blocks
from meterlens.operators.ordering import running_totals
from meterlens.operators.ssa import smooth_lagged
from meterlens.session import cut

KEYS = (S.SEGMENT, S.CLIENT)
OUTPUT = [
    S.CLIENT, S.TS, S.SEGMENT, "proba", "flag_if", "flag_z", "flag_final", *S.RESIDUAL_FEATURES,
    S.VOLUME, S.PRESSURE, S.TEMPERATURE, "v_filt", "volume_next", "volume_hat",
]


@dataclass(frozen=True)
class Models:
    """Everything scoring needs; each table is small and keyed by segment."""

    forecast: DataFrame  # segment, coef, intercept, n_train, center, scale
    forest: DataFrame  # segment, tree, node, feature, threshold, left, right, depth
    thresholds: DataFrame  # segment, score_min, score_max, thr_if, forest_samples


@dataclass(frozen=True)
class TrainResult:
    models: Models
    flags: DataFrame
    metrics: DataFrame  # segment, forecast errors on the hold-out, alarm rate, mean score


def prepare(readings: DataFrame) -> DataFrame:
    """Typed, complete readings, one per (client, timestamp)."""
    return clean.keep_first(clean.drop_missing(readings, [*S.REQUIRED, S.SEGMENT]))


def lagged_series(readings: DataFrame, p: JobParams, *, max_rows: int | None = None) -> Blocks:
    """Blocks of smoothed and lagged rows, ready for the forecast."""
    return smooth_lagged(series_blocks(readings, *series.reach(p), keys=KEYS, max_rows=max_rows), p)


def number_rows(lagged: Blocks, p: ForecastParams) -> Blocks:
    """Add the row's position among its segment's rows in (client, time) order, the split and ``draw_pos``, the
    position among the segment's training rows.

    The order over clients comes from running totals over one row per client, so no task sees a whole segment.
    """
    first = p.maxlag
    # Every series with a usable row has one at the first position that has all lags.
    here = F.col("pos") == first
    if lagged.size:
        here &= F.col("is_core")
    lengths = lagged.df.where(here).select(S.SEGMENT, S.CLIENT, "n_rows")
    usable = F.col("n_rows") - first - 1
    own_cut = F.floor(usable * (1.0 - p.test_size))
    run = running_totals(lengths, [S.SEGMENT], [S.CLIENT], {"_upto": usable, "_upto_cut": own_cut})
    totals = lengths.groupBy(S.SEGMENT).agg(F.sum(usable).alias("_n"))
    # One row per client, read by every pass over the lag rows.
    offsets = cut(
        run.join(totals, S.SEGMENT).select(
            S.SEGMENT, S.CLIENT, "n_rows", (F.col("_upto") - usable).alias("_before"),
            (F.col("_upto_cut") - own_cut).alias("_before_cut"), "_n",
        )
    )
    cut_at = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") * (1.0 - p.test_size)))
    nth = F.col("pos") - first
    numbered = lagged.attach(offsets).df.withColumns({"train_pos": F.col("_before") + nth, "_cut": cut_at})
    if p.split == "time":
        # Every client's training rows are its first ones, so those before it number them without gaps.
        is_train, draw_pos = nth < own_cut, F.when(nth < own_cut, F.col("_before_cut") + nth)
    else:
        is_train, draw_pos = F.col("train_pos") < F.col("_cut"), F.col("train_pos")
    in_cap = is_train
    if p.max_train_samples and p.split == "position":
        in_cap = is_train & (F.col("train_pos") >= F.col("_cut") - p.max_train_samples)
    return lagged.on(
        numbered.withColumns({"is_train": is_train, "in_cap": in_cap, "n_train": F.col("_cut"), "draw_pos": draw_pos})
        .where(F.col("_n") >= p.min_samples)
        .drop("_before", "_before_cut", "_n", "_cut")
    )


def train(readings: DataFrame, p: JobParams = JobParams(), *, max_rows: int | None = None) -> TrainResult:
    f, a = p.forecast, p.anomaly
    lagged = lagged_series(cut(prepare(readings)), p, max_rows=max_rows)
    # Written once with its lags and read by the scaler, the fit and the forecast without another shuffle.
    rows = number_rows(lagged.on(cut(lagged.df)), f)
    core = rows.core()

    train_rows = core.where("is_train")
    scaler = cut(fc.fit_scaler(train_rows, f))
    model = fc.fit_elastic_net(fc.moment_rows(core.where("in_cap"), scaler, f), f)
    model = cut(model.join(scaler, S.SEGMENT))

    keep = [
        *rows.group, "pos", "n_rows", "is_core", S.CLIENT, S.SEGMENT, S.TS, S.ORD, *S.MEASURES, "v_filt",
        "volume_next", "draw_pos", "is_train", "n_train",
    ]
    keep = list(dict.fromkeys(keep))
    predicted = rows.df.withColumn("volume_hat", fc.predictor(model, f)).select(*keep, "volume_hat")
    predicted = predicted.withColumn("resid", F.col("volume_next") - F.col("volume_hat"))
    features = series.residual_features(rows.on(predicted), roll_window=a.roll_window, first_pos=f.maxlag)
    features = cut(features.core())

    sizes = features.where("is_train").groupBy(S.SEGMENT).agg(F.count(F.lit(1)).alias("n_train"))
    sizes = cut(sizes)
    samples = forest.draw_samples(features.where("is_train"), sizes, a, p.seed, "draw_pos")
    nodes = cut(forest.fit_forest(samples, a, p.seed, "draw_pos"))
    used = sizes.select(S.SEGMENT, F.least("n_train", F.lit(a.max_samples)).cast("int").alias("forest_samples"))
    scored = cut(forest.with_scores(features, nodes, used))
    thresholds = flags.score_thresholds(scored, flags.score_range(scored), a)
    thresholds = cut(
        thresholds.join(sizes, S.SEGMENT).withColumn(
            "forest_samples", F.least(F.col("n_train"), F.lit(a.max_samples)).cast("int")
        ).drop("n_train")
    )
    flagged = flags.flag(scored, thresholds.drop("forest_samples"), a)
    metrics = fc.forecast_errors(flagged.where(~F.col("is_train"))).join(
        flags.alarm_summary(flagged), S.SEGMENT, "right"
    )
    return TrainResult(Models(model, nodes, thresholds), flagged.select(*OUTPUT), metrics)
