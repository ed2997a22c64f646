"""Whole jobs as queries."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from meterlens.catalog.cleaning import IMPUTED_E
from meterlens.catalog.registry import query
from meterlens.catalog.scoring import SUPERVISED
from meterlens.catalog.views import cte, readings
from meterlens.config import ForecastParams, JobParams
from meterlens.plans.clean import add_upload, clean_readings
from meterlens.plans.score import evaluate_labelled, score, score_client
from meterlens.plans.train import TrainResult, train
from meterlens.session import shared_dir
from meterlens.sources import writers
from meterlens.sources.writers import log_table

E, L = "readings_e", "readings_l"
_DAYS = 24 * 3_600_000_000


def trained(spark, sf, p: JobParams = JobParams()) -> TrainResult:
    """A training run on the event readings."""
    return train(readings(spark, sf, E), p)


def trained_models(spark, sf):
    return trained(spark, sf).models


@query("train_flags")
def _(spark, sf):
    return trained(spark, sf).flags


# What a training run gives whatever the forest draws: its rows, and per segment the samples, trees and alarm rate.
_ROWS = f"""WITH {cte(E)}, s AS ({SUPERVISED.format(view=E)}) SELECT client_id, ts, segment, round(volume, 5) AS volume,
    pressure, temperature, round(volume_next, 5) AS volume_next FROM s"""


@query("train_flag_rows", _ROWS)
def _(spark, sf):
    return trained(spark, sf).flags.select(
        "client_id", "ts", "segment", F.round("volume", 5).alias("volume"), "pressure", "temperature",
        F.round("volume_next", 5).alias("volume_next"),
    )


@query(
    "train_models_exact",
    f"""WITH {cte(E)}, s AS ({SUPERVISED.format(view=E)}), c AS (SELECT segment, count(*) AS n, CAST(floor(count(*) * (1 - 0.4)) AS BIGINT) AS n_train
        FROM s GROUP BY segment) SELECT segment, n AS n_rows, least(256, n_train) AS forest_samples, 300 AS n_trees,
        true AS rate_near, true AS same_after_storing FROM c""",
)
def _(spark, sf):
    """Counts and rates of a training run, and flags of its models after they were written and read back."""
    data, folder = readings(spark, sf, E), f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    made = trained(spark, sf)
    writers.save_models(made.models, folder)
    keys = ["client_id", "ts"]
    again = score(data, writers.load_models(spark, folder), JobParams(), thresholds="stored")
    both = made.flags.select(*keys, "segment", "proba").join(again.select(*keys, F.col("proba").alias("p2")), keys, "left")
    rates = made.flags.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.abs(F.avg("flag_final") - 0.03) < 0.01).alias("rate_near")
    )
    same = both.groupBy("segment").agg(
        F.bool_and(F.coalesce(F.abs(F.col("proba") - F.col("p2")) < 1e-6, F.lit(False))).alias("same_after_storing")
    )
    trees = made.models.forest.groupBy("segment").agg(F.countDistinct("tree").cast("int").alias("n_trees"))
    samples = made.models.thresholds.select("segment", F.col("forest_samples").cast("long").alias("forest_samples"))
    return rates.join(same, "segment").join(trees, "segment").join(samples, "segment")


@query("train_metrics")
def _(spark, sf):
    return log_table(trained(spark, sf).metrics, "run", "train")


@query("train_standard_scaler")
def _(spark, sf):
    """The other scaler, the cut inside every client, and no expansion."""
    p = JobParams(forecast=ForecastParams(scaler="standard", split="time", poly_degree=1))
    return train(readings(spark, sf, L), p).flags


@query("score_stored_models")
def _(spark, sf):
    """Models written to a folder and read back, then applied with their own thresholds."""
    folder = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    writers.save_models(trained_models(spark, sf), folder)
    return score(readings(spark, sf, E), writers.load_models(spark, folder), JobParams(), thresholds="stored")


@query("score_one_client")
def _(spark, sf):
    hourly = readings(spark, sf, E).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return score_client(
        hourly, "3", trained_models(spark, sf), JobParams(), first=date(2024, 1, 1), last=date(2024, 2, 1)
    )


@query("evaluate_models")
def _(spark, sf):
    return evaluate_labelled(readings(spark, sf, E), trained_models(spark, sf), JobParams()).metrics


@query(
    "evaluate_counts",
    f"""WITH {cte(E)}, n AS (SELECT *, lead(label) OVER (PARTITION BY segment, client_id ORDER BY ts, src_ord) AS label_next FROM {E}),
        s AS ({SUPERVISED.format(view='n')}) SELECT coalesce(segment, '__all__') AS segment, count(*) AS n_eval,
        count(*) FILTER (label_next = 1) AS positives_true FROM s GROUP BY GROUPING SETS ((segment), ())""",
)
def _(spark, sf):
    """What an evaluation counts whatever the scores are."""
    found = evaluate_labelled(readings(spark, sf, E), trained_models(spark, sf), JobParams()).metrics
    return found.select("segment", "n_eval", "positives_true")


@query("evaluate_roc_curve")
def _(spark, sf):
    return evaluate_labelled(readings(spark, sf, E), trained_models(spark, sf), JobParams()).curve


@query(
    "clean_reading_values",
    f"""WITH {IMPUTED_E} SELECT client_id, ts, round(CASE WHEN volume < 0 THEN 0 ELSE volume END, 5) AS volume, temperature,
        round(CASE WHEN imputed THEN m WHEN pressure < 0 THEN 0 ELSE pressure END, 6) AS pressure FROM fixed""",
)
def _(spark, sf):
    """The cleaning job from text to clean values; segments are compared by ``density_clusters`` and its kin."""
    raw = readings(spark, sf, E).drop("segment", "label")
    text = raw.withColumns({c: F.col(c).cast("string") for c in ("ts", "volume", "pressure", "temperature")})
    made = clean_readings(text).readings
    return made.select(
        "client_id", "ts", F.round("volume", 5).alias("volume"), "temperature", F.round("pressure", 6).alias("pressure")
    )


@query("clean_readings")
def _(spark, sf):
    raw = readings(spark, sf, L).drop("segment", "label")
    return clean_readings(raw, lookback=3 * _DAYS).readings


@query("add_upload")
def _(spark, sf):
    """A second batch merged into cleaned readings: known clients keep their segment."""
    raw = readings(spark, sf, L).drop("segment", "label")
    early = clean_readings(raw.where("ts < timestamp_ntz'2000-01-01 00:00:00'"), lookback=3 * _DAYS).readings
    return add_upload(early, raw.where("ts >= timestamp_ntz'1999-12-01 00:00:00'"))
