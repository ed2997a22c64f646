"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterlens.catalog import QUERIES  # noqa: E402
from meterlens.catalog.views import readings  # noqa: E402
from meterlens.plans.train import train  # noqa: E402
from meterlens.session import local_session  # noqa: E402

HEADLINE = [
    "parse_mixed_timestamps", "keep_first_reading", "impute_pressure", "upsert_readings", "cleaned_top_clients",
    "daily_rollup", "history_kpis", "describe_measures", "lag_table", "residual_features", "interpolate_hourly",
    "flag_readings_or", "forecast_errors", "confusion_metrics", "roc_auc", "client_profiles", "density_clusters",
    "clean_readings", "correlation_matrix", "normality_table", "autocorrelation", "seasonal_decomposition",
    "series_statistics", "stream_daily_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spent: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        spent[name] = round(time.perf_counter() - start, 3)

    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    # The training job, whole: smoothing, fit, forest, flags and hold-out metrics of both segments.
    rows: dict[str, int] = {}
    for view in ("readings_e", "readings_l"):
        df = readings(spark, sf_dir, view)
        rows[view] = df.select("client_id", "ts").distinct().count()

        def run(df=df):
            result = train(df)
            drain(result.flags)
            drain(result.metrics)

        timed(f"train_{view}", run)
    for name in HEADLINE:
        timed(name, lambda: drain(QUERIES[name](spark, sf_dir)))
    rate = {view: round(n / spent[f"train_{view}"], 1) for view, n in rows.items()}
    line = {
        "metric": "total seconds of headline queries",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "train_rows": rows,
        "train_rows_per_sec": rate,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
