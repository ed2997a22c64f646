"""Series, forecast, flag and evaluation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meterlens import schema as S
from meterlens.catalog.registry import query
from meterlens.catalog.reports import PREDICTED_CTE, _round, predicted
from meterlens.catalog.views import FIRST_L, cte, readings
from meterlens.config import AnomalyParams, ForecastParams, SsaParams
from meterlens.operators import clean, evaluate, flags, forecast, forest, quantiles, series
from meterlens.operators.blocks import series_blocks
from meterlens.operators.ordering import running_totals
from meterlens.operators.ssa import smooth

E, L = "readings_e", "readings_l"
P = ForecastParams()
KEYS = (S.SEGMENT, S.CLIENT)


def _blocks(spark, sf, view=E):
    df = readings(spark, sf, view)
    if view == L:
        df = clean.keep_first(df)
    return series_blocks(df, series.HISTORY_REACH, series.FUTURE_REACH, keys=KEYS)


_W = "(PARTITION BY segment, client_id ORDER BY ts, src_ord)"
_LAGS = ", ".join(
    [f"lag(volume, {k}) OVER {_W} AS vf_lag{k}" for k in range(P.lags_v)]
    + [f"lag({c}, {k}) OVER {_W} AS {c[0]}_lag{k}" for k in range(P.lags_exo) for c in ("pressure", "temperature")]
)
SUPERVISED = f"""SELECT * FROM (SELECT *, row_number() OVER {_W} - 1 AS pos,
        count(*) OVER (PARTITION BY segment, client_id) AS n_rows, lead(volume) OVER {_W} AS volume_next, {_LAGS}
    FROM {{view}}) WHERE pos >= 24 AND pos <= n_rows - 2"""
_LAG_NAMES = series.lag_names(P)


@query("smooth_full_rank", f"WITH {cte(E)} SELECT client_id, ts, round(volume, 5) AS v_filt FROM {E}")
def _(spark, sf):
    """With as many components as the window is long, smoothing gives the series back."""
    made = smooth(_blocks(spark, sf), SsaParams(rank=SsaParams().window)).core()
    return made.select("client_id", "ts", F.round("v_filt", 5).alias("v_filt"))


@query(
    "lag_table",
    f"WITH {cte(E)} SELECT client_id, ts, volume_next, {', '.join(_LAG_NAMES)} FROM ({SUPERVISED.format(view=E)})",
)
def _(spark, sf):
    df = series.lag_columns(series.lag_arrays(_blocks(spark, sf), "volume", P).core(), P)
    return df.select("client_id", "ts", "volume_next", *_LAG_NAMES)


# Every client's readings as runs of 25, 26 or 27: too short for a lagged row, just long enough, and one more.
_RUN = "concat(client_id, '_', CAST(floor((nth - 1) / (25 + CAST(client_id AS INT) % 3)) AS INT))"
_NTH = "row_number() OVER (PARTITION BY client_id ORDER BY ts, src_ord) AS nth"


@query(
    "lag_table_short_clients",
    f"""WITH {cte(E)}, short AS (SELECT * REPLACE ({_RUN} AS client_id) FROM (SELECT *, {_NTH} FROM {E}))
        SELECT client_id, ts, src_ord, volume_next, vf_lag23, t_lag11 FROM ({SUPERVISED.format(view="short")})""",
)
def _(spark, sf):
    short = readings(spark, sf, E).selectExpr("*", _NTH).withColumn("client_id", F.expr(_RUN)).drop("nth")
    blocks = series_blocks(short, series.HISTORY_REACH, series.FUTURE_REACH, keys=KEYS)
    df = series.lag_columns(series.lag_arrays(blocks, "volume", P).core(), P)
    return df.select("client_id", "ts", "src_ord", "volume_next", "vf_lag23", "t_lag11")


_DESIGN = forecast.Design.of(P)
_SHOWN = [(a, b) for a, b in _DESIGN.pairs if a in ("vf_lag0", "vf_lag5", "p_lag0") or a == b]


@query(
    "polynomial_features",
    f"""WITH {cte(E)}, t AS ({SUPERVISED.format(view=E)}) SELECT client_id, ts,
        {', '.join(f'round({a} * {b}, 4) AS {a}_x_{b}' for a, b in _SHOWN)} FROM t""",
)
def _(spark, sf):
    df = series.lag_arrays(_blocks(spark, sf), "volume", P).core()
    made = df.select("client_id", "ts", forecast.design_array(P).alias("x"))
    at = lambda a, b: F.get("x", F.lit(_DESIGN.names.index(f"{a}*{b}")))
    return made.select("client_id", "ts", *[F.round(at(a, b), 4).alias(f"{a}_x_{b}") for a, b in _SHOWN])


def _scaler_sql(center: str, scale: str, digits: int) -> str:
    """One row per segment and column of the design matrix, all of them."""
    columns = _DESIGN.names
    spread = [f"CASE WHEN {scale.format(c=c)} = 0 THEN 1 ELSE {scale.format(c=c)} END" for c in columns]
    lists = {
        "feature": [f"'{i} {c}'" for i, c in enumerate(columns)],
        "center": [f"round({center.format(c=c)}, {digits})" for c in columns],
        "scale": [f"round({s}, {digits})" for s in spread],
    }
    shown = ", ".join(f"unnest([{', '.join(values)}]) AS {name}" for name, values in lists.items())
    return f"WITH {cte(E)}, t AS ({SUPERVISED.format(view=E)}) SELECT segment, {shown} FROM t GROUP BY segment"


@query("robust_scaler", _scaler_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", 7))
def _(spark, sf):
    return _scaler_columns(spark, sf, P, 7)


@query("standard_scaler", _scaler_sql("avg({c})", "stddev_pop({c})", 3))
def _(spark, sf):
    return _scaler_columns(spark, sf, ForecastParams(scaler="standard"), 3)


def _scaler_columns(spark, sf, p, digits):
    rows = series.lag_arrays(_blocks(spark, sf), "volume", p).core()
    fitted = forecast.fit_scaler(rows, p)
    names = F.array(*[F.lit(f"{i} {c}") for i, c in enumerate(_DESIGN.names)])
    each = fitted.select(S.SEGMENT, F.explode(F.arrays_zip(names.alias("feature"), "center", "scale")).alias("x"))
    return each.select(
        S.SEGMENT, "x.feature", F.round("x.center", digits).alias("center"), F.round("x.scale", digits).alias("scale")
    )


#: A given model per segment: coefficients, centres and scales over all columns of the design matrix.
_GIVEN = {
    seg: {
        "coef": [factor * math.sin(i + 1) / 20 for i in range(len(_DESIGN.names))],
        "center": [float(i % 5) for i in range(len(_DESIGN.names))],
        "scale": [1.0 + i % 3 for i in range(len(_DESIGN.names))],
        "intercept": 12.5 * factor,
    }
    for seg, factor in (("Comercial", 1.0), ("Industrial", -2.0))
}


def _given_sql(model: dict) -> str:
    terms = zip(model["coef"], _DESIGN.names, model["center"], model["scale"])
    return " + ".join([str(model["intercept"]), *[f"({w}) * (({c}) - {m}) / {s}" for w, c, m, s in terms]])


@query(
    "forecast_values",
    f"""WITH {cte(E)}, t AS ({SUPERVISED.format(view=E)}) SELECT client_id, ts, src_ord, round(CASE segment
        {' '.join(f"WHEN '{seg}' THEN {_given_sql(m)}" for seg, m in _GIVEN.items())} END, 4) AS volume_hat FROM t""",
)
def _(spark, sf):
    """The forecast of a given model, on every row with all lags."""
    rows = series.lag_arrays(_blocks(spark, sf), "volume", P).core()
    given = [(seg, m["coef"], m["center"], m["scale"], m["intercept"]) for seg, m in _GIVEN.items()]
    layout = "segment string, coef array<double>, center array<double>, scale array<double>, intercept double"
    hat = forecast.predictor(spark.createDataFrame(given, layout), P)
    return rows.select("client_id", "ts", "src_ord", F.round(hat, 4).alias("volume_hat"))


_ONE = ForecastParams(lags_v=1, lags_exo=0, poly_degree=1, scaler="standard")


@query(
    "elastic_net_one_feature",
    f"""WITH {cte(E)}, m AS (SELECT segment, count(*) AS n_train, avg(y) AS mean_y,
            covar_pop(temperature, y) / stddev_pop(temperature) AS c
            FROM (SELECT segment, temperature, volume + 3 * temperature + 1e8 AS y FROM {E}) GROUP BY segment)
        SELECT segment, n_train, round(sign(c) * greatest(abs(c) - {_ONE.alpha * _ONE.l1_ratio}, 0)
            / (1 + {_ONE.alpha * (1 - _ONE.l1_ratio)}), 5) AS coef, round(mean_y, 4) AS intercept FROM m""",
)
def _(spark, sf):
    """One standardised feature has a closed form; the target's level is far above its spread."""
    target = F.col("volume") + 3 * F.col("temperature") + 1e8
    rows = readings(spark, sf, E).select("segment", F.array("temperature").alias("base"), target.alias("volume_next"))
    model = forecast.fit_elastic_net(forecast.moment_rows(rows, forecast.fit_scaler(rows, _ONE), _ONE), _ONE)
    only = F.round(F.get("coef", F.lit(0)), 5).alias("coef")
    return model.select("segment", "n_train", only, F.round("intercept", 4).alias("intercept"))


_RW = "(PARTITION BY client_id ORDER BY ts, src_ord ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
_RESID = f"""r AS (SELECT client_id, ts, src_ord, volume - 100 AS resid FROM {E}),
    s AS (SELECT *, CASE WHEN count(*) OVER {_RW} >= 5 THEN avg(resid) OVER {_RW} ELSE 0 END AS r_mean,
        CASE WHEN count(*) OVER {_RW} >= 5 AND stddev_pop(resid) OVER {_RW} > 0 THEN stddev_pop(resid) OVER {_RW} ELSE 1e-6 END AS r_std FROM r),
    z AS (SELECT *, (resid - r_mean) / r_std AS z FROM s),
    f AS (SELECT *, abs(z) AS z_abs, abs(z - coalesce(lag(z) OVER w, z)) AS dz_abs,
        abs(resid - coalesce(lag(resid) OVER w, resid)) AS dr_abs FROM z WINDOW w AS (PARTITION BY client_id ORDER BY ts, src_ord))"""


@query(
    "residual_features",
    f"""WITH {cte(E)}, {_RESID} SELECT client_id, ts, round(resid, 6) AS resid, round(r_mean, 6) AS r_mean,
        round(r_std, 6) AS r_std, round(CASE WHEN z_abs > 1e5 THEN round(z_abs / 1e5) ELSE z_abs END, 6) AS z_abs,
        round(CASE WHEN dz_abs > 1e5 THEN round(dz_abs / 1e5) ELSE dz_abs END, 6) AS dz_abs, round(dr_abs, 6) AS dr_abs FROM f""",
)
def _(spark, sf):
    df = readings(spark, sf, E).withColumn("resid", F.col("volume") - 100)
    made = series.residual_features(series_blocks(df, 16, 0), first_pos=0).core()
    big = lambda c: F.when(F.col(c) > 1e5, F.round(F.col(c) / 1e5)).otherwise(F.col(c)).alias(c)
    made = made.withColumns({"z_abs": big("z_abs"), "dz_abs": big("dz_abs")})
    return _round(made.select("client_id", "ts", "resid", "r_mean", "r_std", "z_abs", "dz_abs", "dr_abs"), 6)


#: Two small trees over the residual features, as node rows of a stored forest.
_TREES = [
    (0, 0, 0, 1.0, 1, 2, 0.0), (0, 1, 5, 40.0, 3, 4, 0.0), (0, 2, 1, 0.0, 5, 6, 0.0), (0, 3, -1, 0.0, -1, -1, 7.5),
    (0, 4, -1, 0.0, -1, -1, 5.25), (0, 5, -1, 0.0, -1, -1, 3.0), (0, 6, 2, 25.0, 7, 8, 0.0), (0, 7, -1, 0.0, -1, -1, 4.5),
    (0, 8, -1, 0.0, -1, -1, 3.75), (1, 0, 4, 1.5, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 6.0), (1, 2, 3, 90.0, 3, 4, 0.0),
    (1, 3, -1, 0.0, -1, -1, 4.0), (1, 4, -1, 0.0, -1, -1, 2.0),
]
_UNIT = float(forest.average_path(256))


def _walk(tree: int, node: int = 0) -> str:
    """The path length of a row in one of the trees, as SQL."""
    _, _, feature, threshold, left, right, depth = next(t for t in _TREES if t[:2] == (tree, node))
    if feature < 0:
        return f"CAST({depth} AS DOUBLE)"
    return f"CASE WHEN {forest.FEATURES[feature]} <= {threshold} THEN {_walk(tree, left)} ELSE {_walk(tree, right)} END"


@query(
    "forest_scores",
    f"""WITH {cte(E)}, {_RESID} SELECT client_id, ts, round(power(2, -(({_walk(0)}) + ({_walk(1)})) / 2 / {_UNIT!r}), 6) AS score
        FROM f""",
)
def _(spark, sf):
    """A given forest over the residual features, with nodes and rows brought together by a shuffle."""
    df = readings(spark, sf, E).withColumn("resid", F.col("volume") - 100)
    made = series.residual_features(series_blocks(df, 16, 0), first_pos=0).core()
    segments = made.select("segment").distinct()
    layout = "tree int, node int, feature int, threshold double, left int, right int, depth double"
    nodes = segments.join(F.broadcast(spark.createDataFrame(_TREES, layout)))
    samples = segments.withColumn("forest_samples", F.lit(256))
    scored = forest.with_scores(made, nodes, samples, broadcast_nodes=0, slice_rows=2_000)
    return scored.select("client_id", "ts", F.round("score", 6).alias("score"))


@query(
    "next_label",
    f"""WITH {cte(E)} SELECT client_id, ts, coalesce(lead(label) OVER (PARTITION BY client_id ORDER BY ts, src_ord), 0) AS label_next
        FROM {E}""",
)
def _(spark, sf):
    b = series_blocks(readings(spark, sf, E), 0, 1)
    return series.next_label(b, "label").core().select("client_id", "ts", "label_next")


@query(
    "training_positions",
    f"""WITH {cte(E)}, t AS ({SUPERVISED.format(view=E)}),
        o AS (SELECT segment, client_id, ts, row_number() OVER (PARTITION BY segment ORDER BY client_id, ts, src_ord) - 1 AS train_pos,
            count(*) OVER (PARTITION BY segment) AS n FROM t)
        SELECT client_id, ts, train_pos, train_pos < greatest(1, CAST(floor(n * (1 - 0.4)) AS BIGINT)) AS is_train,
            train_pos < greatest(1, CAST(floor(n * (1 - 0.4)) AS BIGINT))
                AND train_pos >= greatest(1, CAST(floor(n * (1 - 0.4)) AS BIGINT)) - 500 AS in_cap FROM o""",
)
def _(spark, sf):
    from meterlens.plans.train import number_rows

    p = ForecastParams(max_train_samples=500)
    blocks = _blocks(spark, sf)
    rows = number_rows(series.lag_arrays(blocks, "volume", p), p).core()
    return rows.select("client_id", "ts", "train_pos", "is_train", "in_cap")


@query(
    "hourly_grid",
    f"""WITH {cte(E)}, h AS (SELECT client_id, date_trunc('hour', ts)::TIMESTAMP AS ts, volume, src_ord FROM {E}),
        k AS (SELECT client_id, ts, arg_max(volume, src_ord) AS volume FROM h GROUP BY ALL),
        g AS (SELECT client_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM k GROUP BY client_id)
        SELECT client_id, ts, volume, volume IS NULL AS is_filled FROM g LEFT JOIN k USING (client_id, ts)""",
)
def _(spark, sf):
    return series.hourly_grid(readings(spark, sf, E), truncate=True).select("client_id", "ts", "volume", "is_filled")


@query(
    "interpolate_hourly",  # the small shift keeps the values off the rounding ties
    f"""WITH {cte(E)}, h AS (SELECT client_id, date_trunc('hour', ts)::TIMESTAMP AS ts, volume, src_ord FROM {E}),
        k AS (SELECT client_id, ts, arg_max(volume, src_ord) AS volume FROM h GROUP BY ALL),
        g AS (SELECT client_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM k GROUP BY client_id),
        j AS (SELECT client_id, ts, volume, row_number() OVER (PARTITION BY client_id ORDER BY ts) AS i FROM g LEFT JOIN k USING (client_id, ts)),
        m AS (SELECT *, max(CASE WHEN volume IS NOT NULL THEN i END) OVER (PARTITION BY client_id ORDER BY ts) AS a,
            min(CASE WHEN volume IS NOT NULL THEN i END) OVER (PARTITION BY client_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM j)
        SELECT m.client_id, m.ts, round(0.0000123 + CASE WHEN m.volume IS NOT NULL THEN m.volume
            ELSE x.volume + (y.volume - x.volume) * (m.i - m.a) / (m.b - m.a) END, 4) AS volume
        FROM m LEFT JOIN j x ON x.client_id = m.client_id AND x.i = m.a LEFT JOIN j y ON y.client_id = m.client_id AND y.i = m.b""",
)
def _(spark, sf):
    grid = series.hourly_grid(readings(spark, sf, E), truncate=True)
    filled = series.interpolate(series_blocks(grid, 0, 0, order=("ts",))).core()
    return filled.select("client_id", "ts", F.round(F.col("volume") + 0.0000123, 4).alias("volume"))


# --- scores to flags ---------------------------------------------------------------------------

_A = AnomalyParams(z_threshold=2.9)
_FLAGS = f"""{PREDICTED_CTE},
    rg AS (SELECT segment, min(score) AS lo, max(score) AS hi FROM {E} GROUP BY segment),
    pr AS (SELECT e.*, (score - lo) / CASE WHEN hi - lo > 1e-9 THEN hi - lo ELSE 1 END AS proba FROM {E} e JOIN rg USING (segment)),
    th AS (SELECT segment, quantile_cont(proba, 0.97) AS thr_if FROM pr GROUP BY segment),
    fl AS (SELECT pr.*, thr_if, CAST(proba >= thr_if AS INTEGER) AS flag_if, CAST(z_abs >= 2.9 AS INTEGER) AS flag_z FROM pr JOIN th USING (segment))"""


def _flagged(spark, sf, p=_A):
    df = predicted(spark, sf)
    return flags.flag(df, flags.score_thresholds(df, flags.score_range(df), p), p)


@query(
    "score_range",
    f"WITH {PREDICTED_CTE} SELECT segment, min(score) AS score_min, max(score) AS score_max FROM {E} GROUP BY segment",
)
def _(spark, sf):
    return flags.score_range(predicted(spark, sf))


@query("score_threshold", f"WITH {_FLAGS} SELECT segment, round(thr_if, 6) AS thr_if FROM th")
def _(spark, sf):
    df = predicted(spark, sf)
    return _round(flags.score_thresholds(df, flags.score_range(df), _A).select("segment", "thr_if"), 6)


@query(
    "flag_readings_or",
    f"""WITH {_FLAGS} SELECT client_id, ts, round(proba, 6) AS proba, flag_if, flag_z,
        CAST(flag_if + flag_z > 0 AS INTEGER) AS flag_final FROM fl""",
)
def _(spark, sf):
    return _round(_flagged(spark, sf).select("client_id", "ts", "proba", "flag_if", "flag_z", "flag_final"), 6)


@query(
    "flag_readings_and",
    f"WITH {_FLAGS} SELECT client_id, ts, flag_if * flag_z AS flag_final FROM fl",
)
def _(spark, sf):
    df = _flagged(spark, sf, AnomalyParams(z_threshold=2.9, fusion="and"))
    return df.select("client_id", "ts", "flag_final")


@query(
    "alarm_summary",
    f"""WITH {_FLAGS} SELECT segment, round(avg(CASE WHEN flag_if + flag_z > 0 THEN 1.0 ELSE 0 END), 6) AS alarm_rate,
        round(avg(proba), 6) AS mean_proba FROM fl GROUP BY segment""",
)
def _(spark, sf):
    return _round(flags.alarm_summary(_flagged(spark, sf)), 6)


@query(
    "join_flags_readings",
    f"""WITH {_FLAGS}, lg AS (SELECT client_id, ts, volume, pressure FROM {E} WHERE src_ord % 3 <> 0)
        SELECT fl.client_id, fl.ts, round(proba, 6) AS proba, lg.volume, lg.pressure FROM fl LEFT JOIN lg USING (client_id, ts)""",
)
def _(spark, sf):
    scored = _flagged(spark, sf).select("client_id", "ts", F.round("proba", 6).alias("proba"))
    known = readings(spark, sf, E).where("src_ord % 3 <> 0").select("client_id", "ts", "volume", "pressure")
    return scored.join(known, ["client_id", "ts"], "left")


@query(
    "join_next_labels",
    f"""WITH {cte(E)}, lb AS (SELECT client_id, ts, lead(label) OVER (PARTITION BY client_id ORDER BY ts, src_ord) AS label_next FROM {E})
        SELECT s.client_id, s.ts, coalesce(lb.label_next, 0) AS label_next FROM {E} s LEFT JOIN lb USING (client_id, ts) WHERE s.src_ord % 2 = 0""",
)
def _(spark, sf):
    df = readings(spark, sf, E)
    labels = series.next_label(series_blocks(df, 0, 1), "label").core()
    scored = df.where("src_ord % 2 = 0").select("client_id", "ts")
    return evaluate.join_labels(scored, labels).select("client_id", "ts", "label_next")


@query(
    "forecast_errors",
    f"""WITH {PREDICTED_CTE}, e AS (SELECT *, volume_next - volume_hat AS e FROM {E})
        SELECT segment, count(*) AS n, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(abs(e)), 5) AS mae,
            round(avg(abs(e) / greatest(abs(volume_next), 1e-8)) * 100, 4) AS mape,
            round(avg(200 * abs(e) / (abs(volume_next) + abs(volume_hat) + 1e-8)), 4) AS smape,
            round(1 - sum(e * e) / (var_pop(volume_next) * count(*)), 6) AS r2 FROM e GROUP BY segment""",
)
def _(spark, sf):
    df = forecast.forecast_errors(predicted(spark, sf))
    digits = {"rmse": 5, "mae": 5, "mape": 4, "smape": 4, "r2": 6}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


_TRUTH = f"{_FLAGS}, tr AS (SELECT segment, proba, CAST(flag_if + flag_z > 0 AS INTEGER) AS f, label AS t FROM fl)"


@query(
    "confusion_metrics",
    f"""WITH {_TRUTH}, c AS (SELECT coalesce(segment, '__all__') AS segment, count(*) FILTER (t = 1 AND f = 1) AS tp,
            count(*) FILTER (t = 1) AS pt, count(*) FILTER (f = 1) AS pp, count(*) FILTER (t = f) AS hits, count(*) AS n
            FROM tr GROUP BY GROUPING SETS ((segment), ()))
        SELECT segment, round(CASE WHEN pp > 0 THEN tp / pp ELSE 0 END, 6) AS precision,
            round(CASE WHEN pt > 0 THEN tp / pt ELSE 0 END, 6) AS recall,
            round(CASE WHEN pt + pp > 0 THEN 2 * tp / (pt + pp) ELSE 0 END, 6) AS f1, round(hits / n, 6) AS accuracy,
            pt AS positives_true, pp AS positives_pred, n AS n_eval, round(pp / n, 6) AS alarm_rate FROM c""",
)
def _(spark, sf):
    return _round(evaluate.confusion_metrics(_flagged(spark, sf), truth="label"), 6)


_AUC = """SELECT segment, round(sum(CASE WHEN t = 1 THEN rk END) / (count(*) FILTER (t = 1) * count(*) FILTER (t = 0))
    - (count(*) FILTER (t = 1) + 1) / (2.0 * count(*) FILTER (t = 0)), 6) AS roc_auc FROM (
        SELECT segment, t, (rank() OVER (PARTITION BY segment ORDER BY proba)
            + rank() OVER (PARTITION BY segment ORDER BY proba) + count(*) OVER (PARTITION BY segment, proba) - 1) / 2.0 AS rk
        FROM both_levels) GROUP BY segment"""


@query(
    "roc_auc",
    f"""WITH {_TRUTH}, both_levels AS (SELECT segment, proba, t FROM tr UNION ALL SELECT '__all__', proba, t FROM tr) {_AUC}""",
)
def _(spark, sf):
    return _round(evaluate.roc_auc(_flagged(spark, sf), truth="label"), 6)


@query(
    "roc_points",
    f"""WITH {cte(L)}, d AS (SELECT segment, volume AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
            FROM {L} GROUP BY ALL),
        c AS (SELECT segment, threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY segment) AS tot_p,
            sum(n) OVER (PARTITION BY segment) AS tot_n FROM d WINDOW w AS (PARTITION BY segment ORDER BY threshold DESC))
        SELECT segment, round(fp / tot_n, 6) AS fpr, round(tp / tot_p, 6) AS tpr, threshold FROM c
        UNION ALL SELECT DISTINCT segment, 0, 0, 'inf'::DOUBLE FROM {L}""",
)
def _(spark, sf):
    df = readings(spark, sf, L).withColumnRenamed("volume", "proba")
    return _round(evaluate.roc_points(df, truth="label"), 6)


@query(
    "score_quantiles",
    f"""WITH {cte(L)} SELECT client_id, round(quantile_cont(volume, 0.5), 5) AS median, round(quantile_cont(volume, 0.9), 5) AS p90,
        round(quantile_cont(volume, 0.97), 5) AS p97 FROM {L} GROUP BY client_id""",
)
def _(spark, sf):
    q = quantiles.exact_quantiles(readings(spark, sf, L), ["client_id"], ["volume"], [0.5, 0.9, 0.97])
    at = lambda i: F.round(F.get("volume", F.lit(i)), 5)
    return q.select("client_id", at(0).alias("median"), at(1).alias("p90"), at(2).alias("p97"))


@query(
    "running_volume",
    f"""WITH {FIRST_L} SELECT client_id, ts, round(sum(volume) OVER (PARTITION BY client_id ORDER BY ts), 4) AS running,
        row_number() OVER (PARTITION BY client_id ORDER BY ts) AS nth FROM first_l""",
)
def _(spark, sf):
    df = clean.keep_first(readings(spark, sf, L))
    run = running_totals(df, ["client_id"], ["ts"], {"running": F.col("volume"), "nth": F.lit(1)})
    return run.select("client_id", "ts", F.round("running", 4).alias("running"), "nth")
