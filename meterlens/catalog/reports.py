"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens.catalog.registry import query
from meterlens.catalog.views import cte, readings
from meterlens.operators import clean, flags, report

E, L, O = "readings_e", "readings_l", "readings_o"


def _round(df, digits=4, skip=()):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes]
    )


@query(
    "source_counts",
    f"""WITH {cte(O)} SELECT client_id, count(*) AS n, (SELECT count(*) FROM {O}) AS total, true AS ok
        FROM {O} GROUP BY client_id""",
)
def _(spark, sf):
    return report.source_counts(readings(spark, sf, O))


@query(
    "top_clients_by_volume",
    f"""WITH {cte(L)} SELECT client_id, round(sum(volume), 4) AS total_volume FROM {L}
        GROUP BY client_id ORDER BY sum(volume) DESC, client_id LIMIT 10""",
)
def _(spark, sf):
    return _round(report.top_clients(readings(spark, sf, L)))


@query(
    "cleaned_top_clients",
    f"""WITH {cte(L)}, d AS (SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY client_id, ts ORDER BY src_ord) AS rn FROM {L}) WHERE rn = 1)
        SELECT client_id, round(sum(greatest(volume, 0)), 4) AS total_volume FROM d
        GROUP BY client_id ORDER BY sum(greatest(volume, 0)) DESC, client_id LIMIT 10""",
)
def _(spark, sf):
    df = clean.clamp_negatives(clean.impute_pressure(clean.keep_first(readings(spark, sf, L)), 72 * clean.HOUR))
    return _round(report.top_clients(df))


@query(
    "busiest_clients",
    f"WITH {cte(L)} SELECT client_id, count(*) AS n FROM {L} GROUP BY client_id ORDER BY n DESC, client_id LIMIT 5",
)
def _(spark, sf):
    return report.busiest_clients(readings(spark, sf, L))


@query(
    "latest_rows",
    f"""WITH {cte(E)} SELECT client_id, ts, volume, src_ord FROM {E}
        ORDER BY ts DESC, client_id DESC, src_ord DESC LIMIT 300""",
)
def _(spark, sf):
    return report.latest_rows(readings(spark, sf, E).select("client_id", "ts", "volume", "src_ord"))


_DAILY = """SELECT client_id, date_trunc('day', ts)::TIMESTAMP AS day, sum(volume) AS volume,
    avg(pressure) AS pressure, avg(temperature) AS temperature FROM {view} GROUP BY ALL"""


@query(
    "daily_rollup",
    f"""WITH {cte(E)}, d AS ({_DAILY.format(view=E)}),
        g AS (SELECT client_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY client_id)
        SELECT client_id, day, round(coalesce(volume, 0), 4) AS volume, round(pressure, 4) AS pressure,
            round(temperature, 4) AS temperature FROM g LEFT JOIN d USING (client_id, day)""",
)
def _(spark, sf):
    """Every calendar day between a client's first and last, empty ones too."""
    return _round(report.daily_calendar(readings(spark, sf, E)))


@query(
    "days_with_readings",
    f"""WITH {cte(E)}, d AS ({_DAILY.format(view=E)}) SELECT client_id, day, round(volume, 4) AS volume,
        round(pressure, 4) AS pressure, round(temperature, 4) AS temperature FROM d""",
)
def _(spark, sf):
    return _round(report.daily(readings(spark, sf, E)))


@query(
    "client_history",  # the small shift keeps the values off the rounding ties
    f"""WITH {cte(E)}, h AS (SELECT client_id, date_trunc('hour', ts)::TIMESTAMP AS ts, volume, src_ord FROM {E}),
        k AS (SELECT client_id, ts, arg_max(volume, src_ord) AS volume FROM h GROUP BY ALL),
        g AS (SELECT client_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM k GROUP BY client_id),
        j AS (SELECT client_id, ts, volume, row_number() OVER (PARTITION BY client_id ORDER BY ts) AS i FROM g LEFT JOIN k USING (client_id, ts)),
        m AS (SELECT *, max(CASE WHEN volume IS NOT NULL THEN i END) OVER (PARTITION BY client_id ORDER BY ts) AS a,
            min(CASE WHEN volume IS NOT NULL THEN i END) OVER (PARTITION BY client_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM j),
        v AS (SELECT m.client_id, m.ts, CASE WHEN m.volume IS NOT NULL THEN m.volume
            ELSE x.volume + (y.volume - x.volume) * (m.i - m.a) / (m.b - m.a) END AS volume
            FROM m LEFT JOIN j x ON x.client_id = m.client_id AND x.i = m.a LEFT JOIN j y ON y.client_id = m.client_id AND y.i = m.b),
        d AS (SELECT client_id, date_trunc('day', ts) AS day, sum(volume) AS volume FROM v GROUP BY 1, 2)
        SELECT client_id, round(0.0000123 + sum(volume), 3) AS total_volume, round(0.0000123 + avg(volume), 3) AS avg_daily_volume,
            round(0.0000123 + quantile_cont(volume, 0.9), 3) AS p90_daily_volume FROM d GROUP BY client_id""",
)
def _(spark, sf):
    """Hourly grid, gaps filled, days, key figures."""
    made = report.client_history(readings(spark, sf, E))
    return made.select(
        "client_id", *[F.round(F.col(c) + 0.0000123, 3).alias(c) for c in ("total_volume", "avg_daily_volume", "p90_daily_volume")]
    )


@query(
    "history_kpis",
    f"""WITH {cte(E)}, d AS ({_DAILY.format(view=E)}),
        g AS (SELECT client_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY client_id),
        f AS (SELECT client_id, day, coalesce(volume, 0) AS volume, pressure, temperature FROM g LEFT JOIN d USING (client_id, day))
        SELECT client_id, round(sum(volume), 4) AS total_volume, round(avg(volume), 4) AS avg_daily_volume,
            round(avg(pressure), 4) AS avg_daily_pressure, round(avg(temperature), 4) AS avg_daily_temperature,
            round(quantile_cont(volume, 0.9), 4) AS p90_daily_volume FROM f GROUP BY client_id""",
)
def _(spark, sf):
    return _round(report.history_kpis(readings(spark, sf, E)))


def _describe(c: str, view: str) -> str:
    return f"""SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
        round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM {view}"""


@query(
    "describe_measures",
    f"WITH {cte(E)} " + " UNION ALL ".join(_describe(c, E) for c in ("volume", "temperature", "pressure")),
)
def _(spark, sf):
    return _round(report.describe(readings(spark, sf, E)), skip=("min", "max"))


@query(
    "segment_totals",
    f"""WITH {cte(E)} SELECT segment, round(sum(volume), 3) AS total_volume, round(avg(volume), 4) AS avg_volume
        FROM {E} GROUP BY segment""",
)
def _(spark, sf):
    df = report.segment_totals(readings(spark, sf, E))
    return df.select("segment", F.round("total_volume", 3).alias("total_volume"), F.round("avg_volume", 4).alias("avg_volume"))


@query(
    "segment_shares",
    f"""WITH {cte(E)} SELECT segment, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM {E}), 6) AS share,
        count(DISTINCT client_id) AS n_clients FROM {E} GROUP BY segment""",
)
def _(spark, sf):
    return _round(report.segment_shares(readings(spark, sf, E)), 6)


@query(
    "clients_per_segment",
    f"WITH {cte(O)} SELECT segment, count(DISTINCT client_id) AS n_clients FROM {O} GROUP BY segment",
)
def _(spark, sf):
    return report.clients_per_segment(readings(spark, sf, O))


@query(
    "global_kpis",
    f"""WITH {cte(E)} SELECT count(DISTINCT client_id) AS n_clients, round(sum(volume), 3) AS total_volume,
        round(avg(volume), 4) AS avg_volume FROM {E}""",
)
def _(spark, sf):
    df = report.global_kpis(readings(spark, sf, E))
    return df.select("n_clients", F.round("total_volume", 3).alias("total_volume"), F.round("avg_volume", 4).alias("avg_volume"))


_MIXED = "CASE WHEN o_orderkey % 5 < 2 THEN 'Industrial' WHEN o_orderkey % 5 < 4 THEN 'Comercial' END AS mixed"


@query(
    "modal_segment",
    f"""WITH {cte(O, _MIXED)}, c AS (SELECT client_id, mixed, count(*) AS n FROM {O} WHERE mixed IS NOT NULL GROUP BY ALL)
        SELECT client_id, mixed AS segment FROM (
            SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY n DESC, mixed) AS rn FROM c) WHERE rn = 1""",
)
def _(spark, sf):
    df = readings(spark, sf, O, _MIXED).drop("segment").withColumnRenamed("mixed", "segment")
    return report.modal_segment(df)


@query(
    "date_extent",
    f"WITH {cte(L)} SELECT CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM {L}",
)
def _(spark, sf):
    return report.date_extent(readings(spark, sf, L))


@query(
    "zero_share",
    f"""WITH {cte(L)} SELECT client_id, round(avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share
        FROM {L} GROUP BY client_id""",
)
def _(spark, sf):
    return _round(report.zero_share(readings(spark, sf, L)), 6)


@query(
    "segment_row_counts",
    f"WITH {cte(E)} SELECT segment, count(*) AS n FROM {E} GROUP BY segment",
)
def _(spark, sf):
    return readings(spark, sf, E).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


# A forecast, score and flag that both engines can compute from one row.
PREDICTED = (
    "value + (event_id % 11 - 5) * 3 AS volume_hat",
    "value AS volume_next",
    "value / 500 AS score",
    "abs((event_id % 11 - 5) * 0.6) AS z_abs",
)


def predicted(spark, sf):
    return readings(spark, sf, E, *PREDICTED)


PREDICTED_CTE = cte(E, *PREDICTED)


@query(
    "long_series",
    f"""WITH {PREDICTED_CTE} SELECT client_id, ts, 'volume_real' AS series, volume_next AS value FROM {E}
        UNION ALL SELECT client_id, ts, 'volume_pred', volume_hat FROM {E}""",
)
def _(spark, sf):
    return report.long_series(predicted(spark, sf).select("client_id", "ts", "volume_next", "volume_hat"))


@query(
    "residuals",
    f"WITH {PREDICTED_CTE} SELECT client_id, ts, round(volume_next - volume_hat, 6) AS resid FROM {E}",
)
def _(spark, sf):
    df = predicted(spark, sf)
    return df.select("client_id", "ts", F.round(F.col("volume_next") - F.col("volume_hat"), 6).alias("resid"))


_BAND = """SELECT client_id, ts, volume_next, volume_hat, volume_hat * (1 + 0.1) AS upper, volume_hat * (1 - 0.1) AS lower,
    label AS flag_final, score AS proba FROM {view}"""


@query(
    "tolerance_bands",
    f"""WITH {PREDICTED_CTE}, b AS ({_BAND.format(view=E)}) SELECT client_id, ts, round(upper, 5) AS upper,
        round(lower, 5) AS lower, CAST(volume_next > upper OR volume_next < lower AS INTEGER) AS out_of_band FROM b""",
)
def _(spark, sf):
    df = flags.bands(predicted(spark, sf), 0.1)
    return df.select("client_id", "ts", F.round("upper", 5).alias("upper"), F.round("lower", 5).alias("lower"), "out_of_band")


@query(
    "out_of_band_points",
    f"""WITH {PREDICTED_CTE}, b AS ({_BAND.format(view=E)}) SELECT client_id, ts, volume_next, volume_hat,
        round(upper, 5) AS upper, round(lower, 5) AS lower, flag_final, round(proba, 6) AS proba FROM b
        WHERE (volume_next > upper OR volume_next < lower) AND flag_final = 1""",
)
def _(spark, sf):
    df = predicted(spark, sf).withColumnRenamed("label", "flag_final").withColumn("proba", F.col("score"))
    points = flags.out_of_band_points(flags.bands(df, 0.1, with_flag=True))
    return points.withColumns(
        {"upper": F.round("upper", 5), "lower": F.round("lower", 5), "proba": F.round("proba", 6)}
    )
