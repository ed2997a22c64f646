"""Cleaning, projection, deduplication and set queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meterlens import schema as S
from meterlens.catalog.registry import query
from meterlens.catalog.views import cte, readings, table
from meterlens.operators import clean, columns, flags, report
from meterlens.operators.timestamps import parse_fixed_timestamp, parse_timestamp
from meterlens.sources.readers import empty_readings

E, L, O = "readings_e", "readings_l", "readings_o"

_TEXT_DATES = """CASE event_id % 8
    WHEN 0 THEN {iso_t}
    WHEN 1 THEN {dash12}
    WHEN 2 THEN {dash24}
    WHEN 3 THEN {slash24}
    WHEN 4 THEN {slashsec}
    WHEN 5 THEN {day}
    WHEN 6 THEN concat('  ', {short}, ' ')
    ELSE 'zz' END"""
_SPARK_TEXT = _TEXT_DATES.format(
    iso_t="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    dash12="date_format(ts, 'dd-MM-yyyy hh:mm:ss a')",
    dash24="date_format(ts, 'dd-MM-yyyy HH:mm')",
    slash24="date_format(ts, 'dd/MM/yyyy  HH:mm')",
    slashsec="date_format(ts, 'dd/MM/yyyy HH:mm:ss')",
    day="date_format(ts, 'yyyy-MM-dd')",
    short="date_format(ts, 'dd-MM-yy HH:mm')",
)
_DUCK_TEXT = _TEXT_DATES.format(
    iso_t="strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    dash12="strftime(ts, '%d-%m-%Y %I:%M:%S %p')",
    dash24="strftime(ts, '%d-%m-%Y %H:%M')",
    slash24="strftime(ts, '%d/%m/%Y  %H:%M')",
    slashsec="strftime(ts, '%d/%m/%Y %H:%M:%S')",
    day="strftime(ts, '%Y-%m-%d')",
    short="strftime(ts, '%d-%m-%y %H:%M')",
)
_DUCK_PARSED = """try_strptime(trim(regexp_replace(raw, '\\s+', ' ', 'g')),
    ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%d-%m-%Y %I:%M:%S %p', '%d-%m-%y %H:%M',
     '%d-%m-%Y %H:%M', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M'])"""


@query(
    "parse_mixed_timestamps",
    f"SELECT event_id, CAST({_DUCK_PARSED} AS TIMESTAMP) AS ts FROM (SELECT event_id, {_DUCK_TEXT} AS raw FROM events)",
)
def _(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id", f"{_SPARK_TEXT} AS raw")
    return raw.select("event_id", parse_timestamp("raw").alias("ts"))


# Shapes of real files beyond the seconds, each with the time it stands for.
_RICH = [
    ("date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "ts"),
    ("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), 'Z')", "date_trunc('millisecond', ts)"),
    ("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+05:00')", "date_trunc('second', ts)"),
    ("date_format(ts, 'yyyy/MM/dd HH:mm')", "date_trunc('minute', ts)"),
    ("date_format(ts, 'dd.MM.yyyy HH:mm:ss')", "date_trunc('second', ts)"),
    ("date_format(ts, 'd/M/yyyy H:mm')", "date_trunc('minute', ts)"),
    ("date_format(ts, 'yyyy-M-d')", "date_trunc('day', ts)"),
    ("concat(date_format(ts, 'dd/MM/yyyy hh:mm:ss '), lower(substr(date_format(ts, 'a'), 1, 1)), '. m.')", "date_trunc('second', ts)"),
    ("date_format(ts, 'dd-MM-yyyy HH:mm:ss,SSS')", "date_trunc('millisecond', ts)"),
    ("concat('day ', date_format(ts, 'd'))", "NULL"),
]


@query(
    "parse_rich_timestamps",
    f"""SELECT event_id, CAST(CASE {' '.join(f'WHEN event_id % {len(_RICH)} = {i} THEN {sql}' for i, (_, sql) in enumerate(_RICH))}
        END AS TIMESTAMP) AS ts FROM events""",
)
def _(spark, sf):
    shapes = " ".join(f"WHEN event_id % {len(_RICH)} = {i} THEN {text}" for i, (text, _) in enumerate(_RICH))
    raw = table(spark, sf, "events").selectExpr("event_id", f"CASE {shapes} END AS raw")
    return raw.select("event_id", parse_timestamp("raw").alias("ts"))


@query(
    "parse_fixed_timestamps",
    "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events",
)
def _(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id", "date_format(ts, 'dd-MM-yyyy hh:mm:ss a') AS raw")
    return raw.select("event_id", parse_fixed_timestamp("raw").alias("ts"))


@query(
    "count_unparseable",
    f"SELECT count(*) FILTER ({_DUCK_PARSED} IS NULL) AS n_unparseable FROM (SELECT {_DUCK_TEXT} AS raw FROM events)",
)
def _(spark, sf):
    raw = table(spark, sf, "events").selectExpr(f"{_SPARK_TEXT} AS raw")
    return clean.unparseable(raw.select(parse_timestamp("raw").alias("ts")))


@query(
    "normalise_headers",
    f"WITH {cte(E)} SELECT client_id, ts, volume, pressure, temperature FROM {E}",
)
def _(spark, sf):
    df = readings(spark, sf, E).selectExpr(
        "client_id AS ` Medidor `", "ts AS `FECHA hora`", "volume AS Volumen", "pressure AS Presion", "temperature AS TEMPERATURA"
    )
    return columns.normalise_headers(df).select(*S.REQUIRED)


@query("strict_date_header", f"WITH {cte(O)} SELECT client_id, ts FROM {O}")
def _(spark, sf):
    df = readings(spark, sf, O).selectExpr("client_id", "ts AS FechaHora")
    return columns.require_date_column(df).select("client_id", "ts")


@query(
    "required_columns",
    f"WITH {cte(O)} SELECT client_id, CAST(ts AS TIMESTAMP) AS ts, volume, pressure, temperature FROM {O}",
)
def _(spark, sf):
    """Readings that have every required column join an empty readings table; a table that lacks some is refused."""
    raw = table(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS client_id", "ts", "value AS volume")
    try:
        kept = columns.require_columns(raw)
    except S.MissingColumns:
        kept = empty_readings(spark)
    whole = columns.require_columns(readings(spark, sf, O))
    return kept.select(*S.REQUIRED).unionByName(whole.select(*S.REQUIRED))


@query(
    "coerce_numbers",
    """SELECT event_id, TRY_CAST(raw AS DOUBLE) AS volume FROM (
        SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 5 = 1 THEN NULL
            ELSE CAST(event_id % 97 AS VARCHAR) || '.25' END AS raw FROM events)""",
)
def _(spark, sf):
    raw = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 5 = 1 THEN NULL"
        " ELSE concat(CAST(event_id % 97 AS STRING), '.25') END AS volume",
    )
    return columns.coerce_measures(raw)


_GAPS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS gap_volume"


@query(
    "drop_missing_required",
    f"WITH {cte(E, _GAPS)} SELECT client_id, ts, gap_volume AS volume FROM {E} WHERE gap_volume IS NOT NULL",
)
def _(spark, sf):
    df = readings(spark, sf, E, _GAPS).drop("volume").withColumnRenamed("gap_volume", "volume")
    return clean.drop_missing(df).select("client_id", "ts", "volume")


_A = "CASE WHEN event_id % 6 < 2 THEN NULL ELSE event_type END"
_B = "CASE WHEN event_id % 6 IN (1, 2) THEN NULL ELSE value END"


@query(
    "drop_empty_rows",
    f"SELECT * FROM (SELECT {_A} AS a, {_B} AS b FROM events) WHERE a IS NOT NULL OR b IS NOT NULL",
)
def _(spark, sf):
    return clean.drop_empty_rows(table(spark, sf, "events").selectExpr(f"{_A} AS a", f"{_B} AS b"))


@query(
    "filter_segment_client",
    f"WITH {cte(E)} SELECT client_id, ts, volume FROM {E} WHERE segment = 'Industrial' AND client_id = '3'",
)
def _(spark, sf):
    df = report.one_client(report.one_segment(readings(spark, sf, E), S.INDUSTRIAL), "3")
    return df.select("client_id", "ts", "volume")


@query(
    "filter_date_range",
    f"""WITH {cte(L)} SELECT client_id, ts, volume, src_ord FROM {L}
        WHERE ts BETWEEN TIMESTAMP '1997-03-01 00:00:00' AND TIMESTAMP '1997-06-30 00:00:00'""",
)
def _(spark, sf):
    df = report.date_range(readings(spark, sf, L), date(1997, 3, 1), date(1997, 6, 30))
    return df.select("client_id", "ts", "volume", "src_ord")


@query(
    "keep_first_reading",
    f"""WITH {cte(L)} SELECT client_id, ts, volume, pressure, temperature, src_ord FROM (
        SELECT *, row_number() OVER (PARTITION BY client_id, ts ORDER BY src_ord) AS rn FROM {L}) WHERE rn = 1""",
)
def _(spark, sf):
    df = readings(spark, sf, L).select("client_id", "ts", "volume", "pressure", "temperature", "src_ord")
    return clean.keep_first(df)


@query(
    "keep_last_reading",
    f"""WITH {cte(L)} SELECT client_id, ts, volume, pressure, temperature, src_ord FROM (
        SELECT *, row_number() OVER (PARTITION BY client_id, ts ORDER BY src_ord DESC) AS rn FROM {L}) WHERE rn = 1""",
)
def _(spark, sf):
    df = readings(spark, sf, L).select("client_id", "ts", "volume", "pressure", "temperature", "src_ord")
    return clean.keep_last(df)


@query(
    "duplicate_count",
    f"""WITH {cte(L)} SELECT CAST(sum(n - 1) AS BIGINT) AS n_removed
        FROM (SELECT count(*) AS n FROM {L} GROUP BY client_id, ts)""",
)
def _(spark, sf):
    return clean.duplicate_count(readings(spark, sf, L))


_OLD, _NEW = "src_ord % 3 <> 0", "src_ord % 3 <> 1"


@query(
    "upsert_readings",
    f"""WITH {cte(L)}, both_batches AS (
        SELECT 0 AS batch, client_id, ts, volume, src_ord FROM {L} WHERE {_OLD}
        UNION ALL SELECT 1, client_id, ts, volume + 1000, src_ord FROM {L} WHERE {_NEW})
    SELECT client_id, ts, volume, src_ord FROM (
        SELECT *, row_number() OVER (PARTITION BY client_id, ts ORDER BY batch DESC, src_ord DESC) AS rn
        FROM both_batches) WHERE rn = 1""",
)
def _(spark, sf):
    df = readings(spark, sf, L).select("client_id", "ts", "volume", "src_ord")
    fresh = df.where(_NEW).withColumn("volume", F.col("volume") + 1000)
    return clean.upsert(df.where(_OLD), fresh)


@query(
    "union_sources",
    f"""WITH {cte(E)}, {cte(O)} SELECT client_id, ts, volume, pressure FROM {E}
        UNION ALL SELECT client_id, ts, volume, NULL FROM {O}""",
)
def _(spark, sf):
    first = readings(spark, sf, E).select("client_id", "ts", "volume", "pressure")
    second = readings(spark, sf, O).select("client_id", "ts", "volume")
    return first.unionByName(second, allowMissingColumns=True)


@query("distinct_clients", f"WITH {cte(O)} SELECT DISTINCT client_id FROM {O}")
def _(spark, sf):
    return report.distinct_values(readings(spark, sf, O), "client_id")


@query("distinct_segments", f"WITH {cte(O)} SELECT DISTINCT segment FROM {O}")
def _(spark, sf):
    return report.distinct_values(readings(spark, sf, O).withColumn("segment", F.concat(F.lit(" "), "segment")), "segment")


def _prior(view: str, seconds: int) -> str:
    return f"""avg(pressure) OVER (PARTITION BY client_id ORDER BY epoch_us(ts)
        RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND 1 PRECEDING)"""


IMPUTED_E = f"""{cte(E)}, found AS (SELECT *, {_prior(E, 10800)} AS m FROM {E}),
    fixed AS (SELECT *, pressure = 0 AND volume > 0 AND m IS NOT NULL AS imputed FROM found)"""


@query(
    "prior_three_hour_mean",
    f"WITH {cte(E)} SELECT client_id, ts, round({_prior(E, 10800)}, 6) AS prior_mean FROM {E}",
)
def _(spark, sf):
    df = clean.prior_mean(readings(spark, sf, E))
    return df.select("client_id", "ts", F.round("prior_mean", 6).alias("prior_mean"))


@query(
    "impute_pressure",
    f"""WITH {IMPUTED_E} SELECT client_id, ts, imputed,
        round(CASE WHEN imputed THEN m ELSE pressure END, 6) AS pressure FROM fixed""",
)
def _(spark, sf):
    df = clean.impute_pressure(readings(spark, sf, E))
    return df.select("client_id", "ts", "imputed", F.round("pressure", 6).alias("pressure"))


@query(
    "imputation_report",
    f"""WITH {IMPUTED_E} SELECT client_id, count(*) AS n_imputed, round(avg(m), 6) AS mean_imputed
        FROM fixed WHERE imputed GROUP BY client_id""",
)
def _(spark, sf):
    df = clean.imputation_report(clean.impute_pressure(readings(spark, sf, E)))
    return df.select("client_id", "n_imputed", F.round("mean_imputed", 6).alias("mean_imputed"))


@query(
    "clamp_negatives",
    f"""WITH {cte(L)} SELECT client_id, ts, src_ord, CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume,
        round(CASE WHEN pressure < 0 THEN 0 ELSE pressure END, 6) AS pressure FROM {L}""",
)
def _(spark, sf):
    df = clean.clamp_negatives(readings(spark, sf, L))
    return df.select("client_id", "ts", "src_ord", "volume", F.round("pressure", 6).alias("pressure"))


@query(
    "negative_counts",
    f"""WITH {cte(L)} SELECT count(*) FILTER (volume < 0) AS negative_volume,
        count(*) FILTER (pressure < 0) AS negative_pressure FROM {L}""",
)
def _(spark, sf):
    return clean.negative_counts(readings(spark, sf, L))


@query(
    "fill_segment",
    f"""WITH {cte(O)} SELECT client_id, src_ord,
        coalesce(CASE WHEN src_ord % 4 = 0 THEN NULL ELSE segment END, 'Comercial') AS segment FROM {O}""",
)
def _(spark, sf):
    df = readings(spark, sf, O).withColumn("segment", F.expr("CASE WHEN src_ord % 4 = 0 THEN NULL ELSE segment END"))
    return columns.fill_segment(df).select("client_id", "src_ord", "segment")


@query("front_columns", f"WITH {cte(O)} SELECT ts, client_id, segment, volume, src_ord FROM {O}")
def _(spark, sf):
    df = readings(spark, sf, O).select("volume", "src_ord", "segment", "client_id", "ts")
    return columns.front_columns(df)


@query(
    "find_label_column",
    """SELECT bool_and(event_id IN (0, 1)) AS event_id, bool_and(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END IN (0, 1)) AS mark,
        bool_and(value IN (0, 1)) AS value FROM events""",
)
def _(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS mark", "value"
    )
    return columns.binary_check(df, ["event_id", "mark", "value"])


@query(
    "friendly_numbers",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'N/A'
        WHEN event_id % 9 = 1 THEN format('{:,}', event_id * 1000 + 1000)
        ELSE format('{:,.2f}', event_id * 3 + 0.25) END AS shown FROM events""",
)
def _(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id",
        "CAST(CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN event_id * 1000 + 1000"
        " ELSE event_id * 3 + 0.25 END AS DOUBLE) AS v",
    )
    return df.select("event_id", report.friendly_number("v").alias("shown"))


@query(
    "safe_segment_names",
    """SELECT c_custkey, regexp_replace(c_name || ' <' || c_mktsegment || '>|a/b', '[\\\\/:*?"<>| ]', '_', 'g') AS suffix
        FROM customer""",
)
def _(spark, sf):
    from meterlens.functions.names import safe_suffix

    df = table(spark, sf, "customer").selectExpr("c_custkey", "concat(c_name, ' <', c_mktsegment, '>|a/b') AS s")
    return df.select("c_custkey", safe_suffix("s").alias("suffix"))



@query(
    "grade_severity",
    """SELECT event_id, CASE WHEN value / 500 >= 0.95 THEN 'Crítica' WHEN value / 500 >= 0.85 THEN 'Media'
        WHEN value / 500 >= 0.70 THEN 'Leve' ELSE '' END AS severity FROM events""",
)
def _(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", flags.severity(F.col("value") / 500).alias("severity"))


@query(
    "severity_counts",
    """WITH g AS (SELECT CASE WHEN value / 500 >= 0.95 THEN 'Crítica' WHEN value / 500 >= 0.85 THEN 'Media'
        WHEN value / 500 >= 0.70 THEN 'Leve' ELSE '' END AS severity FROM events WHERE event_type = 'error')
    SELECT t.severity, count(g.severity) AS n FROM (VALUES ('Leve'), ('Media'), ('Crítica')) t(severity)
        LEFT JOIN g ON g.severity = t.severity GROUP BY t.severity""",
)
def _(spark, sf):
    df = readings(spark, sf, E).select((F.col("volume") / 500).alias("proba"), F.col("label").alias("flag_final"))
    return flags.severity_counts(df)
