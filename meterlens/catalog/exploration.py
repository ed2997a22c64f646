"""Distribution, correlation and seasonality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens.catalog.registry import query
from meterlens.catalog.reports import _round
from meterlens.catalog.views import FIRST_L, cte, readings, table
from meterlens.operators import clean, explore
from meterlens.operators.blocks import series_blocks
from meterlens.plans import explore as plan
from meterlens.session import cut

E, L = "readings_e", "readings_l"
COLS = ["pressure", "temperature", "volume"]


def _union(template: str, cols=COLS) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in cols)


@query(
    "null_counts",
    "SELECT 'a' AS \"column\", count(*) FILTER (event_id % 3 = 0) AS n_null FROM events"
    " UNION ALL SELECT 'b', count(*) FILTER (event_type = 'view') FROM events",
)
def _(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 3 <> 0 THEN value END AS a", "CASE WHEN event_type <> 'view' THEN 1 END AS b"
    )
    return explore.null_counts(df)


@query(
    "top_values",
    """SELECT CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS value, count(*) AS n FROM events
        GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 20""",
)
def _(spark, sf):
    return explore.top_values(table(spark, sf, "events").selectExpr("nullif(event_type, 'view') AS t"), "t")


@query(
    "top_values_all",
    f"""WITH {cte(E)}, p AS (SELECT 'client_id' AS "column", client_id AS value FROM {E} UNION ALL SELECT 'segment', segment FROM {E})
        SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS rn
            FROM (SELECT "column", value, count(*) AS n FROM p GROUP BY ALL)) WHERE rn <= 20""",
)
def _(spark, sf):
    return explore.top_values_all(readings(spark, sf, E).select("client_id", "segment", "volume"))


@query(
    "correlation_matrix",
    f"WITH {cte(L)} "
    + _union("SELECT '{c}' AS variable, " + ", ".join(f"round(corr({{c}}, {d}), 6) AS {d}" for d in COLS) + f" FROM {L}"),
)
def _(spark, sf):
    return _round(explore.correlation(readings(spark, sf, L)), 6)


@query(
    "median_by_hour",
    f"WITH {cte(E)} SELECT CAST(hour(ts) AS INTEGER) AS hour, round(median(volume), 4) AS median_volume FROM {E} GROUP BY 1",
)
def _(spark, sf):
    return _round(explore.median_profile(readings(spark, sf, E), "hour"))


@query(
    "median_by_weekday",
    f"""WITH {cte(E)} SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, client_id, round(median(volume), 4) AS median_volume
        FROM {E} GROUP BY 1, 2""",
)
def _(spark, sf):
    return _round(explore.median_profile(readings(spark, sf, E), "weekday", ["client_id"]))


_MOMENTS = f"""mo AS ({_union("SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS sd FROM " + L)}),
    lo AS ({_union("SELECT '{c}' AS variable, {c} AS x FROM " + L)}),
    sk AS (SELECT variable, any_value(n) AS n, any_value(mean) AS mean, avg((x - mean) ** 3) / any_value(sd) ** 3 AS skew,
        avg((x - mean) ** 4) / any_value(sd) ** 4 - 3 AS kurtosis FROM lo JOIN mo USING (variable) GROUP BY variable)"""


@query(
    "skew_kurtosis",
    f"WITH {cte(L)}, {_MOMENTS} SELECT variable, n, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis FROM sk",
)
def _(spark, sf):
    df = explore.moments(readings(spark, sf, L), COLS)
    return _round(df.select("variable", "n", "skew", "kurtosis"), 6)


@query(
    "jarque_bera",
    f"""WITH {cte(L)}, {_MOMENTS}, jb AS (SELECT variable, n / 6.0 * (skew ** 2 + kurtosis ** 2 / 4) AS jb FROM sk)
        SELECT variable, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 6) AS jarque_bera_p, exp(-jb / 2) > 0.05 AS jarque_bera_normal FROM jb""",
)
def _(spark, sf):
    df = explore.jarque_bera(explore.moments(readings(spark, sf, L), COLS))
    return df.select(
        "variable", F.round("jarque_bera", 4).alias("jarque_bera"), F.round("jarque_bera_p", 6).alias("jarque_bera_p"), "jarque_bera_normal"
    )


_K2 = f"""{_MOMENTS},
    q AS (SELECT *, skew * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y,
        3.0 * (n::DOUBLE * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2,
        3.0 * (n - 1) / (n + 1) AS eb, 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5)) AS vb,
        6.0 * (n::DOUBLE * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) AS sb FROM sk),
    r AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, (kurtosis + 3 - eb) / sqrt(vb) AS x, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ** 2)) AS a FROM q),
    s AS (SELECT *, 1 / sqrt(ln(sqrt(w2))) * asinh(y / sqrt(2 / (w2 - 1))) AS zs, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS t FROM r),
    k AS (SELECT variable, zs ** 2 + ((1 - 2 / (9 * a) - sign(t) * abs(t) ** (1 / 3.0)) / sqrt(2 / (9 * a))) ** 2 AS k2 FROM s)"""


@query(
    "dagostino_k2",
    f"""WITH {cte(L)}, {_K2} SELECT variable, round(k2, 4) AS dagostino_k2, round(exp(-k2 / 2), 6) AS dagostino_p,
        exp(-k2 / 2) > 0.05 AS dagostino_normal FROM k""",
)
def _(spark, sf):
    df = explore.dagostino(explore.moments(readings(spark, sf, L), COLS))
    return df.select(
        "variable", F.round("dagostino_k2", 4).alias("dagostino_k2"), F.round("dagostino_p", 6).alias("dagostino_p"), "dagostino_normal"
    )


def _horner(x: str, *coefficients: float) -> str:
    """A polynomial as SQL, highest power first."""
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


# Hart's rational form of the normal tail beyond x, for x from 0 to 7.07, to double precision.
_TAIL_OVER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_TAIL = f"exp(-z * z / 2) * {_horner('abs(z)', *_TAIL_OVER)} / {_horner('abs(z)', *_TAIL_UNDER)}"


_AD = f"""xs AS ({_union("SELECT '{c}' AS variable, {c} AS x FROM " + L + " WHERE {c} IS NOT NULL")}),
    st AS (SELECT variable, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM xs GROUP BY 1),
    z AS (SELECT variable, n, (x - mean) / sd AS z, row_number() OVER (PARTITION BY variable ORDER BY x) AS i FROM xs JOIN st USING (variable)),
    t AS (SELECT variable, n, i, z, {_TAIL} AS tail FROM z),
    l AS (SELECT *, CASE WHEN z < 0 THEN ln(tail) ELSE ln(1 - tail) END AS below, CASE WHEN z < 0 THEN ln(1 - tail) ELSE ln(tail) END AS above FROM t),
    a AS (SELECT variable, n, -n - fsum((2 * i - 1) * below + (2 * (n - i) + 1) * above) / n AS a2 FROM l GROUP BY variable, n)"""


@query(
    "anderson_darling",
    f"""WITH {cte(L)}, {_AD}
        SELECT variable, round(a2, 3) AS anderson_stat, k.level AS level, round(k.base / (1 + 4.0 / n - 25.0 / n / n), 3) AS critical
        FROM a, (VALUES (15.0::DOUBLE, 0.576::DOUBLE), (10.0, 0.656), (5.0, 0.787), (2.5, 0.918), (1.0, 1.092)) AS k(level, base)""",
)
def _(spark, sf):
    made = explore.anderson_darling(readings(spark, sf, L), COLS)
    levels = F.arrays_zip(F.col("anderson_sig").alias("level"), F.col("anderson_crit").alias("critical"))
    return made.select("variable", F.round("anderson_stat", 3).alias("anderson_stat"), F.inline(levels).alias("level", "critical"))


_LEVELS = "[0.576::DOUBLE, 0.656, 0.787, 0.918, 1.092]"


@query(
    "normality_table",
    f"""WITH {cte(L)}, {_K2}, {_AD}
        SELECT variable, sk.n, round(st.mean, 6) AS mean, round(st.sd, 6) AS std, round(mo.sd, 6) AS std_pop, round(skew, 6) AS skew,
            round(kurtosis, 6) AS kurtosis, round(sk.n / 6.0 * (skew ** 2 + kurtosis ** 2 / 4), 4) AS jarque_bera,
            round(exp(-sk.n / 12.0 * (skew ** 2 + kurtosis ** 2 / 4)), 6) AS jarque_bera_p,
            exp(-sk.n / 12.0 * (skew ** 2 + kurtosis ** 2 / 4)) > 0.05 AS jarque_bera_normal,
            round(k2, 4) AS dagostino_k2, round(exp(-k2 / 2), 6) AS dagostino_p, exp(-k2 / 2) > 0.05 AS dagostino_normal,
            round(a2, 3) AS anderson_stat, '15.0,10.0,5.0,2.5,1.0' AS anderson_sig,
            array_to_string([round(b / (1 + 4.0 / sk.n - 25.0 / sk.n / sk.n), 3) FOR b IN {_LEVELS}], ',') AS anderson_crit
        FROM sk JOIN mo USING (variable) JOIN st USING (variable) JOIN k USING (variable) JOIN a USING (variable)""",
)
def _(spark, sf):
    made = explore.normality(readings(spark, sf, L), COLS)
    digits = {c: 6 for c in ("mean", "std", "std_pop", "skew", "kurtosis", "jarque_bera_p", "dagostino_p")}
    digits |= {"jarque_bera": 4, "dagostino_k2": 4, "anderson_stat": 3}
    made = made.withColumns({c: F.round(c, n) for c, n in digits.items()})
    return made.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("anderson_sig", "anderson_crit")})


_HIST = """SELECT '{c}' AS variable, b AS bin, lo + (hi - lo) / 30 * (b - 1) AS from_value, lo + (hi - lo) / 30 * b AS to_value,
    (SELECT count(*) FROM readings_e WHERE least(CAST(floor(({c} - lo) / (hi - lo) * 30) AS BIGINT) + 1, 30) = b) AS n
    FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM readings_e), (SELECT unnest(generate_series(1, 30)) AS b)"""


@query(
    "histogram",
    f"WITH {cte(E)}, h AS ({_HIST.format(c='volume')}) SELECT variable, CAST(bin AS BIGINT) AS bin, round(from_value, 5) AS from_value, round(to_value, 5) AS to_value, n FROM h",
)
def _(spark, sf):
    return _round(explore.histogram(readings(spark, sf, E), ["volume"]), 5)


_BOX = """SELECT '{c}' AS variable, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3,
    least(min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)), any_value(q1)) AS whisker_low,
    greatest(max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)), any_value(q3)) AS whisker_high,
    count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM readings_e, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM readings_e)"""


@query(
    "boxplot",
    f"WITH {cte(E)}, b AS ({' UNION ALL '.join(_BOX.format(c=c) for c in ('volume', 'pressure'))}) "
    + "SELECT variable, n_outliers, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in ("q1", "median", "q3", "whisker_low", "whisker_high"))
    + " FROM b",
)
def _(spark, sf):
    return _round(explore.boxplot(readings(spark, sf, E), ["volume", "pressure"]), 5)


# Acklam's rational form of the normal quantile, relative error below 1.2e-9.
_MID_OVER = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_MID_UNDER = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_END_OVER = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_END_UNDER = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_NORMAL_QUANTILE = f"""CASE WHEN least(p, 1 - p) < 0.02425 THEN sign(0.5 - p) * {_horner('e', *_END_OVER)} / {_horner('e', *_END_UNDER)}
    ELSE (p - 0.5) * {_horner('m', *_MID_OVER)} / {_horner('m', *_MID_UNDER)} END"""


@query(
    "qq_points",
    f"""WITH {cte(E)}, ps AS (SELECT i, (i + 1) / 100.0::DOUBLE AS p FROM (SELECT unnest(generate_series(0, 98)) AS i)),
        th AS (SELECT i, {_NORMAL_QUANTILE} AS theory FROM (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS e, (p - 0.5) ** 2 AS m FROM ps)),
        q AS ({_union("SELECT '{c}' AS variable, quantile_cont({c}, [k / 100.0 FOR k IN range(1, 100)]) AS v, avg({c}) AS mean, stddev_samp({c}) AS sd FROM " + E)})
        SELECT variable, CAST(i AS INTEGER) AS i, round(theory, 6) AS theory, round(v[i + 1], 5) AS sample, round(mean + sd * theory, 5) AS line FROM q, th""",
)
def _(spark, sf):
    made = explore.qq_points(readings(spark, sf, E), COLS)
    return made.select("variable", "i", F.round("theory", 6).alias("theory"), F.round("sample", 5).alias("sample"), F.round("line", 5).alias("line"))


def _first_l(spark, sf):
    return cut(clean.keep_first(readings(spark, sf, L).drop("segment", "label")))


def _lag_blocks(spark, sf, reach=plan.MAX_LAG):
    return series_blocks(_first_l(spark, sf).select("client_id", "ts", "src_ord", "volume"), reach, reach)


_LAGGED = f"""{FIRST_L}, sq AS (SELECT client_id, volume AS x, row_number() OVER (PARTITION BY client_id ORDER BY ts, src_ord) AS i FROM first_l),
    pr AS (SELECT a.client_id, k.lag, a.x AS x, b.x AS y FROM sq a, (SELECT unnest(generate_series(0, {plan.MAX_LAG})) AS lag) k, sq b
        WHERE b.client_id = a.client_id AND b.i = a.i + k.lag)"""


@query(
    "lag_correlation",
    f"WITH {_LAGGED} SELECT client_id, CAST(lag AS INTEGER) AS lag, round(corr(x, y), 6) AS r FROM pr GROUP BY ALL",
)
def _(spark, sf):
    sums = explore.lag_sums(_lag_blocks(spark, sf), "volume", plan.MAX_LAG)
    return explore.lag_correlation(sums).select("client_id", "lag", F.round("r", 6).alias("r"))


_ACF = f"""{_LAGGED}, m AS (SELECT client_id, avg(x) AS mu, var_pop(x) * count(*) AS v FROM sq GROUP BY client_id),
    acf AS (SELECT client_id, CAST(lag AS INTEGER) AS lag, sum((x - mu) * (y - mu)) / any_value(v) AS acf
        FROM pr JOIN m USING (client_id) GROUP BY client_id, lag)"""


@query("autocorrelation", f"WITH {_ACF} SELECT client_id, lag, round(acf, 6) AS acf FROM acf")
def _(spark, sf):
    sums = explore.lag_sums(_lag_blocks(spark, sf), "volume", plan.MAX_LAG)
    return explore.autocorrelation(sums, ["client_id"]).select("client_id", "lag", F.round("acf", 6).alias("acf"))


@query(
    "seasonal_period",
    f"""WITH {_LAGGED}, c AS (SELECT client_id, lag, corr(x, y) AS r FROM pr GROUP BY ALL)
        SELECT client_id, CAST(min(lag) FILTER (lag > 0 AND r > 0.25) AS INTEGER) AS period,
            CAST(min(lag) FILTER (lag > 0 AND r > 0.05) AS INTEGER) AS faint_period FROM c GROUP BY client_id""",
)
def _(spark, sf):
    sums = cut(explore.lag_sums(_lag_blocks(spark, sf), "volume", plan.MAX_LAG))
    faint = explore.seasonal_period(sums, ["client_id"], threshold=0.05).withColumnRenamed("period", "faint_period")
    return explore.seasonal_period(sums, ["client_id"]).join(faint, "client_id")


@query(
    "partial_autocorrelation",
    f"""WITH RECURSIVE {_ACF}, a AS (SELECT client_id, list(acf ORDER BY lag) AS rho FROM acf GROUP BY client_id),
        steps AS (SELECT client_id, rho, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS pacf FROM a
            UNION ALL
            SELECT client_id, rho, k + 1, list_append([phi[j] - last * phi[k + 1 - j] FOR j IN range(1, k + 1)], last), last
            FROM (SELECT *, (rho[k + 2] - coalesce(list_sum([phi[j] * rho[k + 2 - j] FOR j IN range(1, k + 1)]), 0))
                / (1 - coalesce(list_sum([phi[j] * rho[j + 1] FOR j IN range(1, k + 1)]), 0)) AS last
                FROM steps WHERE k + 1 < len(rho)))
        SELECT client_id, k AS lag, round(pacf, 6) AS pacf FROM steps""",
)
def _(spark, sf):
    sums = explore.lag_sums(_lag_blocks(spark, sf), "volume", plan.MAX_LAG)
    made = explore.partial_autocorrelation(explore.autocorrelation(sums, ["client_id"]), ["client_id"])
    return made.select("client_id", "lag", F.round("pacf", 6).alias("pacf"))


_PERIOD = 7
_FRAME = "(PARTITION BY client_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(
    "seasonal_decomposition",
    f"""WITH {FIRST_L}, sq AS (SELECT client_id, ts, volume AS x, row_number() OVER (PARTITION BY client_id ORDER BY ts) - 1 AS i,
            count(*) OVER (PARTITION BY client_id) AS n, avg(volume) OVER {_FRAME} AS ma FROM first_l),
        ft AS (SELECT client_id, regr_slope(ma, i) FILTER (i >= 3 AND i < 10) AS fk, regr_intercept(ma, i) FILTER (i >= 3 AND i < 10) AS fn,
            regr_slope(ma, i) FILTER (i >= n - 11 AND i < n - 4) AS bk, regr_intercept(ma, i) FILTER (i >= n - 11 AND i < n - 4) AS bn
            FROM sq GROUP BY client_id),
        tr AS (SELECT client_id, ts, x, i, CASE WHEN i < 3 THEN fk * i + fn WHEN i > n - 4 THEN bk * i + bn ELSE ma END AS trend FROM sq JOIN ft USING (client_id)),
        ph AS (SELECT client_id, i % 7 AS phase, avg(x - trend) AS m FROM tr GROUP BY ALL),
        se AS (SELECT client_id, phase, m - avg(m) OVER (PARTITION BY client_id) AS seasonal FROM ph)
        SELECT client_id, ts, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(x - trend - seasonal, 4) AS resid
        FROM tr JOIN se ON se.client_id = tr.client_id AND se.phase = tr.i % 7""".replace("SELECT client_id, ts, round(trend", "SELECT tr.client_id, ts, round(trend"),
)
def _(spark, sf):
    made = explore.decompose(_lag_blocks(spark, sf, 8), "volume", _PERIOD).core()
    return _round(made.select("client_id", "ts", "trend", "seasonal", "resid"))


@query("series_statistics")
def _(spark, sf):
    return plan.series_statistics(_first_l(spark, sf), ["client_id"], ["ts", "src_ord"])


@query("whole_table_statistics")
def _(spark, sf):
    df = plan.all_series(readings(spark, sf, E))
    return plan.series_statistics(df, ["series"], ["ts", "client_id", "src_ord"])


@query("top_client_report")
def _(spark, sf):
    return plan.client_report(_first_l(spark, sf))


@query(
    "sample_rows",
    f"WITH {cte(E)} SELECT client_id, src_ord, volume FROM {E} ORDER BY md5(concat_ws('|', client_id, CAST(src_ord AS VARCHAR), '42')) LIMIT 1000",
)
def _(spark, sf):
    drawn = explore.sample_rows(readings(spark, sf, E), 1000, key=("client_id", "src_ord"))
    return drawn.select("client_id", "src_ord", "volume")
