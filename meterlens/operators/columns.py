"""Column-level projections: header normalising, checks, coercion, labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from meterlens import schema as S


def _first_alias(columns: Sequence[str], aliases: Iterable[str]) -> str | None:
    by_lower = {c.strip().lower(): c for c in columns}
    return next((by_lower[a] for a in aliases if a in by_lower), None)


def normalise_headers(
    df: DataFrame, client_hint: str | None = None, date_hint: str | None = None
) -> DataFrame:
    """Strip headers and rename the client, timestamp and measure columns to the internal names.

    A hint goes before the alias list. Unknown columns keep their (stripped) name.
    """
    client = [client_hint.strip().lower()] if client_hint else []
    date = [date_hint.strip().lower()] if date_hint else []
    mapping = {c: c.strip() for c in df.columns if c != c.strip()}
    wanted = [
        (S.CLIENT, [*client, S.CLIENT, *S.CLIENT_ALIASES]),
        (S.TS, [*date, S.TS, *S.DATE_ALIASES]),
    ]
    external = {v.lower(): k for k, v in S.EXTERNAL_NAMES.items() if k in (S.SEGMENT, *S.MEASURES)}
    wanted += [(name, [name, alias]) for alias, name in external.items()]
    for target, aliases in wanted:
        hit = _first_alias(df.columns, aliases)
        if hit is not None and hit != target:
            mapping[hit] = target
    return df.withColumnsRenamed(mapping) if mapping else df


def require_date_column(df: DataFrame) -> DataFrame:
    """Rename the timestamp column by the short alias list; an absent one is an error."""
    if S.TS in df.columns:
        return df
    hit = _first_alias(df.columns, S.STRICT_DATE_ALIASES)
    if hit is None:
        raise S.MissingColumns(f"no timestamp column among {df.columns}")
    return df.withColumnRenamed(hit, S.TS)


def require_columns(df: DataFrame, needed: Sequence[str] = tuple(S.REQUIRED)) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise S.MissingColumns(f"missing columns: {missing}")
    return df


def to_number(col: Column | str) -> Column:
    """Number or null: text that is no number, and NaN, become null."""
    c = F.col(col) if isinstance(col, str) else col
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def coerce_measures(df: DataFrame, cols: Sequence[str] = tuple(S.MEASURES)) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in cols if c in df.columns})


def fill_segment(df: DataFrame) -> DataFrame:
    """Add the segment column or fill its gaps with the default."""
    have = F.col(S.SEGMENT) if S.SEGMENT in df.columns else F.lit(None).cast("string")
    return df.withColumn(S.SEGMENT, F.coalesce(have, F.lit(S.DEFAULT_SEGMENT)))


def front_columns(df: DataFrame, first: Sequence[str] = (S.TS, S.CLIENT, S.SEGMENT)) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def trimmed_key(col: str) -> Column:
    return F.trim(F.col(col).cast("string"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def find_label_column(df: DataFrame) -> str:
    """The label by name, else the first unknown column that holds only 0 and 1."""
    for name in S.LABEL_NAMES:
        if name in df.columns:
            return name
    known = {*S.READINGS.names, "v_filt", "volume_hat", "volume_next", "proba", "flag_final"}
    known |= set(S.RESIDUAL_FEATURES) | set(S.EXTERNAL_NAMES.values())
    rest = [c for c in df.columns if c not in known]
    if rest:
        checks = binary_check(df, rest).first()
        for c in rest:
            if checks[c]:
                return c
    raise S.MissingColumns("no label column")


def binary_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: for each column, whether it has values and all of them are 0 or 1."""
    number = lambda c: F.col(c).try_cast("double") if _castable(df, c) else F.lit(None).cast("double")
    return df.agg(
        *[
            F.coalesce(
                F.bool_and(F.when(F.col(c).isNotNull(), F.coalesce(number(c).isin(0.0, 1.0), F.lit(False)))),
                F.lit(False),
            ).alias(c)
            for c in cols
        ]
    )


def _castable(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.NumericType, T.BooleanType))


def to_external(df: DataFrame) -> DataFrame:
    """Rename to the headers of the exchanged files."""
    return df.withColumnsRenamed({k: v for k, v in S.EXTERNAL_NAMES.items() if k in df.columns})
