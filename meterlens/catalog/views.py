"""Readings made from the given tables, as one select list for Spark and for SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = {
    "client_id": "CAST(user_id AS STRING)",
    "ts": "ts",
    "segment": "CASE WHEN user_id % 3 = 0 THEN 'Industrial' ELSE 'Comercial' END",
    "pressure": (
        "CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(event_id % 17 AS DOUBLE) / 4 END AS DOUBLE)"
    ),
    "temperature": "CAST(10 + event_id % 23 AS DOUBLE)",
    "volume": "value",
    "src_ord": "event_id",
    "label": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
}
LINEITEM = {
    "client_id": "CAST(l_suppkey AS STRING)",
    "ts": "l_shipdate",
    "segment": "CASE WHEN l_suppkey % 3 = 0 THEN 'Industrial' ELSE 'Comercial' END",
    "pressure": "l_discount * 100",
    "temperature": "l_tax * 100",
    "volume": "l_quantity - 3",
    "src_ord": "l_orderkey * 10 + l_linenumber",
    "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
}
ORDERS = {
    "client_id": "CAST(o_custkey AS STRING)",
    "ts": "o_orderdate",
    "segment": "CASE WHEN o_custkey % 3 = 0 THEN 'Industrial' ELSE 'Comercial' END",
    "pressure": "CAST(1.0 AS DOUBLE)",
    "temperature": "CAST(o_orderkey % 11 AS DOUBLE)",
    "volume": "o_totalprice / 1000",
    "src_ord": "o_orderkey",
    "label": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
}
_TABLES = {"readings_e": ("events", EVENTS), "readings_l": ("lineitem", LINEITEM), "readings_o": ("orders", ORDERS)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str, view: str, *extra: str) -> DataFrame:
    source, columns = _TABLES[view]
    cols = [f"{expr} AS {name}" for name, expr in columns.items()]
    return table(spark, sf, source).selectExpr(*cols, *extra)


def cte(view: str, *extra: str) -> str:
    """``view AS (SELECT ...)`` for a WITH clause."""
    source, columns = _TABLES[view]
    cols = [f"{expr} AS {name}" for name, expr in columns.items()]
    return f"{view} AS (SELECT {', '.join([*cols, *extra])} FROM {source})"


# First reading of each (client, ts) of the long view, as most series queries want it.
FIRST_L = (
    cte("readings_l")
    + """, first_l AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY client_id, ts ORDER BY src_ord) AS rn FROM readings_l)
    WHERE rn = 1)"""
)
