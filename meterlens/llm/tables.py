"""Access to the given tables and column helpers shared by the operators of this folder."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows in an Arrow batch of whole texts.
TEXT_ROWS = 1_000
#: What separates words; every other character belongs to one.
BLANKS = r"[\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), rows) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same on pure ASCII text and is far cheaper than ``translate``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def hex_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def hex64(value: Column) -> Column:
    """A 64-bit integer as 16 lowercase hex digits, read as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
