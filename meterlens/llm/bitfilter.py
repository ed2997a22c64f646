"""Bloom filters as bitmaps in a small table, built and asked with DataFrame functions.

A hash drops into ``PROBES`` cells. A filter keeps the cells hit at least once (a set) or at least twice (possibly
repeated hashes). It is broadcast, and its size is bounded whatever the input: beyond the bound it answers "maybe" more
often, which costs time and never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Cells per hash.
PROBES = 2
#: Cells for each hash and probe, before the bound.
SPARE = 8
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32_768
MAX_FILTER_BYTES = 64 << 20


def cells_for(rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> int:
    """Number of cells: a power of two, at least one bitmap's and at most the bound."""
    wanted = max(BITMAP_BITS, rows * PROBES * SPARE)
    return min(1 << (wanted - 1).bit_length(), 1 << ((max_filter_bytes * 8).bit_length() - 1))


def probes(h: Column, cells: int) -> list[Column]:
    """The cells of a hash, numbered from 1."""
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(cells)) + 1 for i in range(PROBES)]


def build(hashes: DataFrame, name: str, cells: int, least: int) -> DataFrame:
    """(bucket, bits): bitmaps of the cells that at least ``least`` rows hit; at most cells / 8 bytes in all."""
    hits = hashes.select(F.explode(F.array_distinct(F.array(*probes(F.col(name), cells)))).alias("cell"))
    often = hits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")
    )


def _bit(bits: Column, cell: Column) -> Column:
    position = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def ask(rows: DataFrame, name: str, bitmaps: DataFrame, cells: int, flag: str) -> DataFrame:
    """``rows`` and whether all cells of the hash ``name`` are in the filter."""
    found = None
    for i, cell in enumerate(probes(F.col(name), cells)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__b{i}"), F.col("bits").alias(f"__m{i}")))
        rows = rows.join(side, F.bitmap_bucket_number(cell) == F.col(f"__b{i}"), "left")
        here = _bit(F.col(f"__m{i}"), cell)
        found = here if found is None else found & here
    return rows.withColumn(flag, found).drop(*[f"__{x}{i}" for x in "bm" for i in range(PROBES)])
