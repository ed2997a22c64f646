"""Exact duplicates by two passes over Bloom filters.

Pass one drops every hash into two cells of a bit field and counts the hits of each cell. Cells hit at least
twice make up the filter of possibly repeated hashes. Pass two asks that filter: a row with a cell that was hit only
once has no equal anywhere and passes straight through; the others, the repeated rows and a few false alarms, shuffle
on their full digest and are decided exactly.

The filter is broadcast. Its size is bounded by ``max_filter_bytes`` whatever the input: past that bound cells fill up
and more rows shuffle, but the result stays the same. A text shared by a third of all rows collapses to one count per
task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlens.llm.bitfilter import MAX_FILTER_BYTES, ask, build, cells_for
from meterlens.llm.tables import hex_digest, lower_ascii
from meterlens.session import cut


def normal_text(text: Column) -> Column:
    """Null counts as empty; A-Z become lower case."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, h): the full digest and the 64-bit hash that probes the filters."""
    return documents.select(
        F.col(id_col).alias("doc_id"), hex_digest(normal_text(F.col(text_col))).alias("text_sha256")
    ).withColumn("h", F.xxhash64("text_sha256"))


def exact_groups(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is empty. The largest doc_id of a group is its
    ``keep_id``; null ids come last and only stay where a group has no other. Rows that share doc_id and text count
    one by one in ``group_size`` and are all ``kept`` or all dropped. An empty table gives an empty result.
    """
    light = cut(digests(documents, id_col, text_col))
    cells = cells_for(light.count(), max_filter_bytes)
    tested = ask(light, "h", build(light, "h", cells, least=2), cells, "suspect")
    single = tested.where(~F.col("suspect")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    suspects = tested.where("suspect").select("doc_id", "text_sha256")
    # Written first: both sides of the join are then plain exchanges, whose large partitions Spark splits.
    groups = cut(
        suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    decided = suspects.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return single.unionByName(decided)


def drop_exact_copies(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """The rows of ``documents`` that stay, all columns unchanged: of equal texts one row of the largest doc_id.

    Rows with a hash seen once are not shuffled. Of rows that share doc_id and text, one stays.
    """
    columns = documents.columns
    rows = documents.select(
        F.struct("*").alias("__row"),
        F.col(id_col).alias("__id"),
        hex_digest(normal_text(F.col(text_col))).alias("__sha"),
    ).withColumn("h", F.xxhash64("__sha"))
    hashes = cut(rows.select("h"))
    cells = cells_for(hashes.count(), max_filter_bytes)
    tested = ask(rows, "h", build(hashes, "h", cells, least=2), cells, "__suspect")
    single = tested.where(~F.col("__suspect")).select("__row")
    kept = (
        tested.where("__suspect")
        .groupBy("__sha")
        .agg(F.max_by("__row", F.struct("__id")).alias("__row"))
        .select("__row")
    )
    return single.unionByName(kept).select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])
