"""Near duplicates by 64-bit similarity hashes and deletion-variant signatures.

Fingerprints that differ in at most two bits are linked. Cut into two segments of 32 bits, at least one segment of
such a pair differs in at most one bit, so the two share a *one-wildcard variant* of that segment: the segment with
one bit position left out. Every distinct fingerprint is indexed under its 64 variants, an equality join brings
sharers together, and the whole fingerprints are verified inside the join.

A variant shared by more than ``CROWD`` fingerprints would emit too many pairs. Members of such a crowd are linked
another exact way: each is indexed under the 65 bit strings within one bit of it. Two fingerprints are within two bits
exactly if they have one of these in common, and by geometry no string has more than 65 owners, so linking each owner
to the smallest costs at most 65 rows a fingerprint, and no pair is lost.

Equal fingerprints collapse before any of this, so copies never meet each other as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from meterlens.llm.bitfilter import ask, build, cells_for
from meterlens.llm.components import components
from meterlens.llm.tables import hex64, small_batches
from meterlens.session import cut

SEED = 42
SHINGLE = 3
#: Most fingerprints under one variant that are compared pair by pair.
CROWD = 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned similarity hash of one text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], dtype="<u8"
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row, ``fp`` the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its 64 one-wildcard segment variants."""
    # The key holds the number of the variant (segment * 32 + wildcard) above the 32 bits of the segment.
    low, high = "(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"
    keys = ", ".join(
        f"transform(sequence(0, 31), i -> shiftleft(cast(i + {32 * s} AS BIGINT), 32)"
        f" | ({segment} & ~shiftleft(1L, i)))"
        for s, segment in enumerate((low, high))
    )
    return distinct.select(F.expr(f"explode(concat({keys}))").alias("key"), "fp")


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) with u < v: links whose closure joins exactly the fingerprints reachable over at most two bits."""
    index = variants(distinct)
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Merge joins: Spark takes the index for as small as the table it was exploded from, and the written rows for as
    # small as their files, and would broadcast either whole.
    busy = cut(index.join(shared.hint("merge"), "key"))
    few = busy.where(F.col("n") <= crowd).select("key", "fp")
    a, b = few.withColumnRenamed("fp", "u"), few.withColumnRenamed("fp", "v")
    pairs = a.join(
        b.hint("merge"),
        (a.key == b.key) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2),
    ).select("u", "v")
    crowded = busy.where(F.col("n") > crowd).select("fp").distinct()
    near = crowded.select(
        "fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))").alias("at")
    )
    stars = (
        near.groupBy("at")
        .agg(F.collect_set("fp").alias("owners"))
        .where(F.size("owners") > 1)
        .select(F.array_min("owners").alias("u"), F.explode("owners").alias("v"))
        .where("u < v")
    )
    return pairs.unionByName(stars).distinct()


def near_classes(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD
) -> DataFrame:
    """One row per input row: doc_id, fp, class_fp (least fingerprint of the class), component_id (least doc_id).

    Null and empty texts have fingerprint zero and are linked like any other. Null ids take part, and are a class's
    ``component_id`` only where it has no other id. An empty table gives an empty result.
    """
    with small_batches(documents.sparkSession):
        prints = cut(fingerprints(documents, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(distinct, crowd))
    classed = cut(
        distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("class_fp")
        )
    )
    ids = classed.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    return prints.join(classed.drop("least").join(ids, "class_fp"), "fp").select(
        "doc_id", "fp", "class_fp", "component_id"
    )


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row."""
    return near_classes(documents, id_col, text_col).select(
        "doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay: of each class one row of the smallest doc_id, all columns unchanged.

    Null ids come last. Where several rows hold a class's smallest id, the one with the least text hash stays; of rows
    that repeat id and text one stays. Null, empty and blank texts are one class. An empty table gives an empty result,
    and columns of any name pass through.

    Only rows of classes with more than one row shuffle with their texts: a filter of bounded size lets the others,
    whose class is theirs alone, pass straight through.
    """
    columns = documents.columns
    place = [
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("__id"),
        F.xxhash64(F.col(text_col)).alias("__h"),
    ]
    with small_batches(documents.sparkSession):
        keyed = cut(_with_prints(documents.select(*place, F.col(text_col).alias("__text"))))
    distinct = cut(keyed.groupBy("fp").agg(F.min(F.struct("__id", "__h")).alias("first"), F.count(F.lit(1)).alias("n")))
    member = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    placed = distinct.join(member, "fp", "left").withColumn("class_fp", F.coalesce("root", "fp"))
    classes = placed.groupBy("class_fp").agg(F.min("first").alias("first"), F.sum("n").alias("rows"))
    several = cut(placed.select("fp", "class_fp").join(classes.where("rows > 1"), "class_fp").select("fp", "first.*"))
    touched = cut(keyed.join(several.select("fp"), "fp").select(F.xxhash64("__id", "__h").alias("__k")).distinct())
    cells = cells_for(touched.count())
    rows = documents.select(F.struct("*").alias("__row"), *place).withColumn("__k", F.xxhash64("__id", "__h"))
    tested = ask(rows, "__k", build(touched, "__k", cells, least=1), cells, "__maybe")
    alone = tested.where(~F.col("__maybe")).select("__row")
    # Rows that only seem touched are the first of their own class, so they stay as well.
    kept = several.select("__id", "__h").distinct().withColumn("__stays", F.lit(True))
    in_class = touched.withColumn("__in", F.lit(True))
    decided = (
        tested.where("__maybe")
        .groupBy("__id", "__h", "__k")
        .agg(F.first("__row").alias("__row"))
        .join(in_class, "__k", "left")
        .join(kept, ["__id", "__h"], "left")
        .where("__in is null or __stays")
        .select("__row")
    )
    return alone.unionByName(decided).select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])


def _with_prints(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["__id", "__h", "fp"]
            )

    return rows.mapInArrow(run, "__id long, __h long, fp long")
