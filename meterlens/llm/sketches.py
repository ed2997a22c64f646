"""Document fingerprints: threshold-scaled sketches of word shingles.

Every shingle of five words (lower-cased A-Z) has a 64-bit hash. A sketch keeps each hash below a fixed fraction of the
hash range, so its size follows the document's, and sketches of documents of very unequal length compare on equal
terms: the share of the smaller sketch that the larger one holds estimates how much of the smaller document the larger
one contains. The sketch of two texts together is the union of theirs.

A text so short that none of its hashes is kept is represented by its smallest hash; a text of fewer than five words
has one shingle, all of its words; a text without words has an empty sketch. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens.llm.tables import BLANKS, hex_digest, lower_ascii
from meterlens.session import cut

SHINGLE = 5
#: Hashes below 2**-KEEP_BITS of the range are kept.
KEEP_BITS = 3
#: Below the threshold this many bits of a hash are stored; a sole hash above it has up to KEEP_BITS more.
STORED_BITS = 48
NO_ID = -(2**63)
_SPACES = " \t\n\x0b\x0c\r"


def words(trimmed: Column) -> Column:
    """The words of a text without blanks at its ends: runs without space, tab, line feed, vertical tab, form feed
    and carriage return."""
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def with_sketch(rows: DataFrame, text_col: str, name: str, keep_bits: int = KEEP_BITS) -> DataFrame:
    """``rows`` with the sketch of a text column: an ascending array of stored hashes."""
    # One select after the other: each array is computed once, and Spark does not inline what is used repeatedly.
    trimmed = rows.withColumn("__t", F.btrim(lower_ascii(F.col(text_col)), F.lit(_SPACES)))
    hashed = trimmed.withColumn("__w", F.transform(words(F.col("__t")), lambda w: F.xxhash64(w))).drop("__t")
    at = lambda i, k: F.get(F.col("__w"), i + k)
    shingled = hashed.withColumn(
        "__s",
        F.when(
            F.size("__w") >= SHINGLE,
            F.transform(
                F.sequence(F.lit(0), F.size("__w") - SHINGLE),
                lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]),
            ),
        )
        .when(F.size("__w") > 0, F.array(F.xxhash64("__w")))
        .otherwise(F.array().cast("array<bigint>")),
    )
    kept = shingled.withColumn(
        "__k", F.filter("__s", lambda h: F.shiftrightunsigned(h, 64 - keep_bits) == 0)
    )
    # Flipping the sign bit makes the signed minimum the unsigned one.
    flip = F.lit(-(2**63))
    least = F.array_min(F.transform("__s", lambda h: h.bitwiseXOR(flip))).bitwiseXOR(flip)
    stored = F.when((F.size("__k") == 0) & (F.size("__s") > 0), F.array(least)).otherwise(F.col("__k"))
    return kept.withColumn(
        name,
        F.array_sort(
            F.array_distinct(F.transform(stored, lambda h: F.shiftrightunsigned(h, 64 - STORED_BITS - keep_bits)))
        ),
    ).drop("__w", "__s", "__k")


def sketch_text(sketch: Column) -> Column:
    """A sketch as a string, 13 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 13, "0"))), "")


def contained(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document that the larger one contains, 0 to 1; two empty sketches are alike."""
    smaller = F.least(F.size(a), F.size(b))
    return (
        F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller)
        .when(F.size(a) == F.size(b), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def merged(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """The sketch of two texts' shingles together, as if sketched at once."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: F.shiftright(h, STORED_BITS) == 0)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sketch): one row per input row; null texts are empty."""
    return _keyed(documents, id_col, text_col).select(_id().alias("doc_id"), "text", "sketch")


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text, sketch): the key is the doc_id, or ``NO_ID`` for null."""
    rows = documents.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return with_sketch(rows, "text", "sketch")


def _id() -> Column:
    return F.when(F.col("key") != NO_ID, F.col("key"))


def before(ids: DataFrame) -> DataFrame:
    """(key, n) with unique keys -> (key, prev_key, prev_n): the row before in ascending order, the last before the first.

    The keys are range-partitioned and each partition orders its own; the first row of a partition gets the last row
    of the one before from a table of one row per partition.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("key")
    edges = ranged.groupBy("part").agg(F.max(F.struct("key", "n")).alias("last"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(everything)).alias("edge"))
    return (
        ranged.withColumn("prev", F.lag(F.struct("key", "n")).over(inside))
        .join(F.broadcast(edges), "part")
        .withColumn("prev", F.coalesce("prev", "edge"))
        .select("key", F.col("prev.key").alias("prev_key"), F.col("prev.n").alias("prev_n"))
    )


def edited_and_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its sketch, its edited text, that text's sketch, and the sketch of the next document.

    Columns: doc_id, text, sketch, next_sketch, edited, edited_sketch. The edited text has its last
    ``floor(n / 4)`` of ``n`` code points replaced by as many first ones (or all) of the next document by ascending
    doc_id; the first follows the last. Null texts are empty. A null doc_id counts as the smallest integer (which is read as null). Rows that
    share a doc_id have the same next document; where several rows hold the next doc_id, the one with the least text
    hash is taken. An empty table gives an empty result.
    """
    # Both joins below use the same columns of it, so it is sketched and shuffled once.
    base = _keyed(documents, id_col, text_col)
    ids = (
        documents.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
            F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).alias("n"),
        )
        .groupBy("key")
        .agg(F.max("n").alias("n"))
    )
    # A document gives the one before it no more of its text than that one can use.
    heads = (
        base.join(before(ids), "key")
        .select(
            F.col("prev_key").alias("key"),
            F.struct(
                F.xxhash64("text").alias("h"),
                F.expr("left(text, prev_n div 4)").alias("head"),
                F.col("sketch").alias("next_sketch"),
            ).alias("next"),
        )
        .groupBy("key")
        .agg(F.min("next").alias("next"))
    )
    rows = base.join(heads, "key").select(
        _id().alias("doc_id"),
        "text",
        "sketch",
        F.col("next.next_sketch").alias("next_sketch"),
        F.concat(
            F.expr("left(text, char_length(text) - char_length(text) div 4)"),
            F.expr("left(next.head, cast(char_length(text) div 4 AS INT))"),
        ).alias("edited"),
    )
    return with_sketch(rows, "edited", "edited_sketch")


def fingerprint_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    return edited_and_next(documents, id_col, text_col).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        hex_digest(F.col("edited")).alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        contained(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        contained(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
