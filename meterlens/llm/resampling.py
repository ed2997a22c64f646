"""Target-distribution importance resampling over hashed word n-grams.

A text's features are its runs of one and of two consecutive words, dropped into a fixed number of buckets. The raw
and the target corpus are two bucket histograms; a bucket's gain is the logarithm of how much likelier the target
draws it, a text's weight the mean gain of its features, and the texts with the highest weight plus Gumbel noise are
a draw without replacement in proportion to the weights.

Words are cut on the bytes: a 256-byte table lower-cases A-Z and blanks every separator, ``bytes.split`` gives the
words, and the checksum of a word is the seed that the next word extends, so no n-gram is ever put together. Tasks
reduce their features to one counter of at most ``buckets`` entries before anything shuffles. The two histograms are
all that reaches the driver, and the gains all that is sent back: their size is that of the parameter, whatever the
corpus.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlens.llm.tables import small_batches
from meterlens.session import cut

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: What each byte of UTF-8 becomes: A-Z small, digits, a-z and all bytes of other scripts unchanged, the rest blank.
TABLE = bytes(b if b in _KEPT or b >= 0x80 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))
#: Bytes of a long text that are cut into words at a time.
SLICE = 1 << 20


@dataclass(frozen=True)
class ResampleParams:
    buckets: int = 10_000
    #: Percent of the documents with enough words that are drawn.
    percent: int = 25
    min_words: int = 20
    #: Stands before the id in the hash that makes the noise.
    salt: str = "7:"


def _slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in order, in lists that come from ``SLICE`` bytes or one longer word."""
    raw = text.encode().translate(TABLE)
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def feature_sums(text: str | None) -> Iterator[tuple[int, list[int]]]:
    """(words, checksums of the one- and two-word runs that end in them) for each slice of a text."""
    crc, last = zlib.crc32, None
    for words in _slices(text or ""):
        if not words:
            continue
        ones = list(map(crc, words))
        # The checksum so far is the seed of the blank, and that the seed of the next word.
        seeds = list(map(crc, repeat(b" "), ones if last is None else [last, *ones]))
        twos = list(map(crc, words[1:] if last is None else words, seeds))
        last = ones[-1]
        yield len(words), ones + twos


def _bucket_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    found: Counter[int] = Counter()
    for batch in batches:
        for text in batch.column(0):
            for _, sums in feature_sums(text.as_py()):
                found.update((np.array(sums, dtype=np.uint32) % np.uint32(buckets)).tolist())
    yield pa.RecordBatch.from_pydict(
        {"bucket": pa.array(list(found), pa.int32()), "n": pa.array(list(found.values()), pa.int64())}
    )


def histogram(texts: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; null texts and empty tables have none."""
    per_task = texts.select(F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _bucket_rows(batches, buckets), "bucket int, n long"
    )
    counts = np.zeros(buckets, dtype=np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p/q)) of every bucket, with one added to each count of target (p) and raw (q)."""
    size, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = (
        (float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size))
        for s, t in zip(raw.tolist(), target.tolist())
    )
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: int | None, salt: str) -> int:
    """floor(1000 g) of a Gumbel draw g that depends on the id alone; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    documents: DataFrame, gain: np.ndarray, salt: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight (mean gain, floored) and score (weight and noise) of every row."""
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "n_words": [], "n_features": [], "weight": [], "score": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = features = total = 0
                for n, sums in feature_sums(text.as_py()):
                    words, features = words + n, features + len(sums)
                    total += int(gain[np.array(sums, dtype=np.uint32) % buckets].sum())
                weight = total // features if features else 0
                for name, value in zip(out, (doc_id, words, features, weight, weight + noise(doc_id, salt))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(weighed: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``weighed`` (a written table) with ``rank``: 1, 2, 3... for the drawn rows, null for the others.

    Scores are whole numbers in a narrow range (gains and noise are logarithms), so one count per score says how many
    rows stand before each, and only rows of one score are ever put in order together. Ties go to the smaller doc_id,
    null ids last; rows that repeat an id take consecutive ranks.
    """
    long_enough = weighed.where(F.col("n_words") >= min_words)
    levels = long_enough.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per score, so the window without keys holds a bounded table.
    before = cut(levels.select("score", "n", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before")))
    wanted = (before.agg(F.sum("n")).first()[0] or 0) * percent // 100
    reached = before.where(F.col("before") < wanted).select("score", "before")
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = long_enough.join(F.broadcast(reached), "score").withColumn(
        "rank", F.col("before") + F.row_number().over(inside)
    )
    columns = [*weighed.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")]
    lowest = reached.agg(F.min("score")).first()[0]
    beyond = F.lit(True) if lowest is None else (F.col("n_words") < min_words) | (F.col("score") < lowest)
    rest = weighed.where(beyond).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest)


def resample(
    documents: DataFrame,
    target: DataFrame,
    params: ResampleParams = ResampleParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank.

    ``rank`` numbers the drawn documents from the highest score and is null for the others; the operator draws
    ``percent`` of the documents with ``min_words`` words. Null and empty texts have no feature and weight 0. Rows that
    repeat an id or a text count one by one. Long texts are read whole, a slice at a time. Without documents the
    result is empty, without target texts every bucket's target count is 0. Other columns of any name are not read.
    """
    with small_batches(documents.sparkSession):
        raw = histogram(documents, params.buckets, text_col)
        gain = gains(raw, histogram(target, params.buckets, target_col))
        weighed = cut(weigh(documents, gain, params.salt, id_col, text_col))
    return draw(weighed, params.percent, params.min_words)


def drawn_documents(
    documents: DataFrame,
    target: DataFrame,
    params: ResampleParams = ResampleParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``documents`` that are drawn, all columns unchanged.

    Rows that repeat an id come or go together only if all of them are drawn; ids are meant to be unique here.
    """
    rank = resample(documents, target, params, id_col, text_col).where("rank is not null")
    ids = rank.select(F.col("doc_id").alias("__id")).distinct()
    return documents.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_semi")
