"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest permitted sequence, and each piece is placed whole. The pieces
are dealt into groups of bounded size by a hash, and each group is packed by itself: longest piece first, into the open
bin that it leaves the least room in. Where no bin has room, the size to open is chosen over all permitted lengths that
hold the piece: the one with the least cost for each token it is going to hold, given what is left to place. In the end
each bin shrinks to the shortest permitted length that holds its contents, and its open room is padding.

The cost of a sequence is linear in its length, plus a quadratic part for attention and a constant part for each
sequence, so neither many short nor few long sequences are best by themselves.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meterlens.session import cut


@dataclass(frozen=True)
class PackParams:
    #: Permitted sequence lengths, ascending.
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    #: Pieces that are packed together, on average; a group's memory follows from it.
    group: int = 20_000
    #: Cost of a sequence of c tokens: c + c * c / attention + fixed.
    attention: float = 8192.0
    fixed: float = 64.0

    def cost(self, capacity: int) -> float:
        return capacity + capacity * capacity / self.attention + self.fixed


def word_tokens(text: Column) -> Column:
    """Length of a text as a sequence: its words and one end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")) + 1).cast("long")


def pack(lengths: np.ndarray, p: PackParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece; the lengths lie between 1 and the longest capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[tuple[int, int]] = []  # (room left, bin) of open bins, ascending
    used: list[int] = []
    left = int(lengths.sum())
    costs = [(c, p.cost(c)) for c in p.capacities]
    for i in order.tolist():
        size = int(lengths[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, at = room.pop(k)
        else:
            # A bin holds what is left to place at most, and the piece at least.
            free = min((cost / min(c, left), c) for c, cost in costs if c >= size)[1]
            at = len(used)
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        left -= size
        if free > size:
            insort(room, (free - size, at))
    # Every bin takes the cheapest length that holds its contents: the shortest.
    shrunk = np.array(p.capacities)[np.searchsorted(p.capacities, np.array(used, dtype=np.int64))]
    return bins, offsets, shrunk[bins] if len(bins) else bins


def pack_documents(
    documents: DataFrame,
    length: Column | None = None,
    params: PackParams = PackParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, group, bin, offset, capacity.

    ``start`` is where the piece starts in its document and ``offset`` where it stands in its bin, both in tokens;
    (group, bin) names a sequence and ``capacity`` is its length. ``length`` gives a document's tokens, by default its
    words and an end token. Null and empty texts have the end token alone; documents of no tokens have no piece. Rows
    of equal doc_id are pieces of their own, and a null doc_id stays null. Packing is the same at every run: pieces of
    a group are taken by length, then doc_id, start and text hash. An empty table gives an empty result.
    """
    longest = params.capacities[-1]
    length = word_tokens(F.col(text_col)) if length is None else length
    pieces = cut(
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("n"), F.xxhash64(text_col).alias("th")
        )
        .where("n > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))))
        .select(
            "doc_id",
            "th",
            "piece",
            (F.col("piece") * longest).alias("start"),
            F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("length"),
        )
    )
    groups = max(1, -(-pieces.count() // params.group))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "th"], ascending=[False, True, True, True], kind="stable")
        rows["bin"], rows["offset"], rows["capacity"] = pack(rows.length.to_numpy(), params)
        return rows.drop(columns="th")

    # The place of a row among equals does not matter, so copies of a document may share a group.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "th", "piece", F.lit(3)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(
        run,
        "doc_id long, piece long, start long, length long, group long, bin long, offset long, capacity long",
    )


def waste(packed: DataFrame) -> DataFrame:
    """(capacity, sequences, tokens, padding): how full the sequences of each length are."""
    bins = packed.groupBy("group", "bin", "capacity").agg(F.sum("length").alias("tokens"))
    return bins.groupBy("capacity").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("capacity") - F.col("tokens")).alias("padding"),
    )
