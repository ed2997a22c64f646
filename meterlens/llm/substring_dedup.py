"""Repeated passages, removed wherever a document of smaller id has them too.

A passage counts when 50 consecutive words (a window) also start in a document with a smaller doc_id. The reference is
the corpus itself, so it cannot be broadcast whole; it is cut into shards that meet just the text they can match:

1. *Anchors.* Of the 8-word shingles of a window the one with the least hash is its anchor. Equal windows have equal
   anchors, so a window can only be repeated in documents that share its anchor. Consecutive windows mostly share one,
   so a text has about one anchor in 22 words. The windows that chose an anchor are its *context*. Each is written
   down with a hash of its words; the words stay where they are. A context that a text repeats is one row with all its
   places.
2. *Sharing.* Anchors of one document alone, nearly all, are dropped by a map-side aggregation. Of equal contexts the
   first document keeps its own and all later ones are repeated whole, decided by a hash join.
3. *Automata.* Where an anchor has different contexts (the ends of passages, edited copies), these are gathered in
   reference shards of bounded size. A shard's task reads its contexts by ascending doc_id, streams each through the
   suffix automaton of those before it, takes the maximal spans matched over 50 words or more, and then adds it. Of a
   context only the runs take part whose shingles all stand in another document's context of that anchor.
   An anchor with more than ``CROWD`` contexts would fill a shard: its windows are compared by their hashes in an
   aggregation instead, which spreads any number of them.
4. *Removal.* The spans go back to their documents. Only documents with spans are shuffled with their texts; a
   bounded Bloom filter tells them from the rest, which pass straight through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens.llm import bitfilter
from meterlens.llm.automaton import SuffixAutomaton, spans_above
from meterlens.llm.tables import small_batches
from meterlens.llm.wordhash import joined, mixed, parts, ranges
from meterlens.session import cut

WINDOW = 50
SHINGLE = 8
#: Contexts of one anchor that go to an automaton.
CROWD = 64
#: Contexts in a reference shard, on average; no shard holds more than a few times as many.
SHARD = 400
#: Words hashed and searched for anchors at a time.
PIECE = 1 << 20
NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the hash base modulo 2**64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (_powers(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def _powers(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Rolling:
    """Hashes of runs of a document's words."""

    def __init__(self, words: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.to(len(words) + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words[start:end] for arrays of bounds."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchor_runs(rolling: Rolling, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, lo, hi) of anchors: the windows that start at lo to hi have theirs at ``position``.

    The anchor is the shingle with the least hash, the leftmost of equals. ``windows`` are ascending starts.
    """
    inside = WINDOW - SHINGLE + 1
    picks = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(rolling.sums), PIECE):
        some = windows[slice(*np.searchsorted(windows, (at, at + PIECE)))]
        if not len(some):
            continue
        where = np.arange(some[0], some[-1] + inside)
        h = rolling.runs(where, where + SHINGLE)
        # The low bits hold the position, so that the least of equal hashes is the leftmost.
        least = (h >> np.uint64(21) << np.uint64(21)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= inside:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < inside:
            least = np.minimum(least[: width - inside], least[inside - width :])
        picks.append((least[some - some[0]] & np.uint64((1 << 21) - 1)).astype(np.int64) + some[0])
    pick = np.concatenate(picks)
    first = np.flatnonzero(np.diff(pick, prepend=-1))
    last = np.append(first[1:], len(pick))[: len(first)] - 1
    position = pick[first]
    return rolling.runs(position, position + SHINGLE), position, windows[first], windows[last]


def anchors(words: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the anchors of all windows of a text."""
    return anchor_runs(rolling, np.arange(max(0, len(words) - WINDOW + 1)))[:2]


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, th, text): ``id`` orders (a null doc_id is the smallest), ``id`` and ``th`` name a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return documents.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")
    )


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(joined(lengths), pa.int32()), pa.array(values, pa.int32()))


def occurrences(documents: DataFrame) -> DataFrame:
    """(anchor, ctx, id, th, size, starts): the anchors of each (id, th, text), a row for each distinct context.

    ``size`` is the context's number of words, ``starts`` are its places in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, words, bounds in (part for batch in batches for part in parts(batch, "text")):
            rolling = Rolling(words, powers)
            windows = ranges(bounds[:-1], np.maximum(np.diff(bounds) - WINDOW + 1, 0))
            anchor, position, start, hi = anchor_runs(rolling, windows)
            end = hi + WINDOW
            # The place of the anchor belongs to the context.
            ctx = mixed(rolling.runs(start, end) + (position - start).astype(np.uint64))
            text = np.searchsorted(bounds, start, side="right") - 1
            order = np.lexsort((ctx, text))
            t, c = text[order], ctx[order]
            new = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(c, prepend=c[:1]) != 0))
            of, times = order[new], np.diff(np.append(new, len(order)))
            ids, ths = (rows.column(k).to_numpy()[text[of]] for k in ("id", "th"))
            yield pa.RecordBatch.from_arrays(
                [
                    *map(pa.array, (anchor[of].view(np.int64), ctx[of].view(np.int64), ids, ths)),
                    pa.array(end[of] - start[of], pa.int32()),
                    _lists(start[order] - bounds[t], times),
                ],
                ["anchor", "ctx", "id", "th", "size", "starts"],
            )

    return documents.select("id", "th", "text").mapInArrow(
        run, "anchor long, ctx long, id long, th long, size int, starts array<int>"
    )


def _contexts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words of the wanted contexts (id, th, anchor, size, starts, crowded).

    A row per context (words as bytes of 64-bit hashes), or for crowded anchors a row per window (its hash), with the
    places of either.
    """
    per_text = wanted.groupBy("id", "th").agg(
        F.collect_list(F.struct("anchor", "size", "starts", "crowded")).alias("wanted")
    )
    rows = documents.select("id", "th", "text").join(per_text, ["id", "th"]).select("id", "th", "text", "wanted")
    names = ["anchor", "id", "th", "starts", "words", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, words, bounds in (part for batch in batches for part in parts(batch, "text")):
            asked = rows.column("wanted")
            text = np.repeat(np.arange(rows.num_rows), asked.value_lengths().to_numpy())
            anchor, size, starts, crowded = asked.flatten().flatten()
            anchor, size = anchor.to_numpy(), size.to_numpy().astype(np.int64)
            crowded = crowded.to_numpy(zero_copy_only=False)
            places, places_of = starts.flatten().to_numpy(), joined(starts.value_lengths().to_numpy())
            at = bounds[text] + places[places_of[:-1]]
            ids, ths = (rows.column(k).to_numpy()[text] for k in ("id", "th"))

            of = np.flatnonzero(~crowded)
            times = np.diff(places_of)[of]
            held = words[ranges(at[of], size[of])]
            columns = [
                *map(pa.array, (anchor[of], ids[of], ths[of])),
                _lists(places[ranges(places_of[of], times)], times),
                pa.Array.from_buffers(
                    pa.binary(), len(of), [None, *map(pa.py_buffer, ((8 * joined(size[of])).astype(np.int32), held))]
                ),
                pa.nulls(len(of), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

            # A row per window of a crowded context; its places are the context's, moved by the window's.
            of = np.flatnonzero(crowded)
            inside = size[of] - WINDOW + 1
            moved = ranges(np.zeros(len(of), dtype=np.int64), inside)
            of = np.repeat(of, inside)
            times = np.diff(places_of)[of]
            start = at[of] + moved
            hashes = Rolling(words, powers).runs(start, start + WINDOW).view(np.int64)
            columns = [
                *map(pa.array, (anchor[of], ids[of], ths[of])),
                _lists(places[ranges(places_of[of], times)] + np.repeat(moved, times), times),
                pa.nulls(len(of), pa.binary()),
                pa.array(hashes),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "anchor long, id long, th long, starts array<int>, words binary, window long")


def _long_runs(flags: np.ndarray) -> zip:
    """(start, end) of the runs of words whose shingles are all flagged, where they hold a window."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2] + SHINGLE - 1
    long = end - start >= WINDOW
    return zip(start[long].tolist(), end[long].tolist())


def candidate_runs(
    words: np.ndarray, ends: np.ndarray, ids: np.ndarray, anchor: np.ndarray
) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of words that may hold windows of smaller ids, and runs that larger ids may ask for.

    The contexts end at ``ends`` and come by ascending id. A window that stands in two contexts of an anchor has all its
    shingles there, so the runs hold it whole in both.
    """
    where = ranges(np.append(0, ends[:-1]), np.diff(ends, prepend=0) - SHINGLE + 1)
    of = np.searchsorted(ends, where, side="right")
    key = Rolling(words, Powers()).runs(where, where + SHINGLE) ^ mixed(anchor[of].astype(np.int64).view(np.uint64))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    times = np.diff(np.append(first, len(order)))
    by_id = ids[of]
    earlier, later = np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
    earlier[where[order]] = np.repeat(by_id[order[first]], times) < by_id[order]
    later[where[order]] = np.repeat(by_id[order[first + times - 1]], times) > by_id[order]
    return list(_long_runs(earlier)), list(_long_runs(later))


def _match_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Spans of each context that stand in contexts of smaller ids of the same shard."""
    shard = shard.sort_values("id", kind="stable")
    ids, ths, starts = shard.id.to_numpy(), shard.th.to_numpy(), shard.starts.to_numpy()
    ends = np.cumsum(shard.words.str.len().to_numpy(dtype=np.int64) // 8)
    words = np.frombuffer(b"".join(shard.words), dtype=np.uint64)
    asked, kept = candidate_runs(words, ends, ids, shard.anchor.to_numpy())
    # By id, a document's own runs are asked for before they are added.
    runs = [(k, a, b) for k, some in enumerate((asked, kept)) for a, b in some]
    of = np.searchsorted(ends, np.array([a for _, a, _ in runs], dtype=np.int64), side="right")
    automaton, found = SuffixAutomaton(), []
    for _, k, a, b, c in sorted((ids[c], k, a, b, c) for (k, a, b), c in zip(runs, of.tolist())):
        run = words[a:b].tolist()
        matches = automaton.matches(run)
        if k:
            if matches[-1] < len(run):
                automaton.add(run)
            continue
        a -= int(ends[c - 1]) if c else 0
        found += [(ids[c], ths[c], p + a + s, p + a + e) for s, e in spans_above(matches, WINDOW) for p in starts[c]]
    return pd.DataFrame(found, columns=["id", "th", "start", "end"]).astype(
        {"id": "int64", "th": "int64", "start": "int32", "end": "int32"}
    )


def _maybe_in(rows: DataFrame, name: str, members: DataFrame, flag: str, max_filter_bytes: int) -> DataFrame:
    """``rows`` and whether column ``name`` may be in the column of the same name of ``members``."""
    hashes = members.select(name).distinct()
    cells = bitfilter.cells_for(hashes.count(), max_filter_bytes)
    return bitfilter.ask(rows, name, bitfilter.build(hashes, name, cells, least=1), cells, flag)


def repeated_spans(
    keyed: DataFrame, crowd: int = CROWD, shard: int = SHARD, max_filter_bytes: int = bitfilter.MAX_FILTER_BYTES
) -> DataFrame:
    """(id, th, spans) for every text with words to remove; spans are (start, end) of words, ascending, may overlap."""
    with small_batches(keyed.sparkSession):
        found = cut(occurrences(keyed))
    shared = cut(
        found.groupBy("anchor")
        .agg(*[f(c).alias(f"{n}_{c}") for c in ("id", "ctx") for n, f in (("lo", F.min), ("hi", F.max))])
        .where("lo_id < hi_id")
        .select("anchor", (F.col("lo_ctx") != F.col("hi_ctx")).alias("differ"))
    )
    busy = cut(
        _maybe_in(found, "anchor", shared, "__maybe", max_filter_bytes)
        .where("__maybe")
        .drop("__maybe")
        .join(shared, "anchor")
    )
    classes = cut(
        busy.groupBy("anchor", "ctx").agg(
            F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("differ").alias("mixed")
        )
    )
    # Equal contexts: the first document's stands, later ones are repeated whole.
    again = classes.where("first_id < last_id").select("anchor", "ctx", "first_id")
    whole = (
        busy.join(again, ["anchor", "ctx"])
        .where(F.col("id") > F.col("first_id"))
        .select("id", "th", F.explode("starts").alias("start"), "size")
        .select("id", "th", "start", (F.col("start") + F.col("size")).cast("int").alias("end"))
    )
    # Different contexts of one anchor: those of each first document are compared.
    crowds = cut(classes.where("mixed").groupBy("anchor").agg((F.count(F.lit(1)) > crowd).alias("crowded")))
    mixed = cut(classes.where("mixed").select("anchor", "ctx", "first_id").join(crowds, "anchor"))
    wanted = cut(
        busy.where("differ")
        .join(mixed, ["anchor", "ctx"])
        .where("id = first_id")
        .select("id", "th", "anchor", "size", "starts", "crowded")
    )
    owners = _maybe_in(keyed, "th", wanted, "__maybe", max_filter_bytes).where("__maybe")
    with small_batches(keyed.sparkSession):
        contexts = cut(_contexts(owners, wanted))
    plain = contexts.where("words is not null")
    shards = max(1, -(-plain.count() // shard))
    matched = (
        plain.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(
            lambda rows: _match_shard(rows), "id long, th long, start int, end int"
        )
    )
    windows = contexts.where("window is not null").select("window", "id", "th", "starts")
    least = cut(windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"))
    crowded = (
        windows.join(least, "window")
        .where("id > least")
        .select("id", "th", F.explode("starts").alias("start"))
        .withColumn("end", (F.col("start") + WINDOW).cast("int"))
    )
    # Written apart: the joins' stages then hold nothing that keeps Spark from splitting a hot key.
    spans = cut(whole).unionByName(matched).unionByName(cut(crowded))
    return cut(
        spans.groupBy("id", "th")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    )


def _with_spans(
    documents: DataFrame, id_col: str, text_col: str, crowd: int, shard: int, max_filter_bytes: int
) -> DataFrame:
    """(doc_id, text, spans): spans null where nothing is repeated."""
    keyed = _keyed(documents, id_col, text_col)
    spans = repeated_spans(keyed, crowd, shard, max_filter_bytes)
    asked = _maybe_in(keyed, "th", spans, "__maybe", max_filter_bytes)
    touched = asked.where("__maybe").join(spans, ["id", "th"], "left").select("doc_id", "text", "spans")
    kind = spans.schema["spans"].dataType
    return touched.unionByName(
        asked.where("not __maybe").select("doc_id", "text", F.lit(None).cast(kind).alias("spans"))
    )


def kept_words(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], int]:
    """The words outside the spans, which ascend by start, and the number of all words."""
    words = text.split()
    if not len(start):
        return words, len(words)
    # Spans that meet are one.
    reach = np.maximum.accumulate(end)
    apart = np.flatnonzero(start[1:] > reach[:-1])
    gaps = zip([0, *reach[apart].tolist(), int(reach[-1])], [int(start[0]), *start[apart + 1].tolist(), len(words)])
    return [w for a, b in gaps for w in words[a:b]], len(words)


def remove_repeats(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    crowd: int = CROWD,
    shard: int = SHARD,
    max_filter_bytes: int = bitfilter.MAX_FILTER_BYTES,
) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row; the text is what stays, its words joined by one space.

    Windows are judged on the input, not on what is left. Null texts have no words. A null doc_id is smaller than all
    others. Rows of one doc_id do not remove each other's words. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            at = joined(spans.value_lengths().fill_null(0).to_numpy())
            start, end = (c.to_numpy() for c in spans.flatten().flatten())
            texts, n, kept = [], [], []
            for text, a, b in zip(batch.column("text").cast(pa.large_binary()), at, at[1:]):
                words, count = kept_words(text.as_py(), start[a:b], end[a:b])
                texts.append(b" ".join(words))
                n.append(count)
                kept.append(len(words))
            n, kept = np.array(n, dtype=np.int64), np.array(kept, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n), pa.array(n - kept)],
                ["doc_id", "text", "n_words", "n_removed"],
            )

    rows = _with_spans(documents, id_col, text_col, crowd, shard, max_filter_bytes)
    return rows.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def repeat_digests(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return remove_repeats(documents, **settings).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
