"""Exact similarity join of texts by the Jaccard overlap of their word shingles.

Every set of shingle hashes is a sorted array. Two sets link if their overlap is at least ``percent`` of their union.

*Tiles.* Sets that link share a shingle among the first few of any order that is the same for all sets (for 80 percent,
a fifth of the set and one more). Sets meet in the tiles of those shingles, and within them by size band: a band's
sizes differ by no more than two linked sets may, so a tile holds the sets of one band and, as visitors, those of the
band below. Tiles of more than ``TILE`` rows are cut into blocks that meet block by block.

*Signatures.* In a tile each set is a bitmap into which its shingles are hashed; the size follows the band. A bit that
only one of two sets has stands for a shingle that the other has not, so bit counts bound the overlap from above.

*Clusters.* A tile does not name its pairs within the bound, whose number is the square of a family's size, but says which
of its sets they connect: at most one row per set. The components of all tiles' rows are clusters, and linked sets
lie in one. The sorted arrays of a cluster meet in blocks of bounded size, where all its pairs of different components
are decided; a block names at most one link per set.

*Common shingles.* The order puts rare shingles first: those that several sets have near their start go behind all
others, so a set whose shared passages are less than four fifths of it meets no other. The shared ones are kept as a
bitmap of bounded size (where they are too many, only the more common of them); its false alarms only change the
order, which stays the same for all. Sets that consist of crowded shingles for the most part are families of edited
copies. They are linked first, in blocks of bounded size and a few speakers per component and round; after that only
pairs of different components are compared, so a large family does not meet itself pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterlens.llm.bitfilter import BITMAP_BITS, MAX_FILTER_BYTES, ask, build, cells_for
from meterlens.llm.components import components
from meterlens.llm.tables import small_batches
from meterlens.session import cut

SEED = 42
#: Most sets that share a leading shingle without counting as a crowd.
CROWD = 32
#: Rows on each side of a tile.
TILE = 512
#: Shingles and sets in a block of a family.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 18, 1024
#: Sets that speak for a component in a round of linking a family, and how often one pair of components is tried.
SPEAKERS, TRIES = 4, 8
#: Rounds of linking families, which end when one joins fewer than one speaker in ``ENOUGH``. What they leave apart is
#: compared in tiles.
ROUNDS, ENOUGH = 6, 20
#: Bits of a bitmap of shingles for each shingle, and at most.
SPARE, MAX_CELLS = 8, MAX_FILTER_BYTES * 8
#: Weight of the tiles that one Python call takes: a row counts 100 and its shingles.
CALL = 8_000_000


@dataclass(frozen=True)
class JaccardParams:
    shingle: int = 5
    percent: int = 80
    crowd: int = CROWD
    tile: int = TILE

    def first(self, n: int) -> int:
        """How many leading shingles of a set of ``n`` must be looked at."""
        return n - -(-self.percent * n // 100) + 1

    def band(self, n: Column) -> Column:
        """Sizes of linked sets lie in one band or in neighbouring ones."""
        return F.floor(F.log(n) / math.log(self.width)).cast("int")

    @property
    def width(self) -> float:
        # A little wider than needed, so that rounding cannot part two linked sizes.
        return 101 / self.percent

    def bits(self, band: int) -> int:
        """Bits of a signature in tiles of this band: two for each shingle of its largest set, or more."""
        return 1 << max(6, math.ceil(math.log2(2 * self.width ** (band + 1))))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = ends[min(size, len(words)) - 1 :].tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last)], dtype=np.uint64))


def _lists(batch_column: pa.Array) -> Iterator[np.ndarray]:
    """The arrays of a list column as unsigned numbers, without copies."""
    offsets = batch_column.offsets.to_numpy()
    values = batch_column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield values[a:b]


def shingle_sets(
    documents: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, node, grams) of every row. ``node`` is a 64-bit hash of the set, ``grams`` its sorted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            nodes = np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in sets], dtype=np.uint64)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            made = [pa.array([len(g) for g in sets], pa.int64()), pa.array(nodes.view(np.int64))]
            made.append(pa.ListArray.from_arrays(ends, flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n", "node", "grams"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, node long, grams array<bigint>")


def _perhaps(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """All rows whose node is in ``nodes`` (a written table of distinct ones), and a few others; none is shuffled."""
    cells = cells_for(nodes.count())
    return ask(rows, "node", build(nodes, "node", cells, least=1), cells, "maybe").where("maybe").drop("maybe")


def distinct_sets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, grams) of every set once, and (node, least) with the smallest doc_id that has it.

    Only sets that several documents have are shuffled.
    """
    least = cut(
        raw.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )
    again = cut(least.where("copies > 1").select("node"))
    cells = cells_for(again.count())
    held = raw.where("n > 0").select("node", "n", "grams")
    tested = ask(held, "node", build(again, "node", cells, least=1), cells, "maybe")
    folded = cut(tested.where("maybe").groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams")))
    return tested.where(~F.col("maybe")).drop("maybe").unionByName(folded), least.drop("copies")


class ShingleBits:
    """A set of shingles as a bitmap of bounded size that tasks can ask; it may hold others besides."""

    def __init__(self, spark: SparkSession, tokens: DataFrame, count: int):
        wanted = max(BITMAP_BITS, SPARE * count)
        cells = min(1 << (wanted - 1).bit_length(), MAX_CELLS)
        cell = F.col("token").bitwiseAND(F.lit(cells - 1)) + 1
        bitmaps = (
            tokens.select(cell.alias("cell"))
            .groupBy(F.bitmap_bucket_number("cell").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
        )
        bits = np.zeros(cells // 8, dtype=np.uint8)
        for r in bitmaps.collect():
            at = (r.bucket - 1) * (BITMAP_BITS // 8)
            bits[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        self.mask, self.bits = cells - 1, spark.sparkContext.broadcast(bits)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        cell = grams & np.uint64(self.mask)
        byte = self.bits.value[(cell >> np.uint64(3)).astype(np.int64)]
        return (byte >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _leading(grams: np.ndarray, common: ShingleBits, count: int) -> np.ndarray:
    """The first shingles of a set: by hash, the common ones behind all others."""
    late = common.holds(grams)
    return np.concatenate((grams[~late][:count], grams[late]))[:count]


def _tokens(sets: DataFrame, pick) -> DataFrame:
    """(token, node, n): the shingles that ``pick`` takes from each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = [pick(g) for g in _lists(batch.column(2))]
            each = np.repeat(np.arange(len(taken)), [len(t) for t in taken])
            flat = np.concatenate([np.empty(0, np.uint64), *taken]).view(np.int64)
            node, n = batch.column(0).take(pa.array(each)), batch.column(1).take(pa.array(each))
            yield pa.RecordBatch.from_arrays([pa.array(flat), node, n], ["token", "node", "n"])

    return sets.select("node", "n", "grams").mapInArrow(run, "token long, node long, n long")


def prefix_index(sets: DataFrame, params: JaccardParams) -> DataFrame:
    """(token, df, node, n), written: the leading shingles that at least two sets have there, ``df`` many."""
    spark = sets.sparkSession
    # Twice the needed length: where up to half of a set is shared, the leading others were looked at here.
    near = _tokens(sets, lambda g: g[: 2 * params.first(len(g))])
    often = cut(near.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # Rarer shingles stay in front if the bitmap cannot hold all that are shared.
    levels = often.groupBy(F.floor(F.log2("df")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    level, held = 64, 0
    for r in sorted(levels, reverse=True):
        if SPARE * (held + r.n) > MAX_CELLS:
            break
        level, held = r.level, held + r.n
    common = ShingleBits(spark, often.where(F.floor(F.log2("df")) >= level).select("token"), held)
    lead = lambda g: _leading(g, common, params.first(len(g)))
    shared = cut(_tokens(sets, lead).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    busy = ShingleBits(spark, shared.select("token"), shared.count())

    def pick(grams: np.ndarray) -> np.ndarray:
        leading = lead(grams)
        return leading[busy.holds(leading)]

    return cut(_tokens(sets, pick).join(shared, "token").select("token", "df", "node", "n"))


def signatures(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One bitmap of ``bits`` bits (a power of two) per set, as rows of 64-bit words."""
    out = np.zeros((len(sets), bits // 8), dtype=np.uint8)
    for row, grams in zip(out, sets):
        cell = (grams >> np.uint64(20)) & np.uint64(bits - 1)
        np.bitwise_or.at(row, (cell >> np.uint64(3)).astype(np.int64), np.left_shift(1, cell & np.uint64(7)).astype(np.uint8))
    return out.view(np.uint64)


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """For each set of ``a`` (rows) and of ``b`` (columns): whether sizes and signatures allow a link."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    step = max(1, (1 << 20) // max(1, b.size))
    for at in range(0, len(a), step):
        x, n = a[at : at + step, None, :], na[at : at + step, None]
        # A bit that only one set has is a shingle that the other lacks.
        most = np.minimum(
            n - np.bitwise_count(x & ~b).sum(axis=2, dtype=np.int64),
            nb - np.bitwise_count(b & ~x).sum(axis=2, dtype=np.int64),
        )
        sized = 100 * np.minimum(n, nb) >= percent * np.maximum(n, nb)
        out[at : at + step] = sized & ((100 + percent) * most >= percent * (n + nb))
    return out


def links_exactly(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays overlap enough, by their intersection."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _joining(
    grams: pd.Series, root: np.ndarray, percent: int, tries: int | None = None, role: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Positions of linked sets, one pair for each two components (``root``, and then what was joined) that become one.

    With ``tries`` a set is compared with no more members of a component, so some links may be missed; with ``role``
    only probes (2) and targets (1) are compared.
    """
    sets = [np.asarray(g, dtype=np.int64).view(np.uint64) for g in grams]
    order = np.argsort([len(g) for g in sets], kind="stable")
    sets = [sets[i] for i in order]
    label = pd.factorize(root[order])[0]
    probe, target = (True, True) if role is None else (role[order] & 2 > 0, role[order] & 1 > 0)
    sizes = np.array([len(g) for g in sets])
    marks = signatures(sets, 1 << max(6, math.ceil(math.log2(2 * sizes.max()))))
    found = []
    for i in range(1, len(sets)):
        apart = label[:i] != label[i]
        if role is not None:
            apart &= (probe[:i] & target[i]) | (target[:i] & probe[i])
        near = np.flatnonzero(apart)
        if not len(near):
            continue
        able = may_link(marks[i : i + 1], sizes[i : i + 1], marks[near], sizes[near], percent)[0]
        tried: dict[int, int] = {}
        for j in near[able].tolist():
            if label[i] == label[j]:
                continue
            if tries is not None:
                if tried.get(label[j], 0) >= tries:
                    continue
                tried[label[j]] = tried.get(label[j], 0) + 1
            if links_exactly(sets[i], sets[j], percent):
                found.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return found


def _named(pairs: list[tuple[int, int]], names: np.ndarray) -> pd.DataFrame:
    """(u, v) with u < v: the names at the pairs' positions."""
    both = names[np.array(pairs, dtype=np.int64).reshape(-1, 2)]
    return pd.DataFrame({"u": both.min(axis=1), "v": both.max(axis=1)}, dtype="int64")


def _linked_block(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(u, v) with u < v: components of one block of which two members link; not all of them need be found."""
    root = block["root"].to_numpy()
    return _named(_joining(block["grams"], root, percent, TRIES), root)


def _linked_clusters(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(u, v) with u < v: links that join all linked components of each block, for all blocks of one call."""
    node, root, role = (rows[c].to_numpy() for c in ("node", "root", "role"))
    found = []
    for at in rows.groupby(["cluster", "i", "j"], sort=False).indices.values():
        pairs = _joining(rows["grams"].iloc[at], root[at], percent, role=role[at])
        found += [(at[x], at[y]) for x, y in pairs]
    return _named(found, node)


def family_roots(index: DataFrame, sets: DataFrame, params: JaccardParams) -> DataFrame | None:
    """(node, root), written: components of verified links among the sets that lead with a crowded shingle, or None.

    In every round each set goes to one of its crowded shingles, another one each time. There the components (first
    every set by itself) send a few speakers to blocks of bounded size, whose components are joined by exact
    comparison. A round divides the components of a family by hundreds; the rounds end when one joins few.
    """
    crowded = index.where(F.col("df") > params.crowd).groupBy("node")
    homes = [F.min_by("token", F.xxhash64("token", F.lit(r))).alias(f"home{r}") for r in range(ROUNDS)]
    roots = cut(crowded.agg(F.first("n").alias("n"), *homes).withColumn("root", F.col("node")))
    if roots.isEmpty():
        return None
    for r in range(ROUNDS):
        mixed = F.xxhash64("node", F.lit(r))
        speakers = cut(
            roots.groupBy(F.col(f"home{r}").alias("home"), "root", F.pmod(mixed, F.lit(SPEAKERS)).alias("seat"))
            .agg(F.min_by(F.struct("node", "n"), mixed).alias("s"))
            .select("home", "root", "s.*")
        )
        blocks = (
            speakers.groupBy("home")
            .agg(
                F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).alias("blocks"),
                F.min("root").alias("low"),
                F.max("root").alias("high"),
            )
            .where("low < high")
            .select("home", "blocks")
        )
        seated = cut(speakers.join(blocks, "home").withColumn("block", F.pmod(mixed, F.col("blocks"))))
        waiting = cut(seated.select("node").distinct())
        made = cut(
            seated.select("home", "block", "node", "root")
            .join(_perhaps(sets, waiting).select("node", "grams"), "node")
            .groupBy("home", "block")
            .applyInPandas(lambda block: _linked_block(block, params.percent), "u long, v long")
        )
        joined = made.count()
        if joined:
            found = components(made).select(F.col("node").alias("root"), F.col("root").alias("now"))
            roots = cut(roots.join(found, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now"))
        if joined * ENOUGH < waiting.count():
            break
    return roots.select("node", "root")


def _in_blocks(met: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and i, j, role: the blocks of each row's group, which has ``main``, its largest component, ``ka``
    blocks of targets and ``ko`` of probes. Any two rows of different components meet as probe and target."""
    met = met.withColumns(
        {
            "probe": F.col("root") != F.col("main"),
            "a": F.pmod(F.xxhash64("node"), F.col("ka")).cast("int"),
            "o": F.pmod(F.xxhash64("node", F.lit(1)), F.col("ko")).cast("int"),
        }
    )
    places = F.expr(
        "concat("
        "transform(sequence(0, ko - 1), x -> named_struct('i', x, 'j', a, 'role', if(probe and x = o, 3, 1))),"
        "if(probe, transform(filter(sequence(0, ka - 1), y -> y != a), y -> named_struct('i', o, 'j', y, 'role', 2)),"
        " array()))"
    )
    return met.select(*columns, F.explode(places).alias("p")).select(*columns, "p.*")


def _tile_rows(index: DataFrame, params: JaccardParams) -> tuple[DataFrame, int]:
    """(token, band, i, j, role, node, n, root, own) and how many Python calls the rows are worth.

    ``index`` has a ``root``. Groups of one component are left out. The sets that are not of a group's largest
    component are probes (role 2) of block i, all sets are targets (role 1) of block j; 3 is both.
    """
    own = params.band(F.col("n"))
    both = F.array(
        F.struct(own.alias("band"), F.lit(True).alias("own")), F.struct((own + 1).alias("band"), F.lit(False).alias("own"))
    )
    rows = index.select("token", "node", "n", "root", F.explode(both).alias("b")).select("token", "node", "n", "root", "b.*")
    by_root = rows.groupBy("token", "band", "root").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.count_if("own").alias("o")
    )
    groups = cut(
        by_root.groupBy("token", "band")
        .agg(
            F.max_by("root", F.struct("c", "root")).alias("main"),
            F.sum("c").alias("all"),
            F.max("c").alias("most"),
            F.sum("o").alias("o"),
            F.sum("w").alias("w"),
        )
        .where("o > 0 and most < `all`")
        .withColumn("ka", F.ceil(F.col("all") / params.tile).cast("int"))
        .withColumn("ko", F.ceil((F.col("all") - F.col("most")) / params.tile).cast("int"))
    )
    load = groups.agg(F.sum(F.col("ko") * (100 * F.col("all") + F.col("w")) + F.col("ka") * 100 * (F.col("all") - F.col("most"))))
    calls = max(1, -(-int(load.first()[0] or 0) // CALL))
    met = rows.join(groups.select("token", "band", "main", "ka", "ko"), ["token", "band"])
    return _in_blocks(met, ["token", "band", "node", "n", "root", "own"]), calls


def _marks(sets: DataFrame, params: JaccardParams) -> DataFrame:
    """(node, band, mark): the signature of each set in the tiles of its band and of the band above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands, marks = [], [], []
            for node, own, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2))):
                for band in (own, own + 1):
                    nodes.append(node)
                    bands.append(band)
                    marks.append(signatures([grams], params.bits(band)).tobytes())
            made = [pa.array(nodes, pa.int64()), pa.array(bands, pa.int32()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["node", "band", "mark"])

    return sets.select("node", params.band(F.col("n")).alias("own"), "grams").mapInArrow(
        run, "node long, band int, mark binary"
    )


def _reached(near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each component of a symmetric matrix of neighbours: its first member, and the others; single ones are left out."""
    waiting = near.any(axis=1)
    for first in np.flatnonzero(waiting).tolist():
        if not waiting[first]:
            continue
        waiting[first] = False
        new, parts = near[first] & waiting, []
        while new.any():
            waiting &= ~new
            parts.append(np.flatnonzero(new))
            new = near[new].any(axis=0) & waiting
        yield first, np.concatenate(parts)


def _tile_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(u, v) with u < v, for all tiles of one call: what connects the sets of each tile that the pairs of different
    components connect which signatures allow. A tile has fewer of them than sets; u and v need not be such a pair."""
    node, root, n = rows["node"].to_numpy(), rows["root"].to_numpy(), rows["n"].to_numpy()
    own, role, mark = rows["own"].to_numpy(), rows["role"].to_numpy(), rows["mark"].to_numpy()
    low, high = [], []
    for places in rows.groupby(["token", "band", "i", "j"], sort=False).indices.values():
        if len(places) < 2:
            continue
        words = np.frombuffer(b"".join(mark[places]), dtype=np.uint64).reshape(len(places), -1)
        p, t = np.flatnonzero(role[places] & 2), np.flatnonzero(role[places] & 1)
        probe, target = places[p], places[t]
        able = may_link(words[p], n[probe], words[t], n[target], percent)
        able &= (root[probe][:, None] != root[target]) & (own[probe][:, None] | own[target])
        if not able.any():
            continue
        if len(places) == 2:
            parts = [(0, np.array([1]))]
        else:
            near = np.zeros((len(places), len(places)), dtype=bool)
            near[np.ix_(p, t)] = able
            parts = _reached(near | near.T)
        for first, others in parts:
            a, b = node[places[first]], node[places[others]]
            low.append(np.minimum(a, b))
            high.append(np.maximum(a, b))
    if not low:
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    return pd.DataFrame({"u": np.concatenate(low), "v": np.concatenate(high)}).drop_duplicates()


def _rooted(index: DataFrame, family: DataFrame | None) -> DataFrame:
    if family is None:
        return index.withColumn("root", F.col("node"))
    return cut(index.join(family, "node", "left").withColumn("root", F.coalesce("root", "node")))


def tile_clusters(rows: DataFrame, calls: int, sets: DataFrame, params: JaccardParams) -> DataFrame:
    """(node, cluster), written: the sets of ``rows`` in tiles (written) that signatures connect with others."""
    marks = _marks(_perhaps(sets, cut(rows.select("node").distinct())), params)
    call = F.pmod(F.xxhash64("token", "band", "i", "j"), F.lit(calls))
    near = (
        rows.join(marks, ["node", "band"])
        .withColumn("call", call)
        .groupBy("call")
        .applyInPandas(lambda some: _tile_pairs(some, params.percent), "u long, v long")
    )
    found = components(near)
    heads = found.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()
    return cut(found.select("node", F.col("root").alias("cluster")).unionByName(heads))


def tile_links(index: DataFrame, sets: DataFrame, params: JaccardParams) -> DataFrame:
    """(u, v), written: links that join all linked components (``root``) of ``index``."""
    placed, calls = _tile_rows(index, params)
    rows = cut(placed)
    clusters = tile_clusters(rows, calls, sets, params)
    members = cut(clusters.join(rows.select("node", "n", "root").distinct(), "node"))
    blocks = lambda w, c: F.ceil(F.greatest(w / BLOCK_SHINGLES, c / BLOCK_SETS, F.lit(1))).cast("int")
    size = F.struct("c", "root")
    groups = (
        members.groupBy("cluster", "root")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
        .groupBy("cluster")
        .agg(
            F.max_by("root", size).alias("main"),
            blocks(F.sum("w"), F.sum("c")).alias("ka"),
            blocks(F.sum("w") - F.max_by("w", size), F.sum("c") - F.max("c")).alias("ko"),
        )
    )
    met = cut(_in_blocks(members.join(groups, "cluster"), ["cluster", "node", "n", "root"]))
    calls = max(1, -(-int(met.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES))
    grams = _perhaps(sets, members.select("node")).select("node", "grams")
    return cut(
        met.drop("n")
        .join(grams, "node")
        .groupBy(F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(calls)).alias("call"))
        .applyInPandas(lambda some: _linked_clusters(some, params.percent), "u long, v long")
    )


def jaccard_classes(
    documents: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set) and component_id (least doc_id reachable by links).

    A text with fewer words than a shingle is one shingle. Texts without words have an empty set, are linked with
    nothing, not even each other, and keep their own id. Rows with equal sets are one node, so copies never meet as
    rows. Null ids take part, and are a class's ``component_id`` only where it has no other id. An empty table gives an
    empty result, other columns of any name are not read, and texts are read whole.
    """
    with small_batches(documents.sparkSession):
        raw = cut(shingle_sets(documents, params.shingle, id_col, text_col))
        sets, least = distinct_sets(raw)
        index = prefix_index(sets, params)
        family = family_roots(index, sets, params)
        links = tile_links(_rooted(index, family), sets, params)
    if family is not None:
        stars = family.where("root < node").select(F.col("root").alias("u"), F.col("node").alias("v"))
        links = links.unionByName(stars)
    placed = cut(
        least.join(components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("class"))
    )
    ids = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "class").select("node", "component_id")
    members = raw.select("doc_id", F.col("n").alias("n_shingles"), "node")
    empty = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        members.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id").unionByName(empty)
    )
