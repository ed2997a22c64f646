"""Isolation forest over the residual features: sample, grow, score."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meterlens import schema as S
from meterlens.config import AnomalyParams
from meterlens.operators.blocks import MAX_SEGMENTS, segment_rows
from meterlens.session import cut

FEATURES = S.RESIDUAL_FEATURES
NODES = (
    f"{S.SEGMENT} string, tree int, node int, feature int, threshold double, "
    "left int, right int, depth double"
)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n, 3.0) - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def draw_samples(
    train: DataFrame, sizes: DataFrame, p: AnomalyParams, seed: int, pos: str = "train_pos"
) -> DataFrame:
    """``max_samples`` distinct random training rows per segment and tree.

    ``train`` numbers its rows 0..n-1 per segment in ``pos``; ``sizes`` has ``n_train`` per segment.
    A segment of at most ``max_samples`` rows is used whole by every tree. The drawn table has
    trees x samples rows whatever the size of ``train``.
    """
    psi = p.max_samples
    # Draw more than needed: the surplus covers repeats. Small tables are taken whole instead.
    surplus = 2 * psi
    trees = F.explode(F.sequence(F.lit(0), F.lit(p.n_estimators - 1))).alias("tree")
    random = F.pmod(F.xxhash64(S.SEGMENT, "tree", "draw", F.lit(seed)), F.col("n_train"))
    drawn = (
        sizes.where(F.col("n_train") > 8 * psi)
        .select(S.SEGMENT, "n_train", trees)
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(surplus - 1).cast("long"))))
        .groupBy(S.SEGMENT, "tree", random.alias(pos))
        .agg(F.min("draw").alias("draw"))
    )
    whole = (
        sizes.where(F.col("n_train").between(1, 8 * psi))
        .select(S.SEGMENT, "n_train", trees)
        .withColumn(pos, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_train") - 1)))
        .withColumn("draw", F.xxhash64(S.SEGMENT, "tree", pos, F.lit(seed)))
    )
    order = Window.partitionBy(S.SEGMENT, "tree").orderBy("draw", pos)
    chosen = (
        drawn.unionByName(whole.select(*drawn.columns))
        .withColumn("_k", F.row_number().over(order))
        .where(F.col("_k") <= psi)
        .drop("_k", "draw")
    )
    return train.select(S.SEGMENT, pos, *FEATURES).join(chosen, [S.SEGMENT, pos])


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[list]:
    """Node rows of one tree: random feature, uniform cut between its minimum and maximum."""
    nodes: list[list] = []
    rest = average_path(np.arange(len(x) + 1))
    todo = [(x, 0, -1, 0)]  # points, depth, parent, side
    while todo:
        points, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        low, high = points.min(axis=0), points.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(points) <= 1 or not len(open_):
            nodes.append([me, -1, 0.0, -1, -1, depth + rest[len(points)]])
            continue
        f = int(open_[rng.integers(len(open_))])
        cut_at = rng.uniform(low[f], high[f])
        below = points[:, f] <= cut_at
        if below.all():  # the draw hit the maximum
            below = points[:, f] < high[f]
            cut_at = points[below, f].max()
        nodes.append([me, f, float(cut_at), -1, -1, 0.0])
        todo.append((points[~below], depth + 1, me, 1))
        todo.append((points[below], depth + 1, me, 0))
    return nodes


def fit_forest(
    samples: DataFrame, p: AnomalyParams, seed: int, pos: str = "train_pos"
) -> DataFrame:
    """Node table of the forest, one task group per tree (at most ``max_samples`` rows each)."""

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        segment, tree = key
        x = rows[FEATURES].to_numpy(dtype=float)[np.argsort(rows[pos].to_numpy())]
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        rng = np.random.default_rng([seed, int(tree), *segment.encode()])
        nodes = _grow(x, limit, rng)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "depth"])
        out.insert(0, "tree", int(tree))
        out.insert(0, S.SEGMENT, segment)
        return out

    # The samples are few but growing is not free: keep every core busy.
    tasks = samples.sparkSession.sparkContext.defaultParallelism
    spread = samples.repartition(tasks, S.SEGMENT, "tree")
    return spread.groupBy(S.SEGMENT, "tree").applyInPandas(grow, NODES)


def forest_arrays(nodes: pd.DataFrame, max_samples: int) -> dict:
    """The trees of one segment as flat arrays, for scoring batches."""
    nodes = nodes.sort_values(["tree", "node"])
    trees = nodes["tree"].to_numpy()
    starts = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]])
    base = np.repeat(starts, np.diff(np.r_[starts, len(trees)]))
    me = np.arange(len(trees))
    leaf = nodes["feature"].to_numpy() < 0
    # A leaf sends every row back to itself.
    left = np.where(leaf, me, nodes["left"].to_numpy() + base)
    right = np.where(leaf, me, nodes["right"].to_numpy() + base)
    return {
        "starts": starts.astype(np.int32),
        "feature": np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.int32),
        "threshold": np.where(leaf, np.inf, nodes["threshold"].to_numpy()),
        "children": np.stack([left, right], axis=1).astype(np.int32).ravel(),
        "depth": nodes["depth"].to_numpy(),
        "rounds": int(np.ceil(np.log2(max(max_samples, 2)))),
        "unit": float(average_path(max_samples)),
    }


def score_rows(forest: dict, x: np.ndarray, step: int = 256) -> np.ndarray:
    """Anomaly score 2^(-mean path / expected path) of each row."""
    threshold, depth = forest["threshold"], forest["depth"]
    # Indices of the machine's own width are gathered without a conversion; few rows at once stay in the cache.
    starts, feature, children = (forest[c].astype(np.intp) for c in ("starts", "feature", "children"))
    paths = np.empty(len(x))
    for a in range(0, len(x), step):
        part = np.ascontiguousarray(x[a : a + step])
        flat, width = part.ravel(), part.shape[1]
        offset = (np.arange(len(part)) * width)[:, None]
        at = np.repeat(starts[None, :], len(part), axis=0)
        for _ in range(forest["rounds"]):
            place = feature.take(at)
            place += offset
            right = flat.take(place) > threshold.take(at)
            at *= 2
            at += right
            at = children.take(at)
        paths[a : a + step] = depth.take(at).mean(axis=1)
    return np.exp2(-paths / forest["unit"])


#: Node rows of all segments' forests that are broadcast; larger tables meet the rows in a shuffle.
BROADCAST_NODES = 2_000_000
#: Rows of one segment that are scored in one task of that shuffle.
SLICE_ROWS = 200_000


def with_scores(
    features: DataFrame,
    nodes: DataFrame,
    samples: DataFrame,
    *,
    broadcast_nodes: int = BROADCAST_NODES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``features`` with ``score``, null where a segment has no forest. ``samples`` has ``forest_samples`` per segment.

    Forests of few segments are broadcast, after their nodes were counted. Beyond that the rows of a segment are dealt
    into slices, the segment's nodes are copied to each, and every task sees one slice and one forest, so neither the
    driver nor a task holds what grows with the number of segments.
    """
    if nodes.count() <= broadcast_nodes and samples.limit(MAX_SEGMENTS + 1).count() <= MAX_SEGMENTS:
        used = {r[S.SEGMENT]: r["forest_samples"] for r in segment_rows(samples)}
        return features.withColumn("score", scorer(features, load_forests(nodes, used)))
    columns = features.columns
    slices = cut(
        features.groupBy(S.SEGMENT).agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("_slices"))
    )
    part = F.pmod(F.xxhash64(*columns), F.col("_slices")).cast("int")
    dealt = features.join(slices, S.SEGMENT).select(*columns, part.alias("_slice"))
    copies = nodes.join(samples.select(S.SEGMENT, "forest_samples"), S.SEGMENT).join(
        slices.select(S.SEGMENT, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")), S.SEGMENT
    )
    # Written, so that the two sides of the cogroup share no column even if both were made from the same rows.
    copies = cut(copies)

    def score(rows: pa.Table, forest: pa.Table) -> pa.Table:
        rows = rows.select(columns)
        if not rows.num_rows or not forest.num_rows:
            return rows.append_column("score", pa.nulls(rows.num_rows, pa.float64()))
        arrays = forest_arrays(forest.to_pandas(), forest["forest_samples"][0].as_py())
        x = np.column_stack([rows[c].to_numpy() for c in FEATURES])
        return rows.append_column("score", pa.array(score_rows(arrays, x)))

    keys = [S.SEGMENT, "_slice"]
    layout = StructType([*features.schema.fields, StructField("score", DoubleType())])
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(score, layout)


def load_forests(nodes: DataFrame, sizes: dict[str, int]) -> dict[str, dict]:
    """Scoring arrays per segment; the node table is bounded by segments x trees x 2 x samples."""
    segment_rows(nodes.select(S.SEGMENT).distinct())
    table = nodes.toPandas()
    return {seg: forest_arrays(part, sizes[seg]) for seg, part in table.groupby(S.SEGMENT)}


def scorer(df: DataFrame, forests: dict[str, dict]) -> Column:
    """The raw anomaly score as a column over ``segment`` and the residual features."""
    shared = df.sparkSession.sparkContext.broadcast(forests)

    @F.arrow_udf("double")
    def score(segment: pa.Array, *features: pa.Array) -> pa.Array:
        segments = segment.to_numpy(zero_copy_only=False)
        x = np.column_stack([f.to_numpy(zero_copy_only=False) for f in features])
        out = np.full(len(x), np.nan)
        for seg in pd.unique(segments):
            if seg in shared.value:
                mine = segments == seg
                out[mine] = score_rows(shared.value[seg], x[mine])
        return pa.array(out, from_pandas=True)

    return score(F.col(S.SEGMENT), *[F.col(c) for c in FEATURES])
