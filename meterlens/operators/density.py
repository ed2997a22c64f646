"""Density clustering (DBSCAN) without comparing all pairs.

Points are put into cells whose diagonal is ``eps``: points of one cell are neighbours by
construction, so a cell with ``min_samples`` points is all core and is handled as a whole from then on.
Distances between points are only taken where one side is a cell of fewer than ``min_samples`` points;
two full cells are compared by the bounding boxes of ever smaller parts. Work grows with the points and
the occupied cells, also when a third of all points lie in one cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from meterlens.session import cut

SALT_ROWS = 50_000  # points of one cell per task when single points are compared with it


def _box(dims: int) -> list[Column]:
    return [f(f"x{i}").alias(f"{n}{i}") for i in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _nearest(dims: int, a: str = "a_", b: str = "b_") -> Column:
    """Squared distance of the closest points two boxes could have."""
    gap = lambda i: F.greatest(
        F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.lit(0.0)
    )
    return _total([gap(i) * gap(i) for i in range(dims)])


def _farthest(dims: int, a: str = "a_", b: str = "b_") -> Column:
    """Squared distance of the farthest points two boxes could have."""
    span = lambda i: F.greatest(
        F.abs(F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}")), F.abs(F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}"))
    )
    return _total([span(i) * span(i) for i in range(dims)])


def _between(dims: int, a: str, b: str) -> Column:
    return _total([(F.col(f"{a}x{i}") - F.col(f"{b}x{i}")) ** 2 for i in range(dims)])


def density_clusters(points: DataFrame, eps: float, min_samples: int, dims: int) -> DataFrame:
    """``id`` and ``cluster`` for points (``id``, ``x0`` .. ): the smallest core id of the cluster.

    ``cluster`` is null for noise. A border point takes the first (smallest) of its clusters, so the
    clusters sorted by name are in the order in which a scan over sorted ids would find them.
    """
    side, nest, reach = eps / math.sqrt(dims), math.ceil(math.sqrt(dims)), eps * eps
    fine = [F.floor(F.col(f"x{i}") / side) for i in range(dims)]
    xs = [f"x{i}" for i in range(dims)]
    placed = points.withColumns({f"c{i}": c for i, c in enumerate(fine)}).withColumn(
        "cell", F.concat_ws(":", *[F.col(f"c{i}").cast("string") for i in range(dims)])
    )
    placed = cut(placed.select("id", *xs, "cell", *[f"c{i}" for i in range(dims)]))

    coarse = [F.floor(F.col(f"c{i}") / nest).alias(f"g{i}") for i in range(dims)]
    cells = placed.groupBy("cell", *[f"c{i}" for i in range(dims)]).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), *_box(dims)
    )
    cells = cut(cells.select("cell", "n", "first", *coarse, *[f"{n}{i}" for i in range(dims) for n in ("lo", "hi")]))
    full = F.col("n") >= min_samples

    # Cell pairs that may hold neighbours: cells of adjacent coarse cells whose boxes come close enough.
    left = _prefixed(cells, "a_")
    for i in range(dims):
        around = F.explode(F.sequence(F.col(f"a_g{i}") - 1, F.col(f"a_g{i}") + 1))
        left = left.withColumn(f"b_g{i}", around)
    near = (
        left.join(_prefixed(cells, "b_"), [f"b_g{i}" for i in range(dims)])
        .where((F.col("a_cell") != F.col("b_cell")) & (_nearest(dims) <= reach))
        .withColumn("_far", _farthest(dims))
        .select("a_cell", "b_cell", "a_n", "b_n", "_far")
    )
    near = cut(near)

    # Points of sparse cells against the cells around them.
    sparse = placed.join(cells.where(~full).select("cell", "n"), "cell")
    lone = _prefixed(sparse.select("id", "cell", "n", *xs), "p_")
    facing = lone.join(near.where(F.col("a_n") < min_samples).withColumnRenamed("a_cell", "p_cell"), "p_cell")
    parts = F.ceil(F.col("b_n") / SALT_ROWS).cast("int")
    facing = facing.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    sizes = cells.select("cell", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("_parts"))
    others = _prefixed(placed.join(sizes, "cell").select("id", "cell", "_parts", *xs), "q_")
    others = others.withColumn("_salt", F.pmod(F.hash("q_id"), F.col("q__parts"))).withColumnRenamed("q_cell", "b_cell")
    hits = facing.join(others, ["b_cell", "_salt"]).where(_between(dims, "p_", "q_") <= reach)
    # A full cell needs only the number of hits; of a sparse cell the hit points matter later.
    by_cell = cut(
        hits.groupBy(
            "p_id", "p_cell", "p_n", "b_cell", F.when(F.col("b_n") < min_samples, F.col("q_id")).alias("q_id")
        ).agg(F.count(F.lit(1)).alias("k"))
    )

    counted = by_cell.groupBy("p_id").agg(F.sum("k").alias("k"))
    lone_core = (
        sparse.select(F.col("id").alias("p_id"), "cell", "n")
        .join(counted, "p_id", "left")
        .select("p_id", "cell", (F.col("n") + F.coalesce("k", F.lit(0)) >= min_samples).alias("core"))
    )
    lone_core = cut(lone_core)
    sparse_nodes = lone_core.where("core").groupBy("cell").agg(F.min("p_id").alias("own"))
    nodes = cut(cells.where(full).select("cell", F.col("first").alias("own")).unionByName(sparse_nodes))

    # Edges between cells with core points.
    core_ids = lone_core.where("core").select("p_id")
    from_core = by_cell.join(core_ids, "p_id", "left_semi")
    to_full = from_core.where(F.col("q_id").isNull()).select(F.col("p_cell").alias("a"), F.col("b_cell").alias("b"))
    to_sparse = (
        from_core.where(F.col("q_id").isNotNull())
        .join(core_ids.withColumnRenamed("p_id", "q_id"), "q_id", "left_semi")
        .select(F.col("p_cell").alias("a"), F.col("b_cell").alias("b"))
    )
    both_full = near.where((F.col("a_n") >= min_samples) & (F.col("b_n") >= min_samples) & (F.col("a_cell") < F.col("b_cell")))
    touching = both_full.where(F.col("_far") <= reach).select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"))
    unsure = both_full.where(F.col("_far") > reach).select("a_cell", "b_cell")
    edges = to_full.unionByName(to_sparse).unionByName(touching)
    edges = edges.unionByName(_touching_parts(placed, unsure, side, reach, dims)).distinct()

    labels = connected_labels(nodes, edges)

    # Border points: not core, but within reach of a core point.
    owner = labels.select("cell", "label")
    fringe = lone_core.where(~F.col("core")).select("p_id", "cell")
    own_cell = fringe.join(owner, "cell").select("p_id", "label")
    reached = by_cell.join(fringe.select("p_id"), "p_id", "left_semi")
    full_cell = reached.where(F.col("q_id").isNull()).join(owner.withColumnRenamed("cell", "b_cell"), "b_cell").select("p_id", "label")
    sparse_core = (
        reached.where(F.col("q_id").isNotNull())
        .join(core_ids.withColumnRenamed("p_id", "q_id"), "q_id", "left_semi")
        .join(owner.withColumnRenamed("cell", "b_cell"), "b_cell")
        .select("p_id", "label")
    )
    border = own_cell.unionByName(full_cell).unionByName(sparse_core).groupBy("p_id").agg(F.min("label").alias("_b"))
    loose = fringe.select("p_id", F.lit(True).alias("_loose"))
    labelled = (
        placed.select("id", "cell")
        .join(owner, "cell", "left")
        .join(loose.withColumnRenamed("p_id", "id"), "id", "left")
        .join(border.withColumnRenamed("p_id", "id"), "id", "left")
    )
    return labelled.select("id", F.when(F.col("_loose"), F.col("_b")).otherwise(F.col("label")).alias("cluster"))


def _touching_parts(placed: DataFrame, pairs: DataFrame, side: float, reach: float, dims: int) -> DataFrame:
    """Of pairs of full cells, those with two points within reach, by halving boxes until sure.

    A box around equal points has no size, so at the latest there the answer is exact.
    """
    found = pairs.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")).limit(0)
    open_ = cut(pairs.select("a_cell", "b_cell", F.col("a_cell").alias("a_part"), F.col("b_cell").alias("b_part")))
    level = 0
    while open_.limit(1).count():
        level += 1
        width = side / 2**level
        name = lambda w: F.concat_ws(":", *[F.floor(F.col(f"x{i}") / w).cast("string") for i in range(dims)])
        parent = F.col("cell") if level == 1 else name(2 * width)
        used = open_.select(F.col("a_cell").alias("cell")).union(open_.select("b_cell")).distinct()
        parts = (
            placed.join(used, "cell", "left_semi")
            .withColumns({"part": parent, "child": name(width)})
            .groupBy("cell", "part", "child")
            .agg(*_box(dims))
        )
        parts = cut(parts)
        judged = (
            open_.join(_prefixed(parts, "a_"), ["a_cell", "a_part"])
            .join(_prefixed(parts, "b_"), ["b_cell", "b_part"])
            .withColumns({"_near": _nearest(dims), "_far": _farthest(dims)})
            .where(F.col("_near") <= reach)
            .select("a_cell", "b_cell", "a_child", "b_child", "_far")
        )
        judged = cut(judged)
        sure = judged.where(F.col("_far") <= reach).select("a_cell", "b_cell").distinct()
        found = found.unionByName(sure.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")))
        rest = judged.join(sure, ["a_cell", "b_cell"], "left_anti")
        open_ = cut(
            rest.select("a_cell", "b_cell", F.col("a_child").alias("a_part"), F.col("b_child").alias("b_part"))
        )
    return found


def connected_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest ``own`` of each connected component, for ``nodes`` (cell, own) and ``edges`` (a, b).

    Every round takes the smallest label among neighbours and then the label of the label's own
    node, so labels travel in jumps that double, not one edge at a time.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct())
    state = cut(nodes.select("cell", "own", F.col("own").alias("label")))
    while True:
        seen = (
            both.join(state.select(F.col("cell").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("cell"))
            .agg(F.min("label").alias("_m"))
        )
        hooked = state.join(seen, "cell", "left").select(
            "cell", "own", F.col("label").alias("_old"), F.least("label", "_m").alias("label")
        )
        hooked = cut(hooked)
        roots = hooked.select(F.col("own").alias("label"), F.col("label").alias("_root"))
        jumped = hooked.join(roots, "label", "left").select(
            "cell", "own", "_old", F.least("label", "_root").alias("label")
        )
        jumped = cut(jumped)
        if not jumped.where(F.col("label") != F.col("_old")).limit(1).count():
            return jumped.select("cell", "own", "label")
        state = jumped.drop("_old")
