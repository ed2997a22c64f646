"""Client profiles and their two segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlens import schema as S
from meterlens.config import SegmentParams
from meterlens.operators.blocks import beside
from meterlens.operators.density import density_clusters
from meterlens.operators.quantiles import exact_quantiles
from meterlens.session import cut

FEATURES = ["vol_med", "vol_p90", "pres_med", "pres_p90"]
CENTRES_PER_ROW = 5_000


def client_profiles(df: DataFrame, *, max_values: int | None = None) -> DataFrame:
    """Median and 90th percentile of volume and pressure, and the reading count, per client."""
    q = exact_quantiles(df, [S.CLIENT], [S.VOLUME, S.PRESSURE], [0.5, 0.9], max_values=max_values)
    n = df.groupBy(S.CLIENT).agg(F.count(F.lit(1)).alias("n_obs"))
    at = lambda c, i: F.get(c, F.lit(i))
    return q.join(n, S.CLIENT).select(
        S.CLIENT,
        at(S.VOLUME, 0).alias("vol_med"),
        at(S.VOLUME, 1).alias("vol_p90"),
        at(S.PRESSURE, 0).alias("pres_med"),
        at(S.PRESSURE, 1).alias("pres_p90"),
        "n_obs",
    )


def _spread(profiles: DataFrame) -> DataFrame:
    """One row: mean and population deviation of every feature; a flat one divides by 1."""
    unit = lambda c: F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c))
    return profiles.agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(FEATURES)],
        *[unit(c).alias(f"_s{i}") for i, c in enumerate(FEATURES)],
    )


def standardise(df: DataFrame, spread: DataFrame) -> DataFrame:
    """Add ``x0`` .. ``x3``, the features on the common scale."""
    scaled = {f"x{i}": (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, c in enumerate(FEATURES)}
    joined = beside(df, spread).withColumns(scaled)
    return joined.drop(*spread.columns)


def cluster_centres(clustered: DataFrame) -> DataFrame:
    return (
        clustered.where(F.col("cluster").isNotNull())
        .groupBy("cluster")
        .agg(*[F.avg(c).alias(c) for c in FEATURES])
    )


def centre_segments(centres: DataFrame) -> DataFrame:
    """A centre above the median 90th-percentile volume is industrial; if none is, the top one is."""
    th = exact_quantiles(centres, [], ["vol_p90"], [0.5]).select(F.get("vol_p90", F.lit(0)).alias("_th"))
    above = beside(centres, th).withColumn("_above", F.col("vol_p90") > F.col("_th"))
    pick = above.agg(
        F.bool_or("_above").alias("_any"),
        F.min_by("cluster", F.struct(-F.col("vol_p90"), F.col("cluster"))).alias("_top"),
    )
    industrial = F.when(F.col("_any"), F.col("_above")).otherwise(F.col("cluster") == F.col("_top"))
    return beside(above, pick).select(
        "cluster", *FEATURES, F.when(industrial, S.INDUSTRIAL).otherwise(S.COMMERCIAL).alias(S.SEGMENT)
    )


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """The segment of the nearest centre for each point, both with ``x0`` .. ``x3``; ties: first cluster.

    A few thousand centres travel packed in one row that every point meets. More are found on grids of growing cells:
    a point looks at the centres of its own and the touching cells, and is done as soon as one lies within a cell's
    width, since any centre that near is among them. The rest go on to cells twice as wide.
    """
    finite = lambda i: F.abs(F.col(f"x{i}")) < F.lit(float("inf"))  # noqa: E731 - false for NaN, which is the largest
    for i in range(4):
        points, centres = points.where(finite(i)), centres.where(finite(i))
    n = centres.count()
    if n <= CENTRES_PER_ROW:
        packed = centres.agg(F.collect_list(F.struct("x0", "x1", "x2", "x3", "cluster", S.SEGMENT)).alias("_c"))
        best = F.array_min(
            F.transform(
                "_c",
                lambda c: F.struct(
                    _squared(lambda i: F.col(f"x{i}"), lambda i: c[f"x{i}"]).alias("d"),
                    c["cluster"].alias("cluster"),
                    c[S.SEGMENT].alias("s"),
                ),
            )
        )
        return beside(points, packed).select(S.CLIENT, best["s"].alias(S.SEGMENT))
    axes = range(4)
    ends = centres.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in axes for k, f in (("lo", F.min), ("hi", F.max))]).first()
    # Begin with about one centre in a cell's width along each axis.
    widest = max(ends[f"hi{i}"] - ends[f"lo{i}"] for i in axes) or 1.0
    width = widest / max(1.0, n**0.25)
    cell = lambda i: F.floor(F.col(f"x{i}") / F.lit(width))
    left, found = cut(points.select(S.CLIENT, *[f"x{i}" for i in axes])), []
    while left.limit(1).count():
        asked = left
        for i in axes:
            asked = asked.withColumn(f"c{i}", F.explode(F.array(*[cell(i) + k for k in (-1, 0, 1)])))
        there = centres.select(
            *[cell(i).alias(f"c{i}") for i in axes], *[F.col(f"x{i}").alias(f"y{i}") for i in axes], "cluster", S.SEGMENT
        )
        distance = _squared(lambda i: F.col(f"x{i}"), lambda i: F.col(f"y{i}"))
        best = (
            asked.join(there, [f"c{i}" for i in axes])
            .groupBy(S.CLIENT)
            .agg(F.min(F.struct(distance.alias("d"), "cluster", F.col(S.SEGMENT).alias("s"))).alias("_best"))
        )
        near = cut(best.where(F.col("_best.d") <= width * width).select(S.CLIENT, F.col("_best.s").alias(S.SEGMENT)))
        found.append(near)
        left = cut(left.join(near, S.CLIENT, "left_anti"))
        width *= 2
    out = found[0] if found else points.select(S.CLIENT, F.lit(None).cast("string").alias(S.SEGMENT)).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _squared(a, b) -> Column:
    return sum(((a(i) - b(i)) * (a(i) - b(i)) for i in range(4)), F.lit(0.0))


def segment_profiles(profiles: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """``profiles`` plus ``cluster`` (null for noise) and ``segment``."""
    profiles = cut(profiles)
    if len(profiles.limit(2).collect()) < 2:
        return profiles.withColumns(
            {"cluster": F.lit(None).cast("string"), S.SEGMENT: F.lit(S.DEFAULT_SEGMENT)}
        )
    spread = cut(_spread(profiles))
    points = standardise(profiles, spread).select(F.col(S.CLIENT).alias("id"), "x0", "x1", "x2", "x3")
    clusters = density_clusters(points, p.eps, p.min_samples, len(FEATURES))
    clustered = cut(profiles.join(clusters.withColumnRenamed("id", S.CLIENT), S.CLIENT))
    if not clustered.where(F.col("cluster").isNotNull()).limit(1).count():
        th = exact_quantiles(profiles, [], ["vol_p90"], [0.5]).select(F.get("vol_p90", F.lit(0)).alias("_th"))
        high = F.when(F.col("vol_p90") > F.col("_th"), S.INDUSTRIAL).otherwise(S.COMMERCIAL)
        return beside(clustered, th).withColumn(S.SEGMENT, high).drop("_th")
    centres = cut(centre_segments(cluster_centres(clustered)))
    inside = clustered.where(F.col("cluster").isNotNull()).join(
        centres.select("cluster", S.SEGMENT), "cluster"
    )
    noise = clustered.where(F.col("cluster").isNull())
    near = nearest_centre(
        standardise(noise, spread), standardise(centres, spread).select("cluster", S.SEGMENT, "x0", "x1", "x2", "x3")
    )
    # Clients without a finite place are near to no centre.
    outside = noise.join(near, S.CLIENT, "left").withColumn(
        S.SEGMENT, F.coalesce(S.SEGMENT, F.lit(S.DEFAULT_SEGMENT))
    )
    return inside.select(*outside.columns).unionByName(outside)


def attach_segments(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Give every reading its client's segment; unknown clients get the default."""
    bare = df.drop(S.SEGMENT)
    return bare.join(segments.select(S.CLIENT, S.SEGMENT), S.CLIENT, "left").withColumn(
        S.SEGMENT, F.coalesce(S.SEGMENT, F.lit(S.DEFAULT_SEGMENT))
    )


def segment_clients(df: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Readings with ``segment``; without volume or pressure all clients get the default."""
    if any(c not in df.columns for c in (S.CLIENT, S.VOLUME, S.PRESSURE)):
        return df.withColumn(S.SEGMENT, F.lit(S.DEFAULT_SEGMENT))
    usable = df.na.drop(subset=[S.CLIENT, S.VOLUME, S.PRESSURE])
    return attach_segments(df, segment_profiles(client_profiles(usable), p))
