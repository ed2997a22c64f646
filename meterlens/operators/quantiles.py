"""Exact quantiles (linear interpolation) for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from meterlens.operators.blocks import checked_broadcast
from meterlens.session import cut

# One ``percentile`` buffer holds every distinct value of its group: allow that only up to this many
# values over all columns of a group.
MAX_VALUES = 2_000_000
BINS = 1024


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    *,
    max_values: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """One row per key with, for each column, the array of its quantiles at ``probs``.

    Groups are counted first. Groups that fit go through ``percentile``; larger ones are searched by
    narrowing: each pass counts the values per bin between the current bounds and keeps the bin
    that holds the wanted rank, until the bounds meet. No pass moves more than the bin counts.
    ``largest`` is the row count of the largest group where the caller knows it; it saves the count.
    """
    keys, cols, probs = list(keys), list(cols), [float(p) for p in probs]
    limit = (max_values or MAX_VALUES) // len(cols)
    data = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    if largest is not None and largest <= limit:
        return _direct(data, keys, cols, probs)
    hot = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
    n_hot = hot.count()
    if n_hot == 0:
        return _direct(data, keys, cols, probs)
    if not keys:
        return _narrowed(data, keys, cols, probs, 1)
    side = checked_broadcast(hot, n_hot)
    small = _direct(data.join(side, keys, "left_anti"), keys, cols, probs)
    return small.unionByName(_narrowed(data.join(side, keys, "left_semi"), keys, cols, probs, n_hot))


def _direct(data: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    wanted = F.array(*[F.lit(p) for p in probs])
    return data.groupBy(*keys).agg(*[F.percentile(c, wanted).alias(c) for c in cols])


def _narrowed(
    data: DataFrame, keys: list[str], cols: list[str], probs: list[float], n_keys: int
) -> DataFrame:
    group = [*keys, "_col"]
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).alias("_v")) for c in cols])
    values = data.select(*keys, F.inline(pairs)).where(F.col("_v").isNotNull())
    # NaN sorts above all numbers. Ranks that fall among infinite values or NaN are solved at once; the search is for
    # the finite ones in between.
    special = F.col("_v").isin(float("-inf"), float("inf")) | F.isnan("_v")
    finite = F.when(~special, F.col("_v"))

    ends = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(finite).alias("_lo"),
        F.max(finite).alias("_hi"),
        F.count_if(F.col("_v") == float("-inf")).alias("_low"),
        F.count_if((F.col("_v") == float("inf"))).alias("_high"),
        F.count_if(F.isnan("_v")).alias("_nan"),
    )
    place = F.array(
        *[
            F.struct(F.lit(i).alias("_i"), (F.lit(p) * (F.col("_n") - 1)).alias("_h"))
            for i, p in enumerate(probs)
        ]
    )
    targets = cut(ends.select("*", F.inline(place)))
    ranks = F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))
    below_nan = F.col("_n") - F.col("_nan")
    known = (
        F.when(F.col("_rank") < F.col("_low"), F.lit(float("-inf")))
        .when(F.col("_rank") >= below_nan, F.lit(float("nan")))
        .when(F.col("_rank") >= below_nan - F.col("_high"), F.lit(float("inf")))
    )
    wanted = targets.select(*group, "_lo", "_hi", "_low", "_high", "_nan", "_n", ranks.alias("_rank")).distinct()
    bounds = cut(
        wanted.select(
            *group, F.coalesce(known, "_lo").alias("_lo"), F.coalesce(known, "_hi").alias("_hi"), "_rank",
            F.col("_low").alias("_below"),
        )
    )
    values = values.where(~special)
    n_bounds = n_keys * len(cols) * len(probs) * 2

    # The lowest value falls in the first bin and the highest in the last, so every pass narrows the bounds. Halves
    # keep the difference of very large bounds finite.
    apart = F.col("_hi") - F.col("_lo")
    halves = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    share = F.when(apart < float("inf"), (F.col("_v") - F.col("_lo")) / apart).otherwise(halves)
    bin_no = F.least(F.floor(share * BINS), F.lit(BINS - 1).cast("long"))
    # Ranks between the same bounds share an interval, and the intervals of a group lie apart. A value is led from one
    # pass's interval and bin to the next one's by equal keys, so it is counted once however many ranks are wanted.
    placed, inside = values, group
    upto = (
        Window.partitionBy(*group, "_lo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    while bounds.where("_lo < _hi").limit(1).count():
        open_ = bounds.where("_lo < _hi")
        intervals = cut(open_.select(*inside, "_lo", "_hi").distinct())
        placed = placed.join(checked_broadcast(intervals, n_bounds), inside)
        placed = placed.select(*group, "_v", "_lo", "_hi", bin_no.alias("_bin"))
        binned = (
            placed.groupBy(*group, "_lo", "_bin")
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
            .withColumn("_to", F.sum("_c").over(upto))
        )
        nth = F.col("_rank") - F.col("_below")
        chosen = (
            open_.select(*group, "_lo", "_rank", "_below")
            .join(binned, [*group, "_lo"])
            .where((nth < F.col("_to")) & (nth >= F.col("_to") - F.col("_c")))
            .select(
                *group, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_rank",
                (F.col("_below") + F.col("_to") - F.col("_c")).alias("_below"),
                F.col("_lo").alias("_in"), F.col("_bin").alias("_bin_in"),
            )
        )
        bounds = cut(bounds.where("_lo = _hi").select(*group, "_lo", "_hi", "_rank", "_below").unionByName(chosen, True))
        placed = placed.select(*group, "_v", F.col("_lo").alias("_in"), F.col("_bin").alias("_bin_in"))
        inside = [*group, "_in", "_bin_in"]

    at = lambda rank, name: bounds.select(*group, F.col("_rank").alias(rank), F.col("_lo").alias(name))
    solved = (
        targets.withColumns({"_r0": F.floor("_h"), "_r1": F.ceil("_h")})
        .join(at("_r0", "_v0"), [*group, "_r0"])
        .join(at("_r1", "_v1"), [*group, "_r1"])
        .withColumn(
            "_q",
            F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(
                (F.col("_r1") - F.col("_h")) * F.col("_v0") + (F.col("_h") - F.col("_r0")) * F.col("_v1")
            ),
        )
    )
    pick = lambda c, i: F.max(F.when((F.col("_col") == c) & (F.col("_i") == i), F.col("_q")))
    # A column without values has null, as it has from ``percentile``.
    some = lambda c: F.max(F.when(F.col("_col") == c, F.lit(True)))
    made = solved.groupBy(*keys).agg(
        *[F.when(some(c), F.array(*[pick(c, i) for i in range(len(probs))])).alias(c) for c in cols]
    )
    if not keys:
        return made
    every = data.select(*keys).distinct()
    return every.join(made, [every[k].eqNullSafe(made[k]) for k in keys], "left").select(
        *[every[k] for k in keys], *cols
    )
