"""Running totals over an order that no single task could hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens.session import cut


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column], *, parts: int | None = None
) -> DataFrame:
    """Inclusive running sums of ``totals`` per ``keys`` in ``order``.

    ``order`` must be unique within a key. Rows are range-partitioned by (keys, order), so a key that
    holds most of the table is spread over many even partitions; each partition sums its own rows and
    a small table (one row per key and partition) carries the sum of the earlier ones. The
    range-partitioned copy is written out first, so partition numbers survive a lost executor. ``parts`` is the
    number of partitions where the caller has measured the rows, else the session's shuffle partitions.
    """
    keys, order = list(keys), list(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepared = df.withColumns({f"_w_{name}": expr for name, expr in totals.items()})
    ranged = cut(
        prepared.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(*[F.sum(f"_w_{name}").alias(f"_s_{name}") for name in totals])
        .select(
            *keys,
            "_part",
            *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = ranged.withColumns({f"_l_{n}": F.sum(f"_w_{n}").over(inside) for n in totals})
    joined = local.join(offsets, [*keys, "_part"]).withColumns(
        {n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in totals}
    )
    return joined.drop("_part", *[f"_{p}_{n}" for n in totals for p in ("w", "l", "o")])


#: Sizes of numbers whose sums are kept apart, so a huge value leaves no rounding error behind in the sums of small ones.
_SIZES = ((0.0, 1e6), (1e6, 1e12), (1e12, float("inf")))


def trailing_mean(
    df: DataFrame, keys: Sequence[str], clock: str, reach: int, col: str, name: str, *, parts: int | None = None
) -> DataFrame:
    """Add ``name``: the key's mean of ``col`` over ``[clock - reach, clock)``, null where no value lies there.

    Every value enters just after its time and leaves once it is out of reach, so the sum of a window is a running
    total at the row's time. Rows and changes are spread evenly by ``running_totals``: a burst of rows within one
    reach costs no more than the same rows far apart, and rows of one time may lie in several tasks. ``clock`` is a
    whole number; rows without one get null. Sums are taken back as windows move on, which costs about 1e-10 of the
    largest value of the same size class; nulls do not count, NaN and infinities give what ``avg`` gives.
    """
    keys = list(keys)
    v = F.col("_v")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    kinds = {"_n": F.lit(1), "_nan": F.isnan(v).cast("int")}
    kinds |= {f"_{sign}inf": (v == float(f"{sign}inf")).cast("int") for sign in ("", "-")}
    for i, (least, most) in enumerate(_SIZES):
        here = finite & (v != 0) & (F.abs(v) >= least) & (F.abs(v) < most)
        kinds |= {f"_n{i}": here.cast("int"), f"_s{i}": F.when(here, v).otherwise(0.0)}

    at, sign = F.col("_move._at"), F.col("_move._sign")
    moves = F.array(
        F.struct((F.col(clock) + 1).alias("_at"), F.lit(1).alias("_sign")),
        F.struct((F.col(clock) + reach + 1).alias("_at"), F.lit(-1).alias("_sign")),
    )
    values = df.where(F.col(col).isNotNull() & F.col(clock).isNotNull())
    values = values.select(*keys, F.col(col).cast("double").alias("_v"), F.explode(moves).alias("_move"))
    changes = values.groupBy(*keys, at.alias("_at")).agg(
        *[F.sum(sign * expr).alias(kind) for kind, expr in kinds.items()]
    )
    row = F.struct(*[F.col(c) for c in df.columns])
    # At one time the changes come first; the hash only spreads rows of one time.
    asked = df.select(*keys, F.col(clock).alias("_at"), F.xxhash64(row).alias("_tie"), row.alias("_row"))
    both = changes.withColumn("_asks", F.lit(0)).unionByName(
        asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True
    )
    totals = {f"{kind}_run": F.coalesce(F.col(kind), F.lit(0)) for kind in kinds}
    run = running_totals(both, keys, ["_at", "_asks", "_tie"], totals, parts=parts).where("_asks = 1")

    total = sum(F.when(F.col(f"_n{i}_run") > 0, F.col(f"_s{i}_run")).otherwise(0.0) for i in range(len(_SIZES)))
    up, down = F.col("_inf_run") > 0, F.col("_-inf_run") > 0
    total = (
        F.when((F.col("_nan_run") > 0) | (up & down), float("nan"))
        .when(up, float("inf")).when(down, float("-inf")).otherwise(total)
    )
    mean = F.when(F.col("_at").isNotNull() & (F.col("_n_run") > 0), total / F.col("_n_run"))
    return run.select("_row.*", mean.alias(name))
