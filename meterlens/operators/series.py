"""Per-client series: lag tables, residual features, regular hourly grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens import schema as S
from meterlens.config import ForecastParams, JobParams
from meterlens.operators.blocks import Blocks, task_count
from meterlens.operators.clean import keep_last



def reach(p: JobParams = JobParams()) -> tuple[int, int]:
    """Rows back and ahead that smoothing, lags, residual windows and the target need together."""
    back = p.ssa.window - 1 + p.forecast.maxlag + max(5, p.anomaly.roll_window)
    return back, p.ssa.window - 1 + 1


HISTORY_REACH, FUTURE_REACH = reach()


def lag_names(p: ForecastParams) -> list[str]:
    exo = [f"{n}_lag{k}" for k in range(p.lags_exo) for n in ("p", "t")]
    return [f"vf_lag{k}" for k in range(p.lags_v)] + exo


def lag_arrays(blocks: Blocks, smoothed: str, p: ForecastParams) -> Blocks:
    """Add ``base``, the lags in the order of ``lag_names``, and the next volume.

    Keeps the rows that have every lag and a next reading; margins stay. The measures must not be null.
    """
    w = blocks.window

    def lags(col: str, n: int) -> Column:
        return F.reverse(F.collect_list(col).over(w.rowsBetween(1 - n, 0)))

    df = blocks.df.withColumns(
        {
            "_vf": lags(smoothed, p.lags_v),
            "_p": lags(S.PRESSURE, p.lags_exo),
            "_t": lags(S.TEMPERATURE, p.lags_exo),
            "volume_next": F.lead(S.VOLUME).over(w),
        }
    )
    inside = (F.col("pos") >= p.maxlag) & (F.col("pos") <= F.col("n_rows") - 2)
    if blocks.size:  # the outer rows of a margin lack lags
        inside &= (F.size("_vf") == p.lags_v) & (F.size("_p") == p.lags_exo)
    exo = F.flatten(F.zip_with("_p", "_t", lambda a, b: F.array(a, b)))
    made = df.where(inside).withColumn("base", F.concat("_vf", exo)).drop("_vf", "_p", "_t")
    return blocks.using(p.maxlag, 1).on(made)


def lag_columns(df: DataFrame, p: ForecastParams) -> DataFrame:
    """``base`` spread over one named column per lag."""
    named = {c: F.get("base", F.lit(i)) for i, c in enumerate(lag_names(p))}
    return df.withColumns(named).drop("base")


def residual_features(
    blocks: Blocks, resid: str = "resid", roll_window: int = 12, first_pos: int | None = None
) -> Blocks:
    """Rolling mean and population spread of the residual, its z-score and first differences.

    ``first_pos`` is the position of each series' first row; the differences are 0 there.
    """
    width = max(5, int(roll_window))
    w = blocks.window
    roll = w.rowsBetween(1 - width, 0)
    r = F.col(resid)
    enough = F.count(r).over(roll) >= 5
    spread = F.when(enough, F.stddev_pop(r).over(roll))
    df = blocks.df.withColumns(
        {
            "r_mean": F.coalesce(F.when(enough, F.avg(r).over(roll)), F.lit(0.0)),
            "r_std": F.when(spread.isNull() | (spread == 0), F.lit(1e-6)).otherwise(spread),
        }
    )
    df = df.withColumn("_z", (r - F.col("r_mean")) / F.col("r_std"))
    start = F.col("pos") == first_pos if first_pos is not None else F.lit(False)
    before = lambda c: F.when(start, F.col(c)).otherwise(F.coalesce(F.lag(c).over(w), F.col(c)))
    df = df.withColumns(
        {
            "z_abs": F.abs("_z"),
            "dz_abs": F.abs(F.col("_z") - before("_z")),
            "dr_abs": F.abs(r - before(resid)),
        }
    )
    return blocks.using(width, 0).on(df.drop("_z"))


def next_label(blocks: Blocks, label: str) -> Blocks:
    """The label of the client's next reading; 0 where there is none."""
    following = F.lead(label).over(blocks.window)
    return blocks.using(0, 1).on(
        blocks.df.withColumn("label_next", F.coalesce(following.cast("int"), F.lit(0)))
    )


def hourly_grid(df: DataFrame, *, truncate: bool = False, step: str = "1 hour") -> DataFrame:
    """One row per client and hour from the client's first to its last reading.

    Readings off the grid that the first timestamp starts are lost unless ``truncate`` moves every
    reading to its full hour first. Filled rows carry the keys and ``is_filled``.
    """
    if truncate:
        midnight = F.to_date(S.TS).cast("timestamp_ntz")  # no session zone, so no hour is skipped
        df = df.withColumn(S.TS, F.timestamp_add("HOUR", F.hour(S.TS), midnight))
    one = keep_last(df)
    ends = one.groupBy(S.CLIENT).agg(F.min(S.TS).alias("_a"), F.max(S.TS).alias("_b"))
    # Every row becomes many: spread them first. A partitioning by the client alone would be taken for
    # the one the aggregation left, whose small partitions may have been merged.
    ends = ends.repartition(task_count(df), S.CLIENT, "_a")
    slots = ends.select(S.CLIENT, F.expr(f"explode(sequence(_a, _b, interval {step}))").alias(S.TS))
    return slots.join(one, [S.CLIENT, S.TS], "left").withColumn(
        "is_filled", F.col(S.VOLUME).isNull() & F.col(S.PRESSURE).isNull() & F.col(S.TEMPERATURE).isNull()
    )


def interpolate(blocks: Blocks, cols: tuple[str, ...] = tuple(S.MEASURES)) -> Blocks:
    """Fill gaps linearly by position; gaps at the ends take the nearest value.

    ``blocks`` must come from ``series_blocks(..., order=("ts",))``. A gap inside a cut series is
    bridged by the known values carried in from the neighbouring blocks.
    """
    df = blocks.df
    # Looking ahead runs over the reversed order, where the frame grows by one row at a time.
    upto = Window.unboundedPreceding, Window.currentRow
    past = blocks.window.rowsBetween(*upto)
    future = Window.partitionBy(*blocks.group).orderBy(*[F.desc(c) for c in blocks.order]).rowsBetween(*upto)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(c).alias("v")))
    marks = {}
    for c in cols:
        marks[f"_a_{c}"] = F.last(known(c), ignorenulls=True).over(past)
        marks[f"_b_{c}"] = F.last(known(c), ignorenulls=True).over(future)
    df = df.withColumns(marks)
    if blocks.size:
        df = _bridge(blocks, df, cols)
    filled = {}
    for c in cols:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        along = (F.col("pos") - a.p) / (b.p - a.p)
        line = a.v + (b.v - a.v) * along
        filled[c] = F.coalesce(F.col(c), F.when(a.p.isNotNull() & b.p.isNotNull(), line), a.v, b.v)
    return blocks.on(df.withColumns(filled).drop(*marks))


def _bridge(blocks: Blocks, df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Where a block knows no value before or after a row, take it from the nearest other block."""
    per = Window.partitionBy(*blocks.keys)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(c).alias("v")))
    edges = blocks.df.groupBy(*blocks.group).agg(
        *[F.max(known(c)).alias(f"_x_{c}") for c in cols], *[F.min(known(c)).alias(f"_n_{c}") for c in cols]
    )
    back = per.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *blocks.group,
        *[F.last(f"_x_{c}", ignorenulls=True).over(back).alias(f"_p_{c}") for c in cols],
        *[F.last(f"_n_{c}", ignorenulls=True).over(ahead).alias(f"_f_{c}") for c in cols],
    )
    joined = df.join(edges, blocks.group)
    joined = joined.withColumns(
        {f"_a_{c}": F.coalesce(f"_a_{c}", f"_p_{c}") for c in cols}
        | {f"_b_{c}": F.coalesce(f"_b_{c}", f"_f_{c}") for c in cols}
    )
    return joined.drop(*[f"_{x}_{c}" for x in "pf" for c in cols])
