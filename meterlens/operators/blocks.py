"""Series cut into blocks that one task can hold.

Every look-back or look-ahead operator works on ``Blocks``: the readings with their position in the
client's series. Normal clients are one block each, so the single shuffle by client serves all later
windows. A client with more than ``max_rows`` readings is cut into blocks of consecutive readings,
each with a margin of neighbouring rows, so the windows stay exact and no task holds the whole client.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from meterlens import schema as S
from meterlens.operators.ordering import running_totals

MAX_ROWS = 1_000_000
TASK_ROWS = 2_000_000
BROADCAST_ROWS = 100_000
MAX_SEGMENTS = 1_000


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count was measured and is small; else leave the choice to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def segment_rows(df: DataFrame) -> list:
    """The rows of a table with one row per segment, for closures that carry a model of each.

    Segments are kinds of consumption, a handful by design; more than ``MAX_SEGMENTS`` are refused, not gathered.
    """
    rows = df.limit(MAX_SEGMENTS + 1).collect()
    if len(rows) > MAX_SEGMENTS:
        raise ValueError(f"more than {MAX_SEGMENTS} segments")
    return rows


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate, as a scalar subquery (no join)."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_one", row).select(*df.columns, "_one.*")


def task_count(df: DataFrame, rows: int = 0) -> int:
    """Partitions for steps that are heavy for the size of their input; ``rows`` is its measured row count."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-rows // TASK_ROWS))


@dataclass(frozen=True)
class Blocks:
    """Readings with ``pos`` (0-based), ``n_rows`` (length of the series), ``block`` and ``is_core``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    size: int | None  # rows per block, None when every series is one block
    back: int = 0  # rows of margin before and after a block that later windows may still use
    ahead: int = 0

    @property
    def group(self) -> list[str]:
        return [*self.keys, "block"] if self.size else list(self.keys)

    @property
    def window(self) -> WindowSpec:
        # Not by ``pos``: this order is the one the rows already lie in.
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def on(self, df: DataFrame) -> Blocks:
        return replace(self, df=df)

    def using(self, back: int, ahead: int) -> Blocks:
        """What is left of the margins after windows of this reach; cut series with less are an error."""
        if self.size and (back > self.back or ahead > self.ahead):
            raise ValueError(
                f"windows reach {back} rows back and {ahead} ahead, the margins are {self.back} and {self.ahead}"
            )
        return replace(self, back=max(0, self.back - back), ahead=max(0, self.ahead - ahead))

    def core(self) -> DataFrame:
        """The rows without the margins."""
        rows = self.df.where("is_core") if self.size else self.df
        return rows.drop("block", "is_core")

    def attach(self, per_series: DataFrame) -> Blocks:
        """Join one row per series (with its ``n_rows``) onto the rows, block by block."""
        if self.size:
            last = F.floor((F.col("n_rows") - 1) / self.size)
            side = per_series.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        else:
            side = per_series
        return self.on(self.df.join(side.drop("n_rows"), self.group))


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> tuple[DataFrame, int, int]:
    """Keys with more than ``max_rows`` rows, how many there are, and the number of all rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    big = F.col("n_rows") > max_rows
    row = counted.agg(F.count_if(big).alias("hot"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    return counted.where(big), row["hot"], row["rows"]


def series_blocks(
    df: DataFrame,
    back: int,
    ahead: int,
    *,
    keys: Sequence[str] = (S.CLIENT,),
    order: Sequence[str] = (S.TS, S.ORD),
    max_rows: int | None = None,
) -> Blocks:
    """Number the rows of each series; ``back``/``ahead`` is how far later windows will reach."""
    keys, order = list(keys), list(order)
    max_rows = max_rows or MAX_ROWS
    hot, n_hot, rows = hot_keys(df, keys, max_rows)
    whole = Window.partitionBy(*keys)

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "pos": F.row_number().over(whole.orderBy(*order)).cast("long") - 1,
                "n_rows": F.count(F.lit(1)).over(whole),
                "block": F.lit(0).cast("long"),
                "is_core": F.lit(True),
            }
        )

    # As many partitions as the rows need: the windows are heavy for their size, so merging small shuffle
    # partitions would leave cores idle.
    parts = task_count(df, rows)
    if n_hot == 0:
        return Blocks(numbered(df.repartition(parts, *keys)), tuple(keys), tuple(order), None, back, ahead)

    size = max(max_rows // 4, 1)
    side = checked_broadcast(hot, n_hot)
    cold = numbered(df.join(side.drop("n_rows"), keys, "left_anti"))
    # A cold series is numbered whole, then takes part in the same block layout without margins.
    cold = _spread(cold.drop("block", "is_core"), size, back, ahead)
    ranked = running_totals(df.join(side, keys), keys, order, {"pos": F.lit(1)}, parts=parts)
    split = _spread(ranked.withColumn("pos", F.col("pos") - 1), size, back, ahead)
    both = cold.unionByName(split).repartition(parts, *keys, "block")
    return Blocks(both, tuple(keys), tuple(order), size, back, ahead)


def _spread(df: DataFrame, size: int, back: int, ahead: int) -> DataFrame:
    """Put each row into its own block and into every block whose margin it falls in."""
    pos, last = F.col("pos"), F.floor((F.col("n_rows") - 1) / size)
    first = F.greatest(F.floor((pos - ahead) / size), F.lit(0).cast("long"))
    final = F.least(F.floor((pos + back) / size), last)
    return df.withColumn("block", F.explode(F.sequence(first, final))).withColumn(
        "is_core", F.col("block") == F.floor(pos / size)
    )
