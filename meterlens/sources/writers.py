"""Outputs: CSV, JSON, model tables, the readings store and the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meterlens import schema as S
from meterlens.functions.names import safe_suffix
from meterlens.operators.clean import upsert
from meterlens.operators.columns import to_external
from meterlens.session import cut
from meterlens.sources.commits import CommitLog, Entry


def write_csv(df: DataFrame, path: str, *, external: bool = True, mode: str = "error") -> None:
    """CSV with a header; lists, maps and structures are written as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df = df.withColumns({c: F.to_json(c) for c in nested})
    out = (to_external(df) if external else df).write.mode(mode).option("header", True)
    # Microseconds are kept; the writer's own default stops at milliseconds.
    out.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def write_by_segment(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """One folder ``seg=<segment>`` per segment, with the segment's name made safe for a path."""
    named = to_external(df).withColumn("seg", safe_suffix(F.col(S.EXTERNAL_NAMES[S.SEGMENT])))
    named.write.mode(mode).option("header", True).partitionBy("seg").format(fmt).save(path)


def write_metrics_json(records: DataFrame, path: str, overall: str = "__all__", mode: str = "error") -> None:
    """``{"overall": {...}, "by_segment": [...]}`` from one record per segment plus the overall one."""
    record = F.struct(*records.columns)
    is_all = F.col(S.SEGMENT) == overall
    plain = F.struct(*[c for c in records.columns if c not in (S.SEGMENT, "thr_if", "contamination", "fusion", "z_threshold")])
    nested = records.agg(
        F.max(F.when(is_all, plain)).alias("overall"),
        F.sort_array(F.collect_list(F.when(~is_all, record))).alias("by_segment"),
    )
    nested.coalesce(1).write.mode(mode).json(path)


MODEL_TABLES = ("forecast", "forest", "thresholds")


def save_models(models, path: str, mode: str = "error") -> None:
    """Each model table as Parquet, one partition per segment."""
    for name in MODEL_TABLES:
        table = getattr(models, name).withColumn("seg", safe_suffix(S.SEGMENT))
        table.repartition("seg").write.mode(mode).partitionBy("seg").parquet(f"{path}/{name}")


def load_models(spark: SparkSession, path: str, segments: list[str] | None = None):
    """Models as written; a segment without all of its tables is an error."""
    from meterlens.plans.train import Models

    tables = {name: spark.read.parquet(f"{path}/{name}").drop("seg") for name in MODEL_TABLES}
    have = {name: {r[0] for r in t.select(S.SEGMENT).distinct().collect()} for name, t in tables.items()}
    wanted = set(segments) if segments else set().union(*have.values())
    missing = {name: sorted(wanted - got) for name, got in have.items() if wanted - got}
    if missing or not wanted:
        raise FileNotFoundError(f"model tables lack segments: {missing or 'all'}")
    return Models(**tables)


#: Entries of a store's log that stay, and how often a writer that others overtake begins again.
KEEP, ATTEMPTS = 10, 50


class ReadingsStore:
    """Readings kept as Parquet by calendar month; an update writes the months it touches anew, then says so.

    An update writes a folder of its own and then the next entry of the log, which names the version of every month. A
    reader never sees half an update, a lost job leaves the old state in place, and a batch costs what the months it
    falls in hold, not the store. Only one writer gets an entry's number. One that comes late looks at what the others
    changed: if that is none of its months it takes the next number, else it merges its batch with their result.

    The last ``keep`` entries and the months they name stay, so a reader or writer may be overtaken that often while it
    reads. Older ones are removed by updates. What a lost job wrote without an entry is never read; it stays.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP) -> None:
        self.spark, self.path, self.keep = spark, path, max(2, keep)
        self.log = CommitLog(spark, f"{path}/log")

    def _folder(self, version: str, month: str) -> str:
        return f"{self.path}/data/{version}/month={month}"

    def _read(self, state: dict[str, str]) -> DataFrame | None:
        files = [self._folder(version, month) for month, version in sorted(state.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*files) if files else None

    def current(self) -> DataFrame | None:
        """All readings; None before the first update."""
        last = self.log.last()
        found = self._read(last.state)
        return empty_like(self.spark) if found is None and last.n >= 0 else found

    def write(self, df: DataFrame) -> None:
        """``df`` becomes the whole store, whatever others write meanwhile."""
        state = self._written(df)
        for _ in range(ATTEMPTS):
            last = self.log.last()
            if self.log.put(Entry(last.n + 1, state, last.batches)):
                return self._tidy(last.n + 1)
        raise RuntimeError(f"{self.path}: overtaken {ATTEMPTS} times")

    def _written(self, df: DataFrame) -> dict[str, str]:
        """Write a version; the months it holds. Readings without a time have a month of their own."""
        version = uuid.uuid4().hex
        folder = f"{self.path}/data/{version}"
        marked = df.withColumn("month", _month())
        marked.write.partitionBy("month").parquet(folder)
        held = self.spark.read.schema(marked.schema).parquet(folder).select(F.col("month").cast("string")).distinct()
        return {r[0]: version for r in held.collect()}

    def upsert(self, batch: DataFrame, stream: str | None = None, batch_id: int = 0) -> None:
        """Add a batch; the newest row of a (client, timestamp) wins. Only the months of the batch are rewritten.

        A batch of a ``stream`` whose number, or a later one, is in the store already is left out, so a micro-batch that
        runs again after a failure changes nothing. The batch is computed once.
        """
        base = self.log.last()
        if stream is not None and base.batches.get(stream, -1) >= batch_id:
            return
        batch = cut(batch)
        touched = {r[0] for r in batch.select(_month()).distinct().collect()}  # calendar months: a short list
        made: dict[str, str] | None = None
        for _ in range(ATTEMPTS):
            if stream is not None and base.batches.get(stream, -1) >= batch_id:
                return self._forget(made)
            if made is None:
                held = self._read({m: v for m, v in base.state.items() if m in touched})
                made = self._written(batch if held is None else upsert(held, batch))
            state = {m: v for m, v in base.state.items() if m not in touched} | made
            batches = base.batches if stream is None else base.batches | {stream: batch_id}
            # Numbers of removed entries are free again, so a number is tried only if it is the next one.
            now = self.log.last()
            if now.n == base.n and self.log.put(Entry(base.n + 1, state, batches)):
                return self._tidy(now.n + 1)
            now = self.log.last()
            if any(now.state.get(m) != base.state.get(m) for m in touched):
                self._forget(made)
                made = None
            base = now
        raise RuntimeError(f"{self.path}: overtaken {ATTEMPTS} times")

    def _forget(self, made: dict[str, str] | None) -> None:
        """Remove a version that no entry names."""
        for version in set((made or {}).values()):
            self.log.remove(f"{self.path}/data/{version}")

    def _tidy(self, n: int) -> None:
        """After every ``keep``-th entry, remove all before the last ``keep`` and what only they name: data first."""
        if n % self.keep:
            return
        entries = self.log.entries()
        old, kept = entries[: -self.keep], entries[-self.keep :]
        live = {item for e in kept for item in e.state.items()}
        dead = {item for e in old for item in e.state.items()} - live
        for month, version in dead:
            self.log.remove(self._folder(version, month))
        for version in {v for _, v in dead} - {v for _, v in live}:
            self.log.remove(f"{self.path}/data/{version}")
        for entry in old:
            self.log.drop(entry)


def _month() -> Column:
    return F.coalesce(F.date_format(S.TS, "yyyyMM"), F.lit("none"))


def empty_like(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.READINGS)


def log_run(df: DataFrame, path: str, run_id: str, phase: str) -> None:
    """Append every field of per-segment records to the long run log."""
    log_table(df, run_id, phase).write.mode("append").parquet(path)


def log_table(df: DataFrame, run_id: str, phase: str) -> DataFrame:
    fields = [c for c in df.columns if c != S.SEGMENT]
    text = df.select(S.SEGMENT, *[F.col(c).cast("string").alias(c) for c in fields])
    return text.unpivot([S.SEGMENT], fields, "key", "value").select(
        F.lit(run_id).alias("run_id"), F.lit(phase).alias("phase"), S.SEGMENT, "key", "value"
    )
