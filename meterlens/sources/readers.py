"""Reading inputs: CSV of any separator, one file per client, Parquet, or nothing at all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterlens import schema as S
from meterlens.operators.columns import coerce_measures, normalise_headers
from meterlens.operators.timestamps import parse_timestamp

# Candidate separators in order of preference, and encodings tried in order.
SEPARATORS = [",", ";", "\t", "|"]
ENCODINGS = ["UTF-8", "ISO-8859-1"]


def empty_readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.READINGS)


def typed_readings(raw: DataFrame, client_hint: str | None = None, date_hint: str | None = None) -> DataFrame:
    """Headers, timestamps and numbers of a raw text table brought to the internal form.

    Rows get ``src_ord``, their order in the input, unless they bring one.
    """
    df = normalise_headers(raw, client_hint, date_hint)
    if S.TS in df.columns and df.schema[S.TS].dataType.simpleString() == "string":
        df = df.withColumn(S.TS, parse_timestamp(S.TS))
    elif S.TS in df.columns:
        df = df.withColumn(S.TS, F.col(S.TS).cast("timestamp_ntz"))
    df = coerce_measures(df)
    if S.ORD not in df.columns:
        # Splits of one file are numbered in file order, so within a file this follows the input.
        # Between files the order is fixed per plan but not theirs: bring ``src_ord`` where it matters.
        df = df.withColumn(S.ORD, F.monotonically_increasing_id())
    return df


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, all columns as text; a byte order mark is dropped by the reader."""
    return spark.read.option("header", True).csv(path, sep=sep, encoding=encoding)


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding), decided on all lines in one scan.

    The separator cuts all lines into the same, largest number of fields; if none does, the one that every line has
    most often. The encoding is UTF-8, unless the bytes of a line are not valid UTF-8.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    count = lambda sep: F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit(sep), F.lit("")))
    row = lines.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        *[f(count(sep)).alias(f"{n}{i}") for i, sep in enumerate(SEPARATORS) for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    if not row["n"]:
        raise ValueError(f"no data in {path}")
    low, high = ([row[f"{n}{i}"] for i in range(len(SEPARATORS))] for n in ("lo", "hi"))
    # The earliest wins a tie.
    best = max(range(len(SEPARATORS)), key=lambda i: (low[i] == high[i] > 0, low[i]))
    return SEPARATORS[best] if low[best] else SEPARATORS[0], ENCODINGS[0] if row["utf8"] else ENCODINGS[1]


def sniff_separator(spark: SparkSession, path: str) -> str:
    return sniff(spark, path)[0]


def sniff_encoding(spark: SparkSession, path: str) -> str:
    return sniff(spark, path)[1]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV of unknown separator and encoding, or Parquet, by file ending."""
    lower = path.rstrip("/").lower()
    if lower.endswith(".parquet"):
        return read_parquet(spark, path)
    if not lower.endswith((".csv", ".txt")):
        raise ValueError(f"unsupported file type: {path}")
    return read_csv(spark, path, *sniff(spark, path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_client_files(spark: SparkSession, folder: str, fmt: str = "csv") -> DataFrame:
    """A folder with one file per client; the client is the file name without its ending.

    A file may be a folder of that name with part files, as Spark writes it.

    Files may differ in columns and in their order: the union by name is taken, absent columns are null. CSV files
    are read by one scan for each distinct header, Parquet files by one scan.
    """
    name = _plain(F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)\.{fmt}(?:/part-[^/]*)?$", 1))
    if fmt != "csv":
        df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).format(fmt).option(
            "pathGlobFilter", f"*.{fmt}"
        ).load(folder)
        return df.withColumn(S.CLIENT, name)
    return union_sources(
        [
            spark.read.option("header", True).csv(files).withColumn(S.CLIENT, name)
            for files in _files_by_header(spark, folder)
        ]
    )


def _plain(path: Column) -> Column:
    """File names stand percent-encoded in the metadata; a plus sign is itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _files_by_header(spark: SparkSession, folder: str) -> list[list[str]]:
    """The CSV files of a folder, grouped by their first line, in the order of their names."""
    found = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(folder)
    lines = found.select(
        _plain(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    # Lines of a split are numbered in file order, and a file's first split starts at 0.
    heads = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "line").alias("head"))
    grouped = heads.where(F.trim("head") != "").groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return sorted([r.files for r in grouped.collect()])


def union_sources(frames: Mapping[str, DataFrame] | list[DataFrame]) -> DataFrame:
    """All rows of all frames, with the union of their columns; nothing to read is an error."""
    parts = list(frames.values()) if isinstance(frames, Mapping) else list(frames)
    if not parts:
        raise ValueError("no readable source")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
