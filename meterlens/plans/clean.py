"""Cleaning job: raw readings in, clean and segmented readings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from meterlens import schema as S
from meterlens.config import SegmentParams
from meterlens.operators import clean, report, segment
from meterlens.operators.blocks import beside
from meterlens.operators.columns import front_columns
from meterlens.session import cut
from meterlens.sources.readers import typed_readings


@dataclass(frozen=True)
class CleanResult:
    readings: DataFrame
    counts: DataFrame  # one row: unparseable, duplicates, negatives
    imputations: DataFrame  # per client
    segments: DataFrame  # clients per segment


def clean_readings(
    raw: DataFrame, p: SegmentParams = SegmentParams(), *, lookback: int = 3 * clean.HOUR, max_rows: int | None = None
) -> CleanResult:
    """Parse, drop undated rows, keep first of duplicates, impute pressure, clamp negatives, segment."""
    typed = cut(typed_readings(raw))
    dated = typed.where(F.col(S.TS).isNotNull())
    unique = cut(clean.keep_first(dated))
    imputed = cut(clean.impute_pressure(unique, lookback, max_rows=max_rows))
    clamped = clean.clamp_negatives(imputed.drop("imputed"))
    segmented = cut(front_columns(segment.segment_clients(clamped, p)))
    parts = [clean.unparseable(typed), clean.duplicate_count(dated), clean.negative_counts(imputed)]
    counts = beside(beside(parts[0], parts[1]), parts[2])
    return CleanResult(
        segmented, counts, clean.imputation_report(imputed), report.clients_per_segment(segmented)
    )


def add_upload(stored: DataFrame | None, raw: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Clean a batch and merge it into the stored readings, newest wins.

    Clients already stored keep their segment; new clients are segmented on the merged readings.
    """
    batch = clean_readings(raw, p).readings
    if stored is None:
        return batch
    merged = cut(clean.upsert(stored, batch))
    known = report.modal_segment(stored)
    fresh = merged.join(known.select(S.CLIENT), S.CLIENT, "left_anti")
    if not fresh.limit(1).count():
        return segment.attach_segments(merged, known)
    made = segment.segment_profiles(segment.client_profiles(merged), p).select(S.CLIENT, S.SEGMENT)
    added = made.join(known.select(S.CLIENT), S.CLIENT, "left_anti")
    return segment.attach_segments(merged, known.unionByName(added))
